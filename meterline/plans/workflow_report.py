"""Workflow analytics: landed workflows and job histories to per-level tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import zoned_text_to_epoch
from ..operators.aggregates import attempt_outcomes
from ..operators.intervals import concurrency, flag_stragglers, wait_time
from ..operators.joins import enrich, expand_jobs
from ..operators.projections import keep_states
from ..operators.rollups import rollup_workflow, workflow_delays
from ..streaming.marks import TERMINAL_STATES


def workflow_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Landed workflow documents to workflow and action tables with epoch-second times."""
    ended = keep_states(docs, TERMINAL_STATES)
    workflows = ended.select(
        F.col("id").alias("wfId"), F.col("appName").alias("wfName"), "status",
        zoned_text_to_epoch("createdTime").alias("createdTime"),
        zoned_text_to_epoch("startTime").alias("startTime"),
        zoned_text_to_epoch("endTime").alias("endTime"),
    )
    rows = ended.select(F.col("id").alias("wfId"), F.explode("actions").alias("a"))
    actions = rows.select(
        "wfId", F.col("a.id").alias("wfaId"), F.col("a.name").alias("name"), F.col("a.type").alias("type"),
        F.col("a.status").alias("status"), F.col("a.externalId").alias("externalId"),
        F.col("a.externalChildIDs").alias("externalChildIDs"), F.col("a.retries").alias("retries"),
        zoned_text_to_epoch("a.startTime").alias("startTime"),
        F.coalesce(zoned_text_to_epoch("a.endTime"), F.lit(-1)).alias("endTime"),
    )
    return workflows, actions


def job_statistics(jobs: DataFrame, attempts: DataFrame) -> dict[str, DataFrame]:
    """Wait time and outcomes on the jobs, straggler flags on the attempts, tasks over time.

    Attempts carry ``jobId``.
    """
    rows = wait_time(jobs, attempts)
    rows = enrich(rows, attempt_outcomes(attempts), ["jobId"])
    flagged = flag_stragglers(attempts, ["jobId", "type"], "elapsedTime")
    spans = jobs.select("jobId", F.col("startTime").alias("_from"), F.col("finishTime").alias("_to"))
    tasks = attempts.select("jobId", "type", "startTime", "finishTime").join(spans, "jobId", "inner")
    points = concurrency(
        tasks, ["jobId"], "startTime", "finishTime", "even", "_from", "_to",
        {"mapCount": F.col("type") == "MAP", "reduceCount": F.col("type") != "MAP"},
    )
    return {"jobs": rows, "attempts": flagged, "points": points}


def workflow_report(
    workflows: DataFrame, actions: DataFrame, jobs: DataFrame, attempts: DataFrame
) -> dict[str, DataFrame]:
    """Every level of the hierarchy with its metrics; no loop over workflows."""
    stats = job_statistics(jobs, attempts)
    placed = expand_jobs(actions.select("wfId", "wfaId", "externalId", "externalChildIDs"), stats["jobs"])
    placed = placed.drop("externalId", "externalChildIDs")
    wf_rows, wfa_rows = rollup_workflow(workflows, actions, placed, attempts)
    delays = workflow_delays(workflows, actions, placed).select("wfId", "wfSchedulingDelay", "jobSchedulingDelay")
    return {
        "workflows": enrich(wf_rows, delays, ["wfId"]),
        "actions": wfa_rows,
        "jobs": placed,
        "attempts": stats["attempts"],
        "points": stats["points"],
    }
