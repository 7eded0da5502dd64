"""Job-history events folded into one record per job, task and attempt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .projections import counters_to_map

# Event types by the entity and step they describe.
ATTEMPT_STEPS = {
    "MAP_ATTEMPT_STARTED": "start",
    "MAP_ATTEMPT_FINISHED": "finish",
    "MAP_ATTEMPT_FAILED": "failed",
    "MAP_ATTEMPT_KILLED": "failed",
    "REDUCE_ATTEMPT_STARTED": "start",
    "REDUCE_ATTEMPT_FINISHED": "finish",
    "REDUCE_ATTEMPT_FAILED": "failed",
    "REDUCE_ATTEMPT_KILLED": "failed",
}
TASK_STEPS = {"TASK_STARTED": "start", "TASK_FINISHED": "finish", "TASK_FAILED": "failed"}
JOB_STEPS = {
    "JOB_SUBMITTED": "submit",
    "JOB_INITED": "init",
    "JOB_INFO_CHANGED": "info_changed",
    "JOB_FINISHED": "finish",
    "JOB_FAILED": "unsuccessful",
    "JOB_KILLED": "unsuccessful",
    "JOB_ERROR": "unsuccessful",
}
EVENT_TYPES = [*ATTEMPT_STEPS, *TASK_STEPS, *JOB_STEPS]


def _seconds(col) -> Column:
    c = col if isinstance(col, Column) else F.col(col)
    return F.floor(c / 1000).cast("bigint")


def _steps(events: DataFrame, steps: dict[str, str], ident: str) -> DataFrame:
    mapping = F.create_map(*[F.lit(x) for pair in steps.items() for x in pair])
    return (
        events.filter(F.col("type").isin(list(steps)))
        .withColumn("_step", mapping[F.col("type")])
        .withColumn("_id", F.col(f"event.{ident}"))
        .filter(F.col("_id").isNotNull())
    )


def _at(step: str, value) -> Column:
    """The value an event of this step carried (the latest, should it repeat)."""
    c = value if isinstance(value, Column) else F.col(f"event.{value}")
    mark = F.col("_step") == step
    when = F.coalesce(F.col("event.finishTime"), F.col("event.startTime"), F.lit(0))
    return F.max_by(F.when(mark, c), F.when(mark & c.isNotNull(), when))


def fold_attempts(events: DataFrame) -> DataFrame:
    """One row per task attempt.

    An attempt that only started is KILLED with finish and elapsed time -1; one that
    failed without a start begins at 0; one that finished without a start is dropped.
    """
    rows = _steps(events, ATTEMPT_STEPS, "attemptId")
    seen = rows.groupBy("job_file", "_id").agg(
        F.max((F.col("_step") == "start").cast("int")).alias("_started"),
        F.max((F.col("_step") == "failed").cast("int")).alias("_failed"),
        F.max((F.col("_step") == "finish").cast("int")).alias("_finished"),
        F.coalesce(_at("start", "taskid"), _at("failed", "taskid")).alias("taskId"),
        F.coalesce(_at("failed", "taskType"), _at("start", "taskType")).alias("type"),
        _seconds(_at("start", "startTime")).alias("_start"),
        _at("start", "containerId").alias("containerId"),
        _at("start", F.col("event.locality.string")).alias("locality"),
        F.coalesce(_at("failed", "status"), _at("finish", "taskStatus")).alias("_state"),
        _seconds(F.coalesce(_at("failed", "finishTime"), _at("finish", "finishTime"))).alias("_finish"),
        F.coalesce(_at("failed", "hostname"), _at("finish", "hostname")).alias("nodeHttpAddress"),
        F.coalesce(_at("failed", "rackname"), _at("finish", "rackname")).alias("rackname"),
        _seconds(_at("finish", "mapFinishTime")).alias("mapFinishTime"),
        _seconds(_at("finish", "shuffleFinishTime")).alias("shuffleFinishTime"),
        _seconds(_at("finish", "sortFinishTime")).alias("_sort"),
        _at("finish", "state").alias("status"),
        F.coalesce(_at("finish", "diagnostics"), _at("failed", "error")).alias("diagnostics"),
        F.coalesce(
            _at("failed", F.col("event.counters.groups")), _at("finish", F.col("event.counters.groups"))
        ).alias("_groups"),
    )
    kept = seen.filter((F.col("_started") == 1) | (F.col("_failed") == 1))
    start = F.coalesce("_start", F.lit(0)).cast("bigint")
    ended = F.col("_finish").isNotNull()
    out = kept.select(
        "job_file",
        F.col("_id").alias("taskAttemptId"),
        "taskId",
        "type",
        F.coalesce("_state", F.lit("KILLED")).alias("state"),
        F.col("_start").alias("submitTime"),
        start.alias("startTime"),
        F.coalesce("_finish", F.lit(-1)).cast("bigint").alias("finishTime"),
        F.when(ended, F.col("_finish") - start).otherwise(F.lit(-1)).alias("elapsedTime"),
        "mapFinishTime",
        "shuffleFinishTime",
        F.when(F.col("shuffleFinishTime").isNotNull(), F.col("_sort")).alias("mergeFinishTime"),
        "locality",
        "containerId",
        "nodeHttpAddress",
        "rackname",
        "status",
        "diagnostics",
        counters_to_map(F.col("_groups")).alias("counters"),
    )
    return out.withColumns(
        {
            "elapsedShuffleTime": F.col("shuffleFinishTime") - F.col("startTime"),
            "elapsedMergeTime": F.col("mergeFinishTime") - F.col("shuffleFinishTime"),
        }
    ).withColumn(
        "elapsedReduceTime",
        F.col("elapsedTime") - F.col("elapsedShuffleTime") - F.col("elapsedMergeTime"),
    )


def fold_tasks(events: DataFrame) -> DataFrame:
    """One row per task that started."""
    rows = _steps(events, TASK_STEPS, "taskid")
    seen = rows.groupBy("job_file", "_id").agg(
        F.max((F.col("_step") == "start").cast("int")).alias("_started"),
        _at("start", "taskType").alias("type"),
        _seconds(_at("start", "startTime")).alias("startTime"),
        F.coalesce(_at("failed", "status"), _at("finish", "status")).alias("state"),
        _seconds(F.coalesce(_at("failed", "finishTime"), _at("finish", "finishTime"))).alias("finishTime"),
        _at("finish", F.col("event.successfulAttemptId.string")).alias("successfulAttempt"),
        _at("failed", "error").alias("error"),
        F.coalesce(
            _at("failed", F.col("event.counters.groups")), _at("finish", F.col("event.counters.groups"))
        ).alias("_groups"),
    )
    length = F.col("finishTime") - F.col("startTime")
    return seen.filter(F.col("_started") == 1).select(
        "job_file",
        F.col("_id").alias("taskId"),
        "type",
        "state",
        F.col("startTime").alias("submitTime"),
        "startTime",
        "finishTime",
        F.col("finishTime").alias("endTime"),
        length.alias("runTime"),
        length.alias("elapsedTime"),
        F.when(F.col("finishTime").isNotNull(), F.lit(0).cast("bigint")).alias("schedulingDelay"),
        "successfulAttempt",
        "error",
        counters_to_map(F.col("_groups")).alias("counters"),
    )


def fold_jobs(events: DataFrame) -> DataFrame:
    """One row per submitted job, times in seconds."""
    rows = _steps(events, JOB_STEPS, "jobid")
    seen = rows.groupBy("job_file", "_id").agg(
        F.max((F.col("_step") == "submit").cast("int")).alias("_submitted"),
        _at("submit", "jobName").alias("name"),
        _at("submit", "userName").alias("user"),
        _at("submit", "jobQueueName").alias("queue"),
        _seconds(F.coalesce(_at("info_changed", "submitTime"), _at("submit", "submitTime"))).alias("submitTime"),
        _seconds(F.coalesce(_at("info_changed", "launchTime"), _at("init", "launchTime"))).alias("_launch"),
        _at("init", "totalMaps").alias("_maps"),
        _at("init", "totalReduces").alias("_reduces"),
        _at("init", "uberized").alias("uberized"),
        _seconds(F.coalesce(_at("unsuccessful", "finishTime"), _at("finish", "finishTime"))).alias("_finish"),
        F.coalesce(_at("unsuccessful", "finishedMaps"), _at("finish", "finishedMaps")).alias("mapsCompleted"),
        F.coalesce(_at("unsuccessful", "finishedReduces"), _at("finish", "finishedReduces")).alias(
            "reducesCompleted"
        ),
        F.coalesce(
            _at("unsuccessful", "jobStatus"), F.max(F.when(F.col("_step") == "finish", F.lit("SUCCEEDED")))
        ).alias("state"),
        _at("unsuccessful", "diagnostics").alias("diagnostics"),
        F.map_concat(
            *[
                F.coalesce(counters_to_map(_at("finish", F.col(f"event.{p}Counters.groups")), s), F.create_map())
                for p, s in (("total", "Total"), ("map", "Map"), ("reduce", "Reduce"))
            ]
        ).alias("counters"),
    )

    def gap(late: str, early: str) -> Column:
        return F.when((F.col(late) > 0) & (F.col(early) > 0), F.col(late) - F.col(early))

    out = seen.filter(F.col("_submitted") == 1).select(
        "job_file",
        F.col("_id").alias("jobId"),
        "name",
        "user",
        "queue",
        "state",
        "submitTime",
        F.coalesce("_launch", F.lit(-1)).alias("startTime"),
        F.coalesce("_finish", F.lit(-1)).alias("finishTime"),
        F.coalesce("_maps", F.lit(0)).alias("mapsTotal"),
        F.coalesce("_reduces", F.lit(0)).alias("reducesTotal"),
        F.coalesce("uberized", F.lit(False)).alias("uberized"),
        F.coalesce("mapsCompleted", F.lit(0)).alias("mapsCompleted"),
        F.coalesce("reducesCompleted", F.lit(0)).alias("reducesCompleted"),
        "diagnostics",
        "counters",
    )
    return out.withColumns(
        {
            "elapsedTime": gap("finishTime", "submitTime"),
            "runTime": gap("finishTime", "startTime"),
            "schedulingDelay": gap("startTime", "submitTime"),
        }
    )


def fold_events(events: DataFrame) -> dict[str, DataFrame]:
    """Jobs, tasks and attempts of a job-history event table."""
    return {"jobs": fold_jobs(events), "tasks": fold_tasks(events), "attempts": fold_attempts(events)}
