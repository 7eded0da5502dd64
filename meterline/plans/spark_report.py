"""Spark application analytics: tasks to stages to application attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import concurrency, concurrency_summary, scheduling_delay
from ..operators.joins import enrich
from ..operators.rollups import rollup_stages, rollup_tasks, total_cores

STAGE = ["appId", "appAttemptId", "stageId", "stageAttemptId"]
APP = ["appId", "appAttemptId"]
PLACE = ["appId", "stageId"]  # what rows are dealt out by: part of the keys of every join and group below
ROWS_PER_TASK = 500_000


def parts_for(spark: SparkSession, rows: int, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Partitions that hold about ``rows_per_task`` rows each, one a core at least."""
    return max(spark.sparkContext.defaultParallelism, -(-rows // rows_per_task))


def stage_concurrency(stages: DataFrame, tasks: DataFrame, step: int = 5) -> DataFrame:
    """Running tasks per time bucket of each completed stage that has tasks."""
    bounds = stages.filter("status = 'COMPLETE'").select(
        *STAGE, F.col("firstTaskLaunchedTime").alias("_from"), F.col("completionTime").alias("_to")
    )
    rows = tasks.select(*STAGE, "launchTime", "endTime").join(bounds, STAGE, "inner")
    return concurrency(rows, STAGE, "launchTime", "endTime", step, "_from", "_to")


def spark_report(
    apps: DataFrame, stages: DataFrame, tasks: DataFrame, executors: DataFrame, step: int = 5, n_tasks: int | None = None
) -> dict[str, DataFrame]:
    """Enriched application and stage tables and the concurrency points.

    A partition of tasks passes through some ten sorts and hash tables that are held at once, so both tables are dealt
    out by the number of tasks (``n_tasks``, counted where it is not given), not by the session's number of partitions.
    """
    parts = parts_for(tasks.sparkSession, tasks.count() if n_tasks is None else n_tasks)
    stages, tasks = stages.repartition(parts, *PLACE), tasks.repartition(parts, *PLACE)
    done = stages.filter("status = 'COMPLETE'")
    points = stage_concurrency(stages, tasks, step)
    rows = rollup_tasks(done, tasks, keys=STAGE)
    rows = scheduling_delay(
        rows, tasks, STAGE, "submissionTime", "completionTime", "launchTime", "endTime",
        min_rows=2, name="taskSchedulingDelay",
    )
    rows = enrich(rows, concurrency_summary(points, STAGE), STAGE)
    rows = enrich(rows, total_cores(executors, APP), APP)
    app_rows = rollup_stages(apps, rows, keys=APP)
    app_rows = scheduling_delay(
        app_rows, done, APP, "startTime", "endTime", "submissionTime", "completionTime",
        min_rows=2, name="stageSchedulingDelay",
    )
    return {"apps": app_rows, "stages": rows, "points": points}
