"""Delimited tables, database catalogs and landed document sets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import camel_case, iso_gmt_to_epoch
from ..operators.projections import flatten_struct, metric_name, plain_name, prefixed_name
from ..schemas import DOCUMENTS


def read_delimited(spark: SparkSession, path: str, schema: str = "a INT", sep: str = "\x01") -> DataFrame:
    """External text table."""
    return spark.read.schema(schema).option("sep", sep).csv(path)


def read_catalog(
    spark: SparkSession,
    jdbc_options: Mapping[str, str],
    query: str,
    partition: Mapping[str, str] | None = None,
) -> DataFrame:
    """Rows of a catalog query over JDBC.

    ``partition`` (partitionColumn, lowerBound, upperBound, numPartitions) splits large
    catalogs over executors; Spark then needs the query as a table expression.
    """
    reader = spark.read.format("jdbc").options(**jdbc_options)
    if partition:
        return reader.options(**partition).option("dbtable", f"({query}) q").load()
    return reader.option("query", query).load()


def read_docs(spark: SparkSession, path: str, doc_type: str) -> DataFrame:
    """Landed JSON documents of one type, with their fixed schema (no inference pass)."""
    return spark.read.schema(DOCUMENTS[doc_type]).json(path)


def spark_app_attempts(apps: DataFrame) -> DataFrame:
    """One row per application attempt, times in seconds."""
    rows = apps.select(F.col("id").alias("appId"), F.col("name").alias("appName"), F.explode("attempts").alias("a"))
    sec = {k: F.floor(F.col(f"a.{v}") / 1000).cast("bigint") for k, v in
           {"startTime": "startTimeEpoch", "endTime": "endTimeEpoch", "lastUpdated": "lastUpdatedEpoch"}.items()}
    out = rows.select(
        "appId", "appName", F.coalesce("a.attemptId", F.lit(0)).alias("appAttemptId"),
        "a.sparkUser", F.col("a.duration"), *[c.alias(n) for n, c in sec.items()],
    )
    return out.withColumns(
        {
            "submitTime": F.col("startTime"),
            "runTime": F.col("endTime") - F.col("startTime"),
            "elapsedTime": F.col("endTime") - F.col("startTime"),
            "schedulingDelay": F.lit(0).cast("bigint"),
        }
    )


def spark_stages(stages: DataFrame) -> DataFrame:
    """Stages with epoch-second times; a missing submission or launch falls back to the completion."""
    done = F.col("status").isin("COMPLETE", "FAILED")
    end = iso_gmt_to_epoch("completionTime")

    def or_end(col: str):
        return F.when(done, F.coalesce(iso_gmt_to_epoch(col), end))

    out = stages.withColumns(
        {
            "submissionTime": or_end("submissionTime"),
            "firstTaskLaunchedTime": or_end("firstTaskLaunchedTime"),
            "completionTime": F.when(done, end),
            "executorRunTime": F.when(done, F.coalesce("executorRunTime", F.lit(0))).otherwise(F.col("executorRunTime")),
        }
    ).withColumnsRenamed({"attemptId": "stageAttemptId", "name": "stageName"})
    return out.withColumns(
        {
            "runTime": F.col("completionTime") - F.col("firstTaskLaunchedTime"),
            "elapsedTime": F.col("completionTime") - F.col("submissionTime"),
            "schedulingDelay": F.col("firstTaskLaunchedTime") - F.col("submissionTime"),
        }
    )


def spark_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks with their metrics flattened; the end is the launch plus the executor run time."""
    flat = flatten_struct(tasks, "taskMetrics", metric_name)
    launch = iso_gmt_to_epoch("launchTime")
    out = flat.withColumns(
        {"launchTime": launch, "executorRunTime": F.coalesce("executorRunTime", F.lit(0))}
    ).withColumnRenamed("taskId", "sparkTaskId")
    run = F.floor(F.col("executorRunTime") / 1000).cast("bigint")
    return out.withColumns(
        {
            "endTime": F.col("launchTime") + run,
            "runTime": run,
            "elapsedTime": run,
            "schedulingDelay": F.lit(0).cast("bigint"),
        }
    )


def mr_jobs(jobs: DataFrame) -> DataFrame:
    """Job documents with second times (0 and absent become NULL) and derived durations."""
    sec = {
        c: F.when(F.col(c) > 0, F.floor(F.col(c) / 1000).cast("bigint"))
        for c in ("submitTime", "startTime", "finishTime")
    }
    means = {
        c: F.floor(F.col(c) / 1000).cast("bigint")
        for c in ("avgMapTime", "avgReduceTime", "avgShuffleTime", "avgMergeTime")
    }
    raw = {f"{c}Ms": F.col(c) for c in ("avgReduceTime", "avgShuffleTime", "avgMergeTime")}
    out = jobs.withColumns({**raw}).withColumns({**sec, **means}).withColumnRenamed("id", "jobId")
    return out.withColumns(
        {
            "endTime": F.col("finishTime"),
            "elapsedTime": F.col("finishTime") - F.col("submitTime"),
            "runTime": F.col("finishTime") - F.col("startTime"),
            "schedulingDelay": F.col("startTime") - F.col("submitTime"),
        }
    )


def mr_tasks(tasks: DataFrame) -> DataFrame:
    """Task documents with second times, divided once."""
    sec = {c: F.floor(F.col(c) / 1000).cast("bigint") for c in ("startTime", "finishTime", "elapsedTime")}
    out = tasks.withColumns(sec).withColumnRenamed("id", "taskId")
    run = F.when((F.col("startTime") > 0) & (F.col("finishTime") > 0), F.col("finishTime") - F.col("startTime"))
    return out.withColumns({"submitTime": F.col("startTime"), "endTime": F.col("finishTime"), "runTime": run})


def mr_job_counters(docs: DataFrame, names: Sequence[str], groups: str = "counterGroup") -> DataFrame:
    """Named job counters as ``<name>Total``, ``<name>Map`` and ``<name>Reduce`` columns."""
    flat = F.flatten(F.transform(F.col(groups), lambda g: g["counter"]))
    named = F.transform(flat, lambda c: F.struct(camel_case(c["name"]).alias("k"), c.alias("c")))
    out = {}
    for name in names:
        hits = F.filter(F.col("_counters"), lambda x: x["k"] == F.lit(name))
        hit = F.try_element_at(hits, F.lit(-1))["c"]
        for suffix, field in (("Total", "total"), ("Map", "map"), ("Reduce", "reduce")):
            out[f"{name}{suffix}"] = hit[f"{field}CounterValue"]
    return docs.withColumn("_counters", named).withColumns(out).drop("_counters", groups)


def spark_jobs(jobs: DataFrame) -> DataFrame:
    """Spark job documents with epoch-second times and durations."""
    out = jobs.withColumns(
        {"submitTime": iso_gmt_to_epoch("submissionTime"), "endTime": iso_gmt_to_epoch("completionTime")}
    ).withColumnRenamed("name", "jobName")
    run = F.col("endTime") - F.col("submitTime")
    return out.withColumns(
        {
            "startTime": F.col("submitTime"),
            "elapsedTime": run,
            "runTime": run,
            "schedulingDelay": F.lit(0).cast("bigint"),
        }
    ).drop("submissionTime", "completionTime")


def spark_executors(
    executors: DataFrame, memory_keys: Sequence[str] = (), log_keys: Sequence[str] = ("stdout", "stderr")
) -> DataFrame:
    """Executor documents with the wanted memory metrics and log links lifted to columns."""
    out = flatten_struct(executors, "memoryMetrics", plain_name, memory_keys)
    out = flatten_struct(out, "executorLogs", prefixed_name, log_keys)
    return out.withColumn("addTime", iso_gmt_to_epoch("addTime")).withColumnRenamed("id", "executorId")


def yarn_apps(apps: DataFrame) -> DataFrame:
    """Application documents with second times."""
    cols = [c for c in ("startedTime", "finishedTime", "elapsedTime", "submittedTime") if c in apps.columns]
    return apps.withColumns({c: F.floor(F.col(c) / 1000).cast("bigint") for c in cols})


def mr_attempts(attempts: DataFrame) -> DataFrame:
    """Attempt documents with second times."""
    cols = (
        "startTime", "finishTime", "elapsedTime", "shuffleFinishTime", "mergeFinishTime", "elapsedShuffleTime",
        "elapsedMergeTime", "elapsedReduceTime",
    )
    out = attempts.withColumns({c: F.floor(F.col(c) / 1000).cast("bigint") for c in cols})
    return out.withColumnsRenamed({"id": "taskAttemptId", "assignedContainerId": "containerId"})
