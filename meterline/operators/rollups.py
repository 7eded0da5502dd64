"""Task to stage to application, and job to action to workflow roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import sums_by_category
from .slices import same_keys

# Task metrics summed per stage.
TASK_METRICS = [
    "jvmGcTime",
    "shuffleReadRemoteBlocksFetched",
    "shuffleReadLocalBlocksFetched",
    "shuffleReadFetchWaitTime",
    "shuffleReadRemoteBytesRead",
    "shuffleReadRemoteBytesReadToDisk",
    "shuffleReadLocalBytesRead",
    "shuffleReadRecordsRead",
    "shuffleWriteWriteTime",
    "shuffleWriteRecordsWritten",
    "executorDeserializeTime",
    "executorDeserializeCpuTime",
    "resultSerializationTime",
    "resultSize",
    "isStraggler",
]

# Stage metrics summed per application.
STAGE_METRICS = [
    "jvmGcTime",
    "shuffleReadRemoteBlocksFetched",
    "shuffleReadLocalBlocksFetched",
    "shuffleReadFetchWaitTime",
    "shuffleReadRemoteBytesRead",
    "shuffleReadRemoteBytesReadToDisk",
    "shuffleReadLocalBytesRead",
    "shuffleReadRecordsRead",
    "shuffleWriteWriteTime",
    "shuffleWriteRecordsWritten",
    "numTasks",
    "numFailedTasks",
    "numKilledTasks",
    "inputBytes",
    "outputBytes",
    "inputRecords",
    "outputRecords",
    "shuffleReadBytes",
    "shuffleWriteBytes",
    "memoryBytesSpilled",
    "executorRunTime",
    "executorCpuTime",
    "diskBytesSpilled",
    "resultSerializationTime",
    "executorDeserializeTime",
    "executorDeserializeCpuTime",
    "taskSchedulingDelay",
    "resultSize",
    "isStraggler",
]

# What counts as processed data, in bytes.
PROCESSED_BYTES = ["inputBytes", "outputBytes", "shuffleWriteBytes", "shuffleReadBytes", "resultSize"]

# Locality classes with a sum of their own.
LOCALITY_SUMS = {
    "OFF_SWITCH": "offSwitchHdfsBytesReadTotal",
    "RACK_LOCAL": "rackLocalHdfsBytesReadTotal",
    "NODE_LOCAL": "nodeLocalHdfsBytesReadTotal",
}


def _or_zero(df: DataFrame, name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0)) if name in df.columns else F.lit(0)


def total_cores(executors: DataFrame, keys: Sequence[str] = ("appId", "appAttemptId")) -> DataFrame:
    return executors.groupBy(*keys).agg(F.sum(F.coalesce("totalCores", F.lit(0))).alias("totalCores"))


def rollup_tasks(
    stages: DataFrame,
    tasks: DataFrame,
    metrics: Sequence[str] = tuple(TASK_METRICS),
    keys: Sequence[str] = ("appId", "stageId", "stageAttemptId"),
) -> DataFrame:
    """Stages with the sums of their tasks' metrics; 0 where a stage has no tasks.

    Tasks are reduced map-side to one row per stage before the join.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    sums = tasks.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(
        *[F.sum(_or_zero(tasks, m)).alias(f"_s_{m}") for m in metrics]
    )
    joined = stages.join(sums, same_keys(keys, names), "left")
    out = {m: F.coalesce(F.col(f"_s_{m}"), F.lit(0)) for m in metrics}
    if "numCompleteTasks" in stages.columns:
        done = _or_zero(stages, "numCompleteTasks") + _or_zero(stages, "numFailedTasks")
        out["numTasks"] = F.coalesce("numTasks", done) if "numTasks" in stages.columns else done
    return joined.withColumns(out).drop(*names, *[f"_s_{m}" for m in metrics])


def rollup_stages(
    apps: DataFrame,
    stages: DataFrame,
    metrics: Sequence[str] = tuple(STAGE_METRICS),
    keys: Sequence[str] = ("appId", "appAttemptId"),
) -> DataFrame:
    """Applications with sums over their stages, parallelism extremes, stage count and processed MB."""
    names = [f"_k{i}" for i in range(len(keys))]
    parallel = {"maxParallelTasks": F.max, "minParallelTasks": F.min}
    # attempts of one stage are folded first: the distinct stage count is then a plain count
    per_stage = stages.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], "stageId").agg(
        *[F.sum(_or_zero(stages, m)).alias(f"_s_{m}") for m in metrics],
        *[f(_or_zero(stages, m)).alias(f"_s_{m}") for m, f in parallel.items()],
        F.max(_or_zero(stages, "totalCores")).alias("_s_totalCores"),
    )
    sums = per_stage.groupBy(*names).agg(
        *[F.sum(f"_s_{m}").alias(f"_s_{m}") for m in metrics],
        *[f(f"_s_{m}").alias(f"_s_{m}") for m, f in parallel.items()],
        F.max("_s_totalCores").alias("_s_totalCores"),
        F.count(F.lit(1)).alias("_s_numStages"),
    )
    filled = [*metrics, *parallel, "totalCores", "numStages"]
    joined = apps.join(sums, same_keys(keys, names), "left")
    out = joined.withColumns({m: F.coalesce(F.col(f"_s_{m}"), F.lit(0)) for m in filled})
    have = [m for m in PROCESSED_BYTES if m in metrics]
    if have:
        processed = sum((F.col(m) for m in have[1:]), F.col(have[0]))
        out = out.withColumn("dataProc", F.floor(processed / F.lit(1048576)).cast("bigint"))
    return out.drop(*names, *[f"_s_{m}" for m in filled])


def rollup_workflow(
    workflows: DataFrame,
    actions: DataFrame,
    jobs: DataFrame,
    attempts: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Workflow and action tables with the sums and weighted means of their jobs.

    ``workflows``: wfId, startTime, endTime. ``actions``: wfId, wfaId, startTime, endTime,
    externalChildIDs. ``jobs``: jobId, wfId, wfaId, position, submitTime, startTime,
    finishTime and the job metrics. ``attempts``: jobId, locality, hdfsBytesRead.
    Times are epoch seconds.

    Jobs count only with a start and a finish; actions only with a start; workflows only
    with both ends. Locality sums ignore the job test. A launcher (position 0 of an action
    with child jobs) is left out of the run time, and action totals exist only when some
    other job remains. Sums go job to action to workflow, so the second step reads one row
    per action.
    """
    live_wf = workflows.filter(F.col("startTime").isNotNull() & F.col("endTime").isNotNull())
    live_wfa = actions.filter(F.col("startTime") > 0).join(live_wf.select("wfId"), ["wfId"], "left_semi")

    rows = jobs
    local = list(LOCALITY_SUMS.values())
    if attempts is not None:
        by_job = sums_by_category(attempts, ["jobId"], "locality", "hdfsBytesRead", LOCALITY_SUMS)
        rows = rows.join(by_job, ["jobId"], "left")
    else:
        rows = rows.withColumns({n: F.lit(0) for n in local})

    head = live_wfa.select(
        "wfId",
        "wfaId",
        F.col("startTime").alias("_a_start"),
        F.coalesce(~F.trim("externalChildIDs").isin("", "-"), F.lit(False)).alias("_has_child"),
    )
    rows = rows.join(head, ["wfId", "wfaId"], "inner")
    counted = (F.col("finishTime") > 0) & (F.col("startTime") > 0)
    run = counted & ~((F.col("position") == 0) & F.col("_has_child"))

    def add(col: Column) -> Column:
        return F.coalesce(F.sum(F.when(counted, col)), F.lit(0))

    def weighted(avg: str, n: str) -> Column:
        if f"{avg}Ms" in jobs.columns:
            return F.floor(F.col(f"{avg}Ms") * F.col(n) / 1000).cast("bigint")
        return F.floor(F.col(avg) * F.col(n)).cast("bigint")

    plain = {
        "hdfsBytesReadTotal": "hdfsBytesReadTotal",
        "waitTimeTotal": "waitTime",
        "cpuMillisecondsTotal": "cpuMillisecondsTotal",
        "mapsTotal": "mapsTotal",
        "reducesTotal": "reducesTotal",
        "killedReduceAttempts": "killedReduceAttempts",
        "killedMapAttempts": "killedMapAttempts",
    }
    products = {
        "_w_map": weighted("avgMapTime", "mapsTotal") if "avgMapTimeMs" in jobs.columns
        else F.col("avgMapTime") * F.col("mapsTotal"),
        "_w_reduce": weighted("avgReduceTime", "reducesTotal"),
        "_w_shuffle": weighted("avgShuffleTime", "reducesTotal"),
        "_w_merge": weighted("avgMergeTime", "reducesTotal"),
    }
    additive = [*plain, *local, *products]
    per_action = rows.groupBy("wfId", "wfaId").agg(
        *[add(_or_zero(jobs, src)).alias(out) for out, src in plain.items()],
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in local],
        *[add(p).alias(n) for n, p in products.items()],
        F.sum(F.when(run, F.col("finishTime") - F.col("startTime"))).alias("_runtime"),
        F.min_by(F.when(run, F.col("submitTime")), F.when(run, F.col("position"))).alias("_submit"),
    )

    def with_means(df: DataFrame) -> DataFrame:
        def mean(total: str, n: str) -> Column:
            return F.when(F.col(n) > 0, F.floor(F.col(total) / F.col(n)).cast("bigint"))

        return df.withColumns(
            {
                "weightedAvgMapTime": mean("_w_map", "mapsTotal"),
                "weightedAvgReduceTime": mean("_w_reduce", "reducesTotal"),
                "weightedAvgShuffleTime": mean("_w_shuffle", "reducesTotal"),
                "weightedAvgMergeTime": mean("_w_merge", "reducesTotal"),
            }
        ).drop(*products)

    per_wf = with_means(per_action.groupBy("wfId").agg(*[F.sum(n).alias(n) for n in additive]))
    out_wf = live_wf.join(per_wf, ["wfId"], "left").fillna(0, [*plain, *local])

    totals = with_means(per_action)
    shown = [*plain, *local, "weightedAvgMapTime", "weightedAvgReduceTime", "weightedAvgShuffleTime",
             "weightedAvgMergeTime"]
    has_run = F.col("_runtime").isNotNull()
    totals = totals.withColumns({n: F.when(has_run, F.col(n)) for n in shown})
    out_wfa = live_wfa.join(totals, ["wfId", "wfaId"], "left").withColumns(
        {
            "submitDelay": F.coalesce(F.col("_submit") - F.col("startTime"), F.lit(0)),
            "jobDelay": F.when(
                has_run & (F.col("endTime") > 0), F.col("endTime") - F.col("startTime") - F.col("_runtime")
            ).otherwise(F.lit(0)),
        }
    )
    return out_wf, out_wfa.drop("_runtime", "_submit")


def workflow_delays(workflows: DataFrame, actions: DataFrame, jobs: DataFrame) -> DataFrame:
    """``wfSchedulingDelay`` over actions and ``jobSchedulingDelay`` over jobs of each workflow.

    Of an action with several jobs the launcher (position 0) is dropped from the job path.
    """
    from .intervals import scheduling_delay

    live = workflows.filter(F.col("startTime").isNotNull() & F.col("endTime").isNotNull())
    counts = jobs.groupBy(F.col("wfId").alias("_w"), F.col("wfaId").alias("_a")).agg(
        F.count(F.lit(1)).alias("_jobs")
    )
    used = jobs.join(counts, same_keys(["wfId", "wfaId"], ["_w", "_a"]), "left").filter(
        ~((F.col("_jobs") > 1) & (F.col("position") == 0))
    )
    out = scheduling_delay(
        live, actions, ["wfId"], "startTime", "endTime", "startTime", "endTime",
        min_rows=1, skip_open=False, name="wfSchedulingDelay",
    )
    return scheduling_delay(
        out, used, ["wfId"], "startTime", "endTime", "startTime", "finishTime",
        min_rows=1, skip_open=False, name="jobSchedulingDelay",
    )
