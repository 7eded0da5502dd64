"""Landed job histories, history-API documents and workflow documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.operators.history import fold_attempts, fold_jobs, fold_tasks
from meterline.plans.workflow_report import job_statistics, workflow_tables
from meterline.session import scratch_path
from meterline.sources.history import read_job_history
from meterline.sources.tables import mr_jobs, read_docs, spark_app_attempts, spark_stages, spark_tasks

from .common import TASKS, query, table, tasks


def _ms(col):
    return (F.unix_timestamp(col) * 1000 + 999).cast("bigint")


def _history_lines(spark, sf_dir):
    """One attempt per order: started, and finished, failed or left open by its status.

    Counter names occur in two groups and in two spellings, and some events are empty or cut off.
    """
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    start = _ms("o_orderdate")
    started = F.format_string(
        '{"type":"MAP_ATTEMPT_STARTED","event":{"org.x.TaskAttemptStarted":{"taskid":"t%d","attemptId":"a%d","taskType":"MAP",'
        '"startTime":%d,"containerId":"c%d","locality":{"string":"NODE_LOCAL"}}}}', cust, key, start, cust,
    )
    counters = F.format_string(
        '"counters":{"groups":[{"name":"old","counts":[{"name":"HDFS_BYTES_READ","value":1}]},{"name":"fs","counts":[{"name":"HDFS_BYTES_READ","value":%d}]},'
        '{"name":"t","counts":[{"name":"CPU_MILLISECONDS","value":6},{"name":"cpu_milliseconds","value":7}]}]}', key
    )
    finished = F.concat(
        F.format_string(
            '{"type":"MAP_ATTEMPT_FINISHED","event":{"org.x.MapAttemptFinished":{"taskid":"t%d","attemptId":"a%d","taskType":"MAP",'
            '"taskStatus":"SUCCEEDED","finishTime":%d,"hostname":"h%d","rackname":"/r","mapFinishTime":%d,', cust, key, start + cust * 1000, cust, start,
        ),
        counters, F.lit("}}}"),
    )
    failed = F.concat(
        F.format_string(
            '{"type":"MAP_ATTEMPT_FAILED","event":{"org.x.Unsuccessful":{"taskid":"t%d","attemptId":"a%d","taskType":"MAP",'
            '"status":"FAILED","finishTime":%d,"hostname":"h%d","rackname":"/r","error":"oops",', cust, key, start + 5000, cust,
        ),
        counters, F.lit("}}}"),
    )
    status = F.col("o_orderstatus")
    last = F.when(status == "O", finished).when(status == "F", failed).otherwise(F.lit('{"type":"JOB_QUEUE_CHANGED","event":{}}'))
    broken = ['{"type":"MAP_ATTEMPT_FINISHED","event":{}}', '{"type":"MAP_ATTEMPT_FINISHED","event":{"org.x', '{"type":"MAP_ATTEMPT_FINISHED"}']
    lines = F.array(F.lit("Avro-Json"), started, last, *[F.lit(x) for x in broken])
    return o.select(F.explode(lines).alias("value"))


@query(
    "history_attempts",
    """
SELECT 'a' || o_orderkey AS "taskAttemptId", 't' || o_custkey AS "taskId", 'MAP' AS type,
       CASE o_orderstatus WHEN 'O' THEN 'SUCCEEDED' WHEN 'F' THEN 'FAILED' ELSE 'KILLED' END AS state, s AS "startTime",
       CASE o_orderstatus WHEN 'O' THEN s + o_custkey WHEN 'F' THEN s + 5 ELSE -1 END AS "finishTime",
       CASE o_orderstatus WHEN 'O' THEN o_custkey WHEN 'F' THEN 5 ELSE -1 END AS "elapsedTime",
       'NODE_LOCAL' AS locality, CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS "hdfsBytesRead", CASE WHEN o_orderstatus <> 'P' THEN CAST(7 AS BIGINT) END AS cpu
FROM (SELECT *, CAST(epoch(o_orderdate) AS BIGINT) AS s FROM orders)""",
)
def history_attempts(spark, sf_dir):
    path = scratch_path(spark, "jhist")
    _history_lines(spark, sf_dir).write.text(path)
    # attempts of one job are spread over the written part files, so the file is not their key here
    events = read_job_history(spark, path).withColumn("job_file", F.lit("all"))
    out = fold_attempts(events)
    return out.select(
        "taskAttemptId", "taskId", "type", "state", "startTime", "finishTime", "elapsedTime", "locality",
        F.try_element_at("counters", F.lit("hdfsBytesRead")).alias("hdfsBytesRead"),
        F.try_element_at("counters", F.lit("cpuMilliseconds")).alias("cpu"),
    )


@query(
    "history_jobs_and_tasks",
    """
SELECT 'job' || c_custkey AS id, 'job' AS kind, CASE WHEN c_nationkey < 5 THEN 'KILLED' ELSE 'SUCCEEDED' END AS state, CAST(1000 + c_custkey AS BIGINT) AS "startTime",
       CAST(1000 + c_custkey + c_nationkey AS BIGINT) AS "finishTime", CASE WHEN c_nationkey >= 5 THEN c_custkey END AS counter, CAST(c_nationkey + 10 AS BIGINT) AS "elapsedTime" FROM customer
UNION ALL SELECT 'task' || c_custkey, 'task', 'SUCCEEDED', 1000 + c_custkey, 1000 + c_custkey + c_nationkey, c_custkey, c_nationkey FROM customer""",
)
def history_jobs(spark, sf_dir):
    cust, nat = F.col("c_custkey"), F.col("c_nationkey")
    groups = F.format_string('{"groups":[{"counts":[{"name":"HDFS_BYTES_READ","value":0}]},{"counts":[{"name":"HDFS_BYTES_READ","value":%d}]}]}', cust)
    submit = F.format_string('{"type":"JOB_SUBMITTED","event":{"S":{"jobid":"job%d","jobName":"n","userName":"u","submitTime":%d,"jobQueueName":"q"}}}', cust, (cust + 990) * 1000)
    init = F.format_string('{"type":"JOB_INITED","event":{"I":{"jobid":"job%d","launchTime":%d,"totalMaps":3,"totalReduces":1,"uberized":false}}}', cust, (cust + 1000) * 1000)
    done = F.format_string(
        '{"type":"JOB_FINISHED","event":{"F":{"jobid":"job%d","finishTime":%d,"finishedMaps":3,"finishedReduces":1,"totalCounters":%s,"mapCounters":{"groups":[]},"reduceCounters":{"groups":[]}}}}',
        cust, (cust + 1000 + nat) * 1000, groups,
    )
    killed = F.format_string(
        '{"type":"JOB_KILLED","event":{"U":{"jobid":"job%d","finishTime":%d,"finishedMaps":1,"finishedReduces":0,"jobStatus":"KILLED","diagnostics":"d"}}}', cust, (cust + 1000 + nat) * 1000
    )
    t_start = F.format_string('{"type":"TASK_STARTED","event":{"T":{"taskid":"task%d","taskType":"MAP","startTime":%d}}}', cust, (cust + 1000) * 1000)
    t_end = F.format_string(
        '{"type":"TASK_FINISHED","event":{"T":{"taskid":"task%d","taskType":"MAP","finishTime":%d,"status":"SUCCEEDED","successfulAttemptId":{"string":"a1"},"counters":%s}}}',
        cust, (cust + 1000 + nat) * 1000, groups,
    )
    lines = F.array(F.lit("Avro-Json"), submit, init, F.when(nat < 5, killed).otherwise(done), t_start, t_end, F.lit('{"type":"JOB_FINISHED","event":{}}'))
    path = scratch_path(spark, "jhist")
    table(spark, sf_dir, "customer").select(F.explode(lines).alias("value")).write.text(path)
    events = read_job_history(spark, path).withColumn("job_file", F.lit("all"))
    jobs = fold_jobs(events).select(
        F.col("jobId").alias("id"), F.lit("job").alias("kind"), "state", "startTime", "finishTime",
        F.try_element_at("counters", F.lit("hdfsBytesReadTotal")).alias("counter"), "elapsedTime",
    )
    work = fold_tasks(events).select(
        F.col("taskId").alias("id"), F.lit("task").alias("kind"), "state", "startTime", "finishTime",
        F.try_element_at("counters", F.lit("hdfsBytesRead")).alias("counter"), "elapsedTime",
    )
    return jobs.unionByName(work)


@query(
    "landed_job_documents",
    """
SELECT 'job_' || o_orderkey AS "jobId", s AS "submitTime", CASE WHEN o_orderstatus <> 'P' THEN s + 3 END AS "startTime", s + 90 AS "finishTime", o_custkey // 1000 AS "avgMapTime",
       CASE WHEN o_orderstatus <> 'P' THEN CAST(87 AS BIGINT) END AS "runTime", CAST(90 AS BIGINT) AS "elapsedTime" FROM (SELECT *, CAST(epoch(o_orderdate) AS BIGINT) AS s FROM orders)""",
)
def landed_jobs(spark, sf_dir):
    """History-API job documents landed as JSON."""
    ms = F.unix_timestamp("o_orderdate") * 1000
    path = scratch_path(spark, "mr-jobs")
    table(spark, sf_dir, "orders").select(
        F.concat(F.lit("job_"), F.col("o_orderkey").cast("string")).alias("id"), (ms + 10).alias("submitTime"),
        F.when(F.col("o_orderstatus") == "P", F.lit(0)).otherwise(ms + 3500).alias("startTime"), (ms + 90999).alias("finishTime"),
        F.col("o_custkey").alias("avgMapTime"),
    ).write.json(path)
    out = mr_jobs(read_docs(spark, path, "mr_job"))
    return out.select("jobId", "submitTime", "startTime", "finishTime", "avgMapTime", "runTime", "elapsedTime")


@query(
    "landed_spark_documents",
    """
SELECT 'stage' AS kind, o_orderkey AS id, s AS a, CASE WHEN o_orderstatus = 'F' THEN s + 60 ELSE s + 5 END AS b, s + 60 AS c, CAST(o_custkey AS BIGINT) AS metric FROM (SELECT *, CAST(epoch(o_orderdate) AS BIGINT) AS s FROM orders)
UNION ALL SELECT 'task', o_orderkey, s, s + o_custkey, NULL, o_custkey * 3 FROM (SELECT *, CAST(epoch(o_orderdate) AS BIGINT) AS s FROM orders)
UNION ALL SELECT 'app', o_orderkey, s, s + 60, NULL, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 2 END FROM (SELECT *, CAST(epoch(o_orderdate) AS BIGINT) AS s FROM orders)""",
)
def landed_spark(spark, sf_dir):
    """Spark stage, task and application documents landed as JSON."""
    o = table(spark, sf_dir, "orders")
    s = F.unix_timestamp("o_orderdate")

    def iso(sec):
        return F.concat(F.date_format(F.timestamp_seconds(sec), "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("GMT"))

    stage_path, task_path, app_path = (scratch_path(spark, n) for n in ("stages", "tasks", "apps"))
    update = F.struct(F.lit("internal.metrics.resultSize").alias("name"), F.col("o_custkey").cast("string").alias("value"))
    o.select(
        F.col("o_orderkey").cast("int").alias("stageId"), F.lit(0).alias("attemptId"), F.lit("n").alias("name"), F.lit("COMPLETE").alias("status"),
        iso(s).alias("submissionTime"), F.when(F.col("o_orderstatus") != "F", iso(s + 5)).alias("firstTaskLaunchedTime"), iso(s + 60).alias("completionTime"),
        F.array(update).alias("accumulatorUpdates"),
    ).write.json(stage_path)
    o.select(
        F.col("o_orderkey").alias("taskId"), iso(s).alias("launchTime"),
        F.struct((F.col("o_custkey") * 1000 + 7).alias("executorRunTime"), F.struct((F.col("o_custkey") * 3).alias("recordsRead")).alias("shuffleReadMetrics")).alias("taskMetrics"),
    ).write.json(task_path)
    attempt = F.struct(
        F.when(F.col("o_orderstatus") != "F", F.lit(2)).alias("attemptId"), (s * 1000 + 500).alias("startTimeEpoch"), ((s + 60) * 1000).alias("endTimeEpoch"), F.lit(1).alias("duration")
    )
    o.select(F.col("o_orderkey").cast("string").alias("id"), F.lit("app").alias("name"), F.array(attempt).alias("attempts")).write.json(app_path)

    from meterline.operators.projections import name_values_to_columns

    stages = spark_stages(read_docs(spark, stage_path, "spark_stage"))
    stages = name_values_to_columns(stages, "accumulatorUpdates", {"resultSize": "bigint"})
    work = spark_tasks(read_docs(spark, task_path, "spark_task"))
    apps = spark_app_attempts(read_docs(spark, app_path, "spark_app"))
    none = F.lit(None).cast("bigint")
    return (
        stages.select(F.lit("stage").alias("kind"), F.col("stageId").cast("bigint").alias("id"), F.col("submissionTime").alias("a"),
                      F.col("firstTaskLaunchedTime").alias("b"), F.col("completionTime").alias("c"), F.col("resultSize").alias("metric"))
        .unionByName(work.select(F.lit("task").alias("kind"), F.col("sparkTaskId").alias("id"), F.col("launchTime").alias("a"), F.col("endTime").alias("b"),
                                 none.alias("c"), F.col("shuffleReadRecordsRead").alias("metric")))
        .unionByName(apps.select(F.lit("app").alias("kind"), F.col("appId").cast("bigint").alias("id"), F.col("startTime").alias("a"), F.col("endTime").alias("b"),
                                 none.alias("c"), F.col("appAttemptId").cast("bigint").alias("metric")))
    )


@query(
    "workflow_documents",
    """
SELECT c_custkey, CAST(epoch(o_orderdate) AS BIGINT) + 14400 AS "startTime", CAST(epoch(o_orderdate) AS BIGINT) + 14400 AS "wfStart", 'job_' || o_orderkey AS "externalId"
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'""",
)
def workflow_docs(spark, sf_dir):
    """Workflow documents with one action each, times as zoned text."""
    wall = F.concat(F.date_format(F.col("o_orderdate").cast("timestamp"), "E, dd MMM yyyy HH:mm:ss"), F.lit(" EDT"))
    status = F.when(F.col("o_orderstatus") == "O", "SUCCEEDED").when(F.col("o_orderstatus") == "F", "KILLED").otherwise("RUNNING")
    action = F.struct(
        F.concat(F.col("o_custkey").cast("string"), F.lit("@a")).alias("id"), F.lit("a").alias("name"), F.lit("hive").alias("type"), F.lit("OK").alias("status"),
        F.concat(F.lit("job_"), F.col("o_orderkey").cast("string")).alias("externalId"), F.lit("").alias("externalChildIDs"), wall.alias("startTime"), wall.alias("endTime"),
    )
    path = scratch_path(spark, "workflows")
    table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.lit("w").alias("appName"), status.alias("status"), wall.alias("createdTime"), wall.alias("startTime"),
        wall.alias("endTime"), F.array(action).alias("actions"),
    ).write.json(path)
    wf, wfa = workflow_tables(read_docs(spark, path, "workflow"))
    both = wfa.join(wf.select("wfId", F.col("startTime").alias("wfStart")), "wfId")
    return both.select(F.regexp_extract("wfaId", r"^(\d+)", 1).cast("bigint").alias("c_custkey"), "startTime", "wfStart", "externalId")


@query(
    "job_statistics",
    f"""
WITH {TASKS}
SELECT jobId, count(*) FILTER (WHERE type = 'MAP' AND state = 'SUCCEEDED') AS "successfulMapAttempts",
       count(*) FILTER (WHERE type = 'MAP' AND state = 'FAILED') AS "failedMapAttempts", count(*) FILTER (WHERE type = 'MAP' AND state = 'KILLED') AS "killedMapAttempts",
       count(*) FILTER (WHERE type = 'REDUCE' AND state = 'SUCCEEDED') AS "successfulReduceAttempts",
       count(*) FILTER (WHERE type = 'REDUCE' AND state = 'FAILED') AS "failedReduceAttempts", count(*) FILTER (WHERE type = 'REDUCE' AND state = 'KILLED') AS "killedReduceAttempts"
FROM tasks GROUP BY 1""",
)
def job_stats(spark, sf_dir):
    """Attempt outcomes of each job as ``job_statistics`` gives them; its wait times, stragglers and
    points are checked by queries of their own."""
    rows = tasks(spark, sf_dir)
    jobs = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("jobId"), F.lit(780000000).cast("bigint").alias("submitTime"), F.lit(780000000).cast("bigint").alias("startTime"),
        F.lit(1100000000).cast("bigint").alias("finishTime"), F.lit(1).alias("mapsTotal"),
    )
    out = job_statistics(jobs, rows)["jobs"]
    return out.select("jobId", *[f"{s}{k}Attempts" for k in ("Map", "Reduce") for s in ("successful", "failed", "killed")])
