"""Group aggregates and hierarchy roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.functions import hit_ratio
from meterline.operators.aggregates import (
    attempt_ratios,
    attempt_outcomes,
    cpu_topology,
    entity_totals,
    mean_of_ratios,
    pricing_summary,
    rollup_sizes,
    sums_by_category,
    tasks_per,
    with_aggregate_row,
)
from meterline.operators.rollups import (
    LOCALITY_SUMS,
    rollup_stages,
    rollup_tasks,
    rollup_workflow,
    total_cores,
    workflow_delays,
)
from meterline.operators.slices import row_number_within
from meterline.plans.device_report import disk_report
from meterline.plans.spark_report import parts_for, spark_report

from .common import SAMPLES, TASKS, query, round2, samples, table, tasks


@query(
    "pricing_summary",
    """
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS count_order FROM lineitem
WHERE l_shipdate <= TIMESTAMP '1998-09-16' GROUP BY 1, 2 ORDER BY 1, 2""",
)
def pricing(spark, sf_dir):
    return pricing_summary(table(spark, sf_dir, "lineitem"))


@query(
    "attempt_outcomes",
    f"""
WITH {TASKS}
SELECT jobId,
 count(*) FILTER (WHERE type='MAP' AND state='SUCCEEDED') AS "successfulMapAttempts", count(*) FILTER (WHERE type='MAP' AND state='FAILED') AS "failedMapAttempts",
 count(*) FILTER (WHERE type='MAP' AND state='KILLED') AS "killedMapAttempts", count(*) FILTER (WHERE type='REDUCE' AND state='SUCCEEDED') AS "successfulReduceAttempts",
 count(*) FILTER (WHERE type='REDUCE' AND state='FAILED') AS "failedReduceAttempts", count(*) FILTER (WHERE type='REDUCE' AND state='KILLED') AS "killedReduceAttempts",
 coalesce(CAST(trunc(avg(elapsedTime) FILTER (WHERE type='MAP' AND state='SUCCEEDED')) AS BIGINT), 0) AS "avgMapTime",
 coalesce(CAST(trunc(avg(elapsedShuffleTime) FILTER (WHERE type='REDUCE' AND state='SUCCEEDED')) AS BIGINT), 0) AS "avgShuffleTime",
 coalesce(CAST(trunc(avg(elapsedMergeTime) FILTER (WHERE type='REDUCE' AND state='SUCCEEDED')) AS BIGINT), 0) AS "avgMergeTime",
 coalesce(CAST(trunc(avg(elapsedReduceTime) FILTER (WHERE type='REDUCE' AND state='SUCCEEDED')) AS BIGINT), 0) AS "avgReduceTime"
FROM tasks GROUP BY 1""",
)
def outcomes(spark, sf_dir):
    return attempt_outcomes(tasks(spark, sf_dir))


@query(
    "ratios_of_sums",
    f"""
WITH {TASKS},
s AS (SELECT jobId, sum(elapsedShuffleTime) AS sh, sum(elapsedMergeTime) AS mg, sum(elapsedTime * 86400) AS el, sum(hdfsBytesRead) AS b,
             sum(finishTime - startTime) AS busy, sum(elapsedTime) AS sp, sum(elapsedReduceTime) AS o FROM tasks GROUP BY 1)
SELECT jobId, CAST(sp AS DOUBLE) / o AS "mapperSpill", CAST(2 * sh AS DOUBLE) / (el - sh - mg) AS "shuffleRatio",
       CAST(b AS DOUBLE) / busy AS "mapSpeed", CAST(2 * mg AS DOUBLE) / (el - sh - mg) AS "sortRatio" FROM s""",
)
def ratios(spark, sf_dir):
    rows = tasks(spark, sf_dir).withColumns(
        {
            "spilledRecords": F.col("elapsedTime"), "mapOutputRecords": F.col("elapsedReduceTime"),
            "elapsedTime": F.col("elapsedTime") * 86400,
        }
    )
    return attempt_ratios(rows)


@query(
    "tasks_per_node",
    f"""
WITH {TASKS} SELECT jobId, node, count(*) FILTER (WHERE type='MAP') AS "mapTasks", count(*) FILTER (WHERE type='REDUCE') AS "reduceTasks",
       count(*) AS "totalTasks" FROM tasks GROUP BY 1, 2""",
)
def per_node(spark, sf_dir):
    return tasks_per(tasks(spark, sf_dir), ["jobId"], "node")


@query(
    "tasks_per_start",
    f"""
WITH {TASKS} SELECT jobId, startTime, count(*) FILTER (WHERE type='MAP') AS "mapTasks", count(*) FILTER (WHERE type='REDUCE') AS "reduceTasks",
       count(*) AS "totalTasks" FROM tasks GROUP BY 1, 2""",
)
def per_start(spark, sf_dir):
    return tasks_per(tasks(spark, sf_dir), ["jobId"], "startTime")


@query(
    "locality_sums",
    f"""
WITH {TASKS} SELECT jobId, CAST(coalesce(sum(hdfsBytesRead) FILTER (WHERE locality='OFF_SWITCH'), 0) AS BIGINT) AS "offSwitchHdfsBytesReadTotal",
 CAST(coalesce(sum(hdfsBytesRead) FILTER (WHERE locality='RACK_LOCAL'), 0) AS BIGINT) AS "rackLocalHdfsBytesReadTotal",
 CAST(coalesce(sum(hdfsBytesRead) FILTER (WHERE locality='NODE_LOCAL'), 0) AS BIGINT) AS "nodeLocalHdfsBytesReadTotal" FROM tasks GROUP BY 1""",
)
def locality(spark, sf_dir):
    return sums_by_category(tasks(spark, sf_dir), ["jobId"], "locality", "hdfsBytesRead", LOCALITY_SUMS)


@query(
    "aggregate_row",
    """
WITH d AS (SELECT l_suppkey AS host, l_returnflag AS dev, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2)
SELECT host, dev, q FROM d UNION ALL SELECT host, 'aggregate', CAST(sum(q) AS BIGINT) FROM d WHERE dev <> 'N' GROUP BY 1""",
)
def aggregate_row(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("host"), F.col("l_returnflag").alias("dev"))
    rows = rows.agg(F.sum("l_quantity").cast("bigint").alias("q"))
    return with_aggregate_row(rows, ["host"], "dev", ["q"], F.col("dev") != "N")


@query(
    "size_rollup",
    """
WITH o AS (SELECT n_regionkey AS server, c_nationkey AS db, c_mktsegment AS tbl, CAST(round(o_totalprice * 100) AS BIGINT) AS bytes
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT server, db, tbl, CAST(3 - grouping(server) - grouping(db) - grouping(tbl) AS INTEGER) AS level, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS entities
FROM o GROUP BY ROLLUP (server, db, tbl)""",
)
def size_rollup(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("bytes"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", F.col("c_mktsegment").alias("tbl"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("server"))
    rows = o.join(c, "o_custkey").join(n, "c_nationkey").withColumnRenamed("c_nationkey", "db")
    out = rollup_sizes(rows, ["server", "db", "tbl"], ["bytes"])
    return out.withColumn("level", F.col("level").cast("int"))


@query(
    "entity_totals",
    "SELECT s_nationkey, count(*) AS entities, CAST(sum(s_suppkey) AS BIGINT) AS total_s_suppkey FROM supplier GROUP BY 1",
)
def totals(spark, sf_dir):
    return entity_totals(table(spark, sf_dir, "supplier"), ["s_nationkey"], ["s_suppkey"])


@query(
    "hit_ratio",
    f"""
SELECT l_suppkey, CASE WHEN h + m = 0 THEN 0.0 ELSE {round2("h", "h + m", 100)} END AS pct,
       CASE WHEN h + m = 0 THEN 0.0 ELSE {round2("h", "h + m")} END AS share
FROM (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'A') AS h, count(*) FILTER (WHERE l_returnflag = 'R') AS m FROM lineitem GROUP BY 1)""",
)
def ratio_of_hits(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count_if(F.col("l_returnflag") == "A").alias("h"), F.count_if(F.col("l_returnflag") == "R").alias("m")
    )
    return rows.select("l_suppkey", hit_ratio("h", "m").alias("pct"), hit_ratio("h", "m", 1).alias("share"))


@query(
    "mean_of_ratios",
    f"""
WITH {SAMPLES}, s AS (SELECT event_type, user_id, CAST(sum(k) AS BIGINT) AS h, CAST(sum(CASE WHEN k > 50 THEN k ELSE 0 END) AS BIGINT) AS m FROM samples GROUP BY 1, 2)
SELECT event_type, round(coalesce(avg(CASE WHEN h + m > 0 THEN 100.0::DOUBLE * h / (h + m) END), 0), 2) AS hit_ratio FROM s GROUP BY 1""",
)
def mean_ratio(spark, sf_dir):
    rows = samples(spark, sf_dir).groupBy("event_type", "user_id").agg(
        F.sum("k").alias("h"), F.sum(F.when(F.col("k") > 50, F.col("k")).otherwise(0)).alias("m")
    )
    return mean_of_ratios(rows, ["event_type"], "h", "m")


@query(
    "cpu_topology",
    f"""
SELECT l_suppkey AS host, string_agg(DISTINCT 'model' || l_returnflag, ',' ORDER BY 'model' || l_returnflag) AS "cpuType",
       {round2("sum(l_linenumber)", "count(*)")} AS clock, count(DISTINCT l_linenumber) AS "totalCores",
       count(DISTINCT l_linestatus) AS sockets, count(DISTINCT l_quantity) AS "logicalCpus",
       CASE WHEN count(DISTINCT l_linenumber) * count(DISTINCT l_linestatus) * 2 = count(DISTINCT l_quantity) THEN 'On' ELSE 'off' END AS "hyperThreading"
FROM lineitem GROUP BY 1""",
)
def topology(spark, sf_dir):
    """CPU listings of a host per supplier, one block per line item."""
    def line(key, value, no):
        return F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"), no.alias("line_no"))

    rank = F.ascii("l_returnflag").cast("bigint")
    block = F.array(
        line("processor", F.col("l_quantity"), rank), line("physical id", F.col("l_linestatus"), rank),
        line("core id", F.col("l_linenumber"), rank), line("cpu MHz", F.col("l_linenumber"), rank),
        line("model name", F.concat(F.lit("model"), F.col("l_returnflag")), rank), line("flags", F.lit("x"), rank),
    )
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("host"), F.explode(block).alias("x"))
    return cpu_topology(rows.select("host", "x.*"))


@query(
    "executor_cores",
    """SELECT c_nationkey AS "appId", CAST(sum(c_custkey % 8) AS BIGINT) AS "totalCores" FROM customer GROUP BY 1""",
)
def executor_cores(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("appId"), (F.col("c_custkey") % 8).alias("totalCores"))
    return total_cores(rows, ["appId"])


STAGES = """
stages AS (SELECT o_custkey % 50 AS appId, o_orderkey AS stageId, o_orderkey * 10 AS inputBytes, 5 AS numFailedTasks, o_orderkey % 9 AS maxParallelTasks,
                  o_orderkey % 4 + 1 AS minParallelTasks, CAST(o_custkey AS BIGINT) AS totalCores FROM orders),
sums AS (SELECT l_orderkey AS stageId, CAST(sum(l_quantity) AS BIGINT) AS jvmGcTime, CAST(sum(l_partkey * 1000) AS BIGINT) AS resultSize, count(*) AS n FROM lineitem GROUP BY 1)"""


def _stages(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 50).alias("appId"), key.alias("stageId"), (key * 10).alias("inputBytes"),
        F.lit(5).alias("numFailedTasks"), (key % 9).alias("maxParallelTasks"), (key % 4 + 1).alias("minParallelTasks"),
        F.col("o_custkey").alias("totalCores"), F.when(key % 3 == 0, F.lit(100)).alias("numTasks"), F.lit(40).alias("numCompleteTasks"),
    )


def _stage_tasks(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("stageId"), F.col("l_quantity").cast("bigint").alias("jvmGcTime"), (F.col("l_partkey") * 1000).alias("resultSize")
    )


@query(
    "task_rollup",
    f"""
WITH {STAGES}
SELECT stageId AS "stageId", coalesce(jvmGcTime, 0) AS "jvmGcTime", coalesce(resultSize, 0) AS "resultSize",
       CAST(CASE WHEN stageId % 3 = 0 THEN 100 ELSE 45 END AS INTEGER) AS "numTasks" FROM stages LEFT JOIN sums USING (stageId)""",
)
def task_rollup(spark, sf_dir):
    rows = rollup_tasks(_stages(spark, sf_dir), _stage_tasks(spark, sf_dir), ["jvmGcTime", "resultSize"], ["stageId"])
    return rows.select("stageId", "jvmGcTime", "resultSize", "numTasks")


@query(
    "stage_rollup",
    f"""
WITH {STAGES}, apps AS (SELECT n_nationkey * 3 AS appId FROM nation),
r AS (SELECT appId, CAST(sum(inputBytes) AS BIGINT) AS inputBytes, CAST(sum(coalesce(resultSize, 0)) AS BIGINT) AS resultSize, max(maxParallelTasks) AS mx,
             min(minParallelTasks) AS mn, count(DISTINCT stageId) AS st FROM stages LEFT JOIN sums USING (stageId) GROUP BY 1)
SELECT appId AS "appId", coalesce(inputBytes, 0) AS "inputBytes", coalesce(resultSize, 0) AS "resultSize", coalesce(mx, 0) AS "maxParallelTasks",
       coalesce(mn, 0) AS "minParallelTasks", coalesce(st, 0) AS "numStages", coalesce((inputBytes + resultSize) // 1048576, 0) AS "dataProc" FROM apps LEFT JOIN r USING (appId)""",
)
def stage_rollup(spark, sf_dir):
    rows = rollup_tasks(_stages(spark, sf_dir), _stage_tasks(spark, sf_dir), ["jvmGcTime", "resultSize"], ["stageId"])
    apps = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 3).alias("appId"))
    out = rollup_stages(apps, rows, ["inputBytes", "resultSize"], ["appId"])
    return out.select("appId", "inputBytes", "resultSize", "maxParallelTasks", "minParallelTasks", "numStages", "dataProc")


WORKFLOW = """
wf AS (SELECT n_nationkey AS wfId, 700000000 AS startTime, CASE WHEN n_nationkey <> 4 THEN 1000000000 END AS endTime FROM nation),
wfa AS (SELECT c_nationkey AS wfId, c_custkey AS wfaId, CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE 780000000 + c_custkey END AS startTime,
               900000000 AS endTime, CASE WHEN c_custkey % 2 = 0 THEN 'job_1' ELSE '-' END AS externalChildIDs FROM customer),
job AS (SELECT o_orderkey AS jobId, c_nationkey AS wfId, c_custkey AS wfaId, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) - 1 AS position,
               CAST(epoch(o_orderdate) AS BIGINT) AS submitTime, CAST(epoch(o_orderdate) AS BIGINT) + 10 AS startTime,
               CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(epoch(o_orderdate) AS BIGINT) + 10 + o_orderkey % 1000 + 1 END AS finishTime,
               o_orderkey % 5 AS mapsTotal, o_orderkey % 3 AS reducesTotal, o_orderkey % 17 AS avgMapTime, o_orderkey % 13 AS avgReduceTime,
               o_orderkey % 7 AS avgShuffleTime, o_orderkey % 6 AS avgMergeTime, o_orderkey % 19 AS waitTime, o_orderkey AS hdfsBytesReadTotal,
               o_orderkey * 2 AS cpuMillisecondsTotal, 1 AS killedMapAttempts, 0 AS killedReduceAttempts FROM orders JOIN customer ON o_custkey = c_custkey),
loc AS (SELECT l_orderkey AS jobId, CAST(sum(l_partkey) FILTER (WHERE l_linenumber = 1) AS BIGINT) AS off, CAST(sum(l_partkey) FILTER (WHERE l_linenumber = 2) AS BIGINT) AS nl,
               CAST(sum(l_partkey) FILTER (WHERE l_linenumber = 3) AS BIGINT) AS rl FROM lineitem GROUP BY 1),
j AS (SELECT job.*, off, nl, rl, wfa.startTime AS a_start, wfa.endTime AS a_end, job.finishTime > 0 AND job.startTime > 0 AS counted,
             job.finishTime > 0 AND job.startTime > 0 AND NOT (position = 0 AND externalChildIDs <> '-') AS run
      FROM job JOIN wfa ON job.wfId = wfa.wfId AND job.wfaId = wfa.wfaId JOIN wf ON wf.wfId = job.wfId LEFT JOIN loc ON loc.jobId = job.jobId
      WHERE wfa.startTime > 0 AND wf.endTime IS NOT NULL)"""

SUMS = """
CAST(coalesce(sum(hdfsBytesReadTotal) FILTER (WHERE counted), 0) AS BIGINT) AS "hdfsBytesReadTotal", CAST(coalesce(sum(waitTime) FILTER (WHERE counted), 0) AS BIGINT) AS "waitTimeTotal",
CAST(coalesce(sum(cpuMillisecondsTotal) FILTER (WHERE counted), 0) AS BIGINT) AS "cpuMillisecondsTotal", CAST(coalesce(sum(mapsTotal) FILTER (WHERE counted), 0) AS BIGINT) AS "mapsTotal",
CAST(coalesce(sum(reducesTotal) FILTER (WHERE counted), 0) AS BIGINT) AS "reducesTotal", CAST(coalesce(sum(killedMapAttempts) FILTER (WHERE counted), 0) AS BIGINT) AS "killedMapAttempts",
CAST(coalesce(sum(off), 0) AS BIGINT) AS "offSwitchHdfsBytesReadTotal", CAST(coalesce(sum(rl), 0) AS BIGINT) AS "rackLocalHdfsBytesReadTotal",
CAST(coalesce(sum(nl), 0) AS BIGINT) AS "nodeLocalHdfsBytesReadTotal",
CAST(sum(avgMapTime * mapsTotal) FILTER (WHERE counted) AS BIGINT) // nullif(CAST(sum(mapsTotal) FILTER (WHERE counted) AS BIGINT), 0) AS "weightedAvgMapTime",
CAST(sum(avgReduceTime * reducesTotal) FILTER (WHERE counted) AS BIGINT) // nullif(CAST(sum(reducesTotal) FILTER (WHERE counted) AS BIGINT), 0) AS "weightedAvgReduceTime",
CAST(sum(avgShuffleTime * reducesTotal) FILTER (WHERE counted) AS BIGINT) // nullif(CAST(sum(reducesTotal) FILTER (WHERE counted) AS BIGINT), 0) AS "weightedAvgShuffleTime",
CAST(sum(avgMergeTime * reducesTotal) FILTER (WHERE counted) AS BIGINT) // nullif(CAST(sum(reducesTotal) FILTER (WHERE counted) AS BIGINT), 0) AS "weightedAvgMergeTime"
"""

SUM_NAMES = [
    "hdfsBytesReadTotal", "waitTimeTotal", "cpuMillisecondsTotal", "mapsTotal", "reducesTotal", "killedMapAttempts",
    "offSwitchHdfsBytesReadTotal", "rackLocalHdfsBytesReadTotal", "nodeLocalHdfsBytesReadTotal", "weightedAvgMapTime",
    "weightedAvgReduceTime", "weightedAvgShuffleTime", "weightedAvgMergeTime",
]


def _hierarchy(spark, sf_dir):
    wf = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("wfId"), F.lit(700000000).cast("bigint").alias("startTime"),
        F.when(F.col("n_nationkey") != 4, F.lit(1000000000).cast("bigint")).alias("endTime"),
    )
    cust = table(spark, sf_dir, "customer")
    ck = F.col("c_custkey")
    wfa = cust.select(
        F.col("c_nationkey").alias("wfId"), ck.alias("wfaId"),
        F.when(ck % 11 == 0, F.lit(0)).otherwise(ck + 780000000).alias("startTime"), F.lit(900000000).cast("bigint").alias("endTime"),
        F.when(ck % 2 == 0, "job_1").otherwise("-").alias("externalChildIDs"),
    )
    ok, sub = F.col("o_orderkey"), F.unix_timestamp("o_orderdate")
    job = table(spark, sf_dir, "orders").join(cust.select(ck.alias("o_custkey"), "c_nationkey"), "o_custkey").select(
        ok.alias("jobId"), F.col("c_nationkey").alias("wfId"), F.col("o_custkey").alias("wfaId"), sub.alias("submitTime"),
        (sub + 10).alias("startTime"), F.when(F.col("o_orderstatus") == "P", F.lit(0)).otherwise(sub + 10 + ok % 1000 + 1).alias("finishTime"),
        (ok % 5).alias("mapsTotal"), (ok % 3).alias("reducesTotal"), (ok % 17).alias("avgMapTime"), (ok % 13).alias("avgReduceTime"),
        (ok % 7).alias("avgShuffleTime"), (ok % 6).alias("avgMergeTime"), (ok % 19).alias("waitTime"), ok.alias("hdfsBytesReadTotal"),
        (ok * 2).alias("cpuMillisecondsTotal"), F.lit(1).alias("killedMapAttempts"), F.lit(0).alias("killedReduceAttempts"),
    )
    job = row_number_within(job, ["wfaId"], "jobId", name="position").withColumn("position", F.col("position") - 1)
    li = table(spark, sf_dir, "lineitem")
    place = (
        F.when(F.col("l_linenumber") == 1, "OFF_SWITCH").when(F.col("l_linenumber") == 2, "NODE_LOCAL")
        .when(F.col("l_linenumber") == 3, "RACK_LOCAL").otherwise("OTHER")
    )
    attempts = li.select(F.col("l_orderkey").alias("jobId"), place.alias("locality"), F.col("l_partkey").alias("hdfsBytesRead"))
    return wf, wfa, job, attempts


@query("workflow_rollup", f"""WITH {WORKFLOW} SELECT wfId AS "wfId", {SUMS} FROM j GROUP BY 1""")
def workflow_sums(spark, sf_dir):
    wf, _ = rollup_workflow(*_hierarchy(spark, sf_dir))
    return wf.filter(F.col("endTime").isNotNull()).select("wfId", *SUM_NAMES)


@query(
    "action_rollup",
    f"""
WITH {WORKFLOW},
s AS (SELECT wfaId, {SUMS}, CAST(sum(finishTime - startTime) FILTER (WHERE run) AS BIGINT) AS runtime, arg_min(submitTime, position) FILTER (WHERE run) AS sub FROM j GROUP BY 1)
SELECT wfa.wfaId AS "wfaId", {", ".join(f'CASE WHEN runtime IS NOT NULL THEN "{n}" END AS "{n}"' for n in SUM_NAMES)},
       coalesce(sub - wfa.startTime, 0) AS "submitDelay", CASE WHEN runtime IS NOT NULL THEN wfa.endTime - wfa.startTime - runtime ELSE 0 END AS "jobDelay"
FROM wfa JOIN wf ON wf.wfId = wfa.wfId AND wf.endTime IS NOT NULL LEFT JOIN s ON s.wfaId = wfa.wfaId WHERE wfa.startTime > 0""",
)
def action_sums(spark, sf_dir):
    _, wfa = rollup_workflow(*_hierarchy(spark, sf_dir))
    return wfa.select("wfaId", *SUM_NAMES, "submitDelay", "jobDelay")


def busy_sql(name: str, span: str, min_rows: int = 1) -> str:
    """CTEs that merge the intervals (k, s, e) of ``span`` and sum their length.

    Equal intervals are peers: the island number is a RANGE sum, or a tie could fall into the island before its own.

    A bad endpoint voids a key, and so do fewer than ``min_rows`` intervals.
    """
    return f"""
{name}_ok AS (SELECT k FROM {span} GROUP BY k HAVING count(*) >= {min_rows} AND count(*) = count(*) FILTER (WHERE s > 0 AND e > 0)),
{name}_m AS (SELECT x.*, CASE WHEN s > max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS o FROM {span} x JOIN {name}_ok USING (k)),
{name}_i AS (SELECT *, sum(o) OVER (PARTITION BY k ORDER BY s, e RANGE UNBOUNDED PRECEDING) AS g FROM {name}_m),
{name} AS (SELECT k, CAST(sum(e - s) AS BIGINT) AS busy FROM (SELECT k, g, min(s) AS s, max(e) AS e FROM {name}_i GROUP BY 1, 2) GROUP BY 1)"""


@query(
    "workflow_delays",
    f"""
WITH {WORKFLOW},
used AS (SELECT job.*, count(*) OVER (PARTITION BY wfaId) AS n FROM job),
jspan AS (SELECT wfId AS k, startTime AS s, finishTime AS e FROM used WHERE NOT (n > 1 AND position = 0)),
aspan AS (SELECT wfId AS k, startTime AS s, endTime AS e FROM wfa),
{busy_sql("jb", "jspan")}, {busy_sql("ab", "aspan")}
SELECT wfId AS "wfId", CASE WHEN ab.busy > 0 THEN endTime - startTime - ab.busy ELSE 0 END AS "wfSchedulingDelay",
       CASE WHEN jb.busy > 0 THEN endTime - startTime - jb.busy ELSE 0 END AS "jobSchedulingDelay"
FROM wf LEFT JOIN jb ON jb.k = wfId LEFT JOIN ab ON ab.k = wfId WHERE endTime IS NOT NULL""",
)
def delays_of_workflows(spark, sf_dir):
    """Workflows with an action that never started, or a job without an end, have no path there."""
    wf, wfa, job, _ = _hierarchy(spark, sf_dir)
    return workflow_delays(wf, wfa, job).select(
        "wfId", F.col("wfSchedulingDelay").cast("bigint").alias("wfSchedulingDelay"),
        F.col("jobSchedulingDelay").cast("bigint").alias("jobSchedulingDelay"),
    )


@query(
    "disk_report",
    f"""
WITH {SAMPLES},
d AS (SELECT user_id AS host, event_type AS name, ts AS time, c, k FROM samples),
agg AS (SELECT host, time, 'aggregate' AS name, sum(c) AS c, sum(k) AS k FROM d WHERE name <> 'view' GROUP BY 1, 2),
u AS (SELECT host, time, name, c, k FROM d UNION ALL SELECT host, time, name, c, k FROM agg),
l AS (SELECT *, lag(c) OVER w AS pc, lag(k) OVER w AS pk, floor(epoch(time)) - floor(epoch(lag(time) OVER w)) AS dt FROM u WINDOW w AS (PARTITION BY host, name ORDER BY time))
SELECT host, name, time, CAST(c - pc AS BIGINT) AS read_bytes_delta, CAST(k - pk AS BIGINT) AS read_count_delta, CAST(dt AS BIGINT) AS elapsed_s,
       CASE WHEN pk IS NULL THEN NULL WHEN k = pk THEN 0.0 ELSE {round2("c - pc", "k - pk")} END AS "readLatency" FROM l""",
)
def disks(spark, sf_dir):
    s = samples(spark, sf_dir)
    counters = s.select(
        F.col("user_id").alias("host"), F.col("event_type").alias("name"), F.col("ts").alias("time"), F.col("c").alias("read_bytes"),
        F.col("c").alias("write_bytes"), F.col("k").alias("read_count"), F.col("k").alias("write_count"),
        F.col("c").alias("read_time"), F.col("c").alias("write_time"),
    )
    devices = s.select(F.col("user_id").alias("host"), F.col("event_type").alias("name")).distinct()
    devices = devices.withColumn("type", F.when(F.col("name") == "view", "part").otherwise("disk"))
    out = disk_report(devices, counters)
    return out.select("host", "name", "time", "read_bytes_delta", "read_count_delta", "elapsed_s", "readLatency")


@query(
    "spark_app_report",
    f"""
WITH st AS (SELECT c_nationkey AS app, o_orderkey AS id, CAST(epoch(o_orderdate) AS BIGINT) AS b FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P'),
tk AS (SELECT app, id, b, b + 5 + l_linenumber * 3 AS s, b + 5 + l_linenumber * 3 + CAST(l_quantity AS BIGINT) AS e, l_partkey AS r FROM lineitem JOIN st ON l_orderkey = id),
tspan AS (SELECT id AS k, s, e FROM tk), sspan AS (SELECT app AS k, b AS s, b + 65 AS e FROM st),
{busy_sql("tb", "tspan", 2)}, {busy_sql("sb", "sspan", 2)},
bk AS (SELECT id, b + 5 + i * 5 AS x, least(b + 10 + i * 5, b + 66) AS y FROM st, LATERAL (SELECT unnest(range(13)) AS i) WHERE id IN (SELECT id FROM tk)),
pt AS (SELECT bk.id, x, count(tk.id) AS n FROM bk LEFT JOIN tk ON tk.id = bk.id AND ((s >= x AND s < y) OR (e > x AND e <= y) OR (s < x AND e > y)) GROUP BY 1, 2),
pp AS (SELECT id, max(n) AS mx, min(n) AS mn FROM pt GROUP BY 1),
rs AS (SELECT id, CAST(sum(r) AS BIGINT) AS r FROM tk GROUP BY 1),
ap AS (SELECT app, count(*) AS n, CAST(sum(coalesce(r, 0)) AS BIGINT) AS r, CAST(sum(CASE WHEN busy > 0 THEN 65 - busy ELSE 0 END) AS BIGINT) AS d, max(coalesce(mx, 0)) AS mx, min(coalesce(mn, 0)) AS mn
       FROM st LEFT JOIN rs USING (id) LEFT JOIN pp USING (id) LEFT JOIN tb ON tb.k = st.id GROUP BY 1),
ex AS (SELECT c_nationkey AS app, 4 * count(*) AS cores FROM customer GROUP BY 1)
SELECT n_nationkey AS "appId", coalesce(n, 0) AS "numStages", coalesce(r, 0) AS "resultSize", coalesce(d, 0) AS "taskSchedulingDelay", coalesce(mx, 0) AS "maxParallelTasks",
       coalesce(mn, 0) AS "minParallelTasks", CASE WHEN n > 0 THEN cores ELSE 0 END AS "totalCores", coalesce((n * 10 + r) // 1048576, 0) AS "dataProc",
       CASE WHEN sb.busy > 0 THEN 300000000 - sb.busy ELSE 0 END AS "stageSchedulingDelay"
FROM nation LEFT JOIN ap ON ap.app = n_nationkey LEFT JOIN ex ON ex.app = n_nationkey LEFT JOIN sb ON sb.k = n_nationkey""",
)
def app_report(spark, sf_dir):
    """Applications per nation, stages per order, tasks per line item."""
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("appId"))
    base = F.unix_timestamp("o_orderdate")
    stages = table(spark, sf_dir, "orders").join(cust, "o_custkey").select(
        "appId", F.lit(0).alias("appAttemptId"), F.col("o_orderkey").alias("stageId"), F.lit(0).alias("stageAttemptId"),
        F.when(F.col("o_orderstatus") == "P", "FAILED").otherwise("COMPLETE").alias("status"), base.alias("submissionTime"),
        (base + 5).alias("firstTaskLaunchedTime"), (base + 65).alias("completionTime"), F.lit(10).alias("inputBytes"),
    )
    keys = stages.select("appId", "appAttemptId", "stageId", "stageAttemptId", F.col("firstTaskLaunchedTime").alias("_t"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("stageId"), "l_linenumber", "l_quantity", "l_partkey")
    launch = F.col("_t") + F.col("l_linenumber") * 3
    n_tasks = li.count()
    work = li.repartition(parts_for(spark, n_tasks), "stageId").join(keys, "stageId").select(
        "appId", "appAttemptId", "stageId", "stageAttemptId", launch.alias("launchTime"),
        (launch + F.col("l_quantity").cast("bigint")).alias("endTime"), F.col("l_partkey").alias("resultSize"),
    )
    apps = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("appId"), F.lit(0).alias("appAttemptId"), F.lit(700000000).alias("startTime"), F.lit(1000000000).alias("endTime")
    )
    executors = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("appId"), F.lit(0).alias("appAttemptId"), F.lit(4).alias("totalCores"))
    out = spark_report(apps, stages, work, executors, n_tasks=n_tasks)["apps"]
    return out.select("appId", "numStages", "resultSize", "taskSchedulingDelay", "maxParallelTasks", "minParallelTasks", "totalCores", "dataProc", "stageSchedulingDelay")
