"""Merged paths, delays, stragglers, wait time and concurrency."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.operators.intervals import (
    concurrency,
    concurrency_summary,
    critical_path,
    durations,
    flag_stragglers,
    group_percentiles,
    scheduling_delay,
    wait_time,
)

from .common import TASKS, query, table, tasks

PATH = """
marked AS (
  SELECT jobId, startTime, finishTime,
         CASE WHEN startTime > max(finishTime) OVER (PARTITION BY jobId ORDER BY startTime, finishTime
                                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
              THEN 1 ELSE 0 END AS opens
  FROM span
),
islands AS (
  SELECT *, sum(opens) OVER (PARTITION BY jobId ORDER BY startTime, finishTime RANGE UNBOUNDED PRECEDING) AS island
  FROM marked
),
path AS (
  SELECT jobId, min(startTime) AS startTime, max(finishTime) AS finishTime FROM islands GROUP BY jobId, island
)"""


def spans(spark, sf_dir, seconds: int = 600):
    """Tasks with short runs, so that paths have gaps."""
    rows = tasks(spark, sf_dir)
    return rows.withColumn("finishTime", F.col("startTime") + F.col("elapsedTime") * seconds * 10)


SPAN = "span AS (SELECT jobId, startTime, startTime + elapsedTime * 6000 AS finishTime FROM tasks)"


@query(
    "critical_path",
    f"WITH {TASKS}, {SPAN}, {PATH} SELECT jobId, startTime, finishTime FROM path",
)
def merged_path(spark, sf_dir):
    return critical_path(spans(spark, sf_dir), ["jobId"], "startTime", "finishTime")


@query(
    "critical_path_voided",
    f"""
WITH {TASKS},
span AS (SELECT orderId AS jobId, startTime, CASE WHEN state <> 'KILLED' THEN startTime + elapsedTime * 6000 END AS finishTime FROM tasks
         WHERE orderId IN (SELECT orderId FROM tasks GROUP BY orderId HAVING count(*) >= 2 AND count(*) FILTER (WHERE state = 'KILLED') = 0)),
{PATH}
SELECT jobId AS orderId, startTime, finishTime FROM path""",
)
def path_voided(spark, sf_dir):
    """Orders with an unfinished task have no path, nor have orders with one task."""
    rows = spans(spark, sf_dir)
    rows = rows.withColumn("finishTime", F.when(F.col("state") != "KILLED", F.col("finishTime")))
    return critical_path(rows, ["orderId"], "startTime", "finishTime", min_rows=2)


@query(
    "scheduling_delay",
    f"""
WITH {TASKS}, {SPAN}, {PATH},
busy AS (SELECT jobId, sum(finishTime - startTime) AS busy FROM path GROUP BY jobId),
wall AS (SELECT jobId, min(startTime) - 100 AS s, max(finishTime) + 1000 AS e FROM span GROUP BY jobId)
SELECT s_suppkey, CAST(CASE WHEN e - s > 0 AND busy > 0 THEN e - s - busy ELSE 0 END AS BIGINT) AS delay
FROM supplier LEFT JOIN wall ON s_suppkey = wall.jobId LEFT JOIN busy ON s_suppkey = busy.jobId""",
)
def delay_of_jobs(spark, sf_dir):
    rows = spans(spark, sf_dir)
    wall = rows.groupBy("jobId").agg(
        (F.min("startTime") - 100).alias("_s"), (F.max("finishTime") + 1000).alias("_e")
    )
    parents = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").alias("jobId"))
    parents = parents.join(wall, "jobId", "left")
    out = scheduling_delay(parents, rows, ["jobId"], "_s", "_e", "startTime", "finishTime", name="delay")
    return out.select("s_suppkey", F.col("delay").cast("bigint").alias("delay"))


@query(
    "durations",
    """
SELECT o_orderkey, e - s AS elapsedTime, CASE WHEN st > 0 AND e > 0 THEN e - st END AS runTime,
       CASE WHEN st > 0 AND s > 0 THEN st - s END AS schedulingDelay
FROM (SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS s,
             CASE WHEN o_orderstatus = 'P' THEN -1 ELSE CAST(epoch(o_orderdate) AS BIGINT) + 30 END AS st,
             CAST(epoch(o_orderdate) AS BIGINT) + 90 AS e FROM orders)""",
)
def derived_durations(spark, sf_dir):
    s = F.unix_timestamp("o_orderdate")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", s.alias("submit"),
        F.when(F.col("o_orderstatus") == "P", F.lit(-1)).otherwise(s + 30).alias("start"), (s + 90).alias("end"),
    )
    out = durations(rows, "submit", "start", "end")
    return out.select("o_orderkey", "elapsedTime", "runTime", "schedulingDelay")


@query(
    "stragglers",
    """
WITH q AS (
  SELECT l_suppkey, l_returnflag, quantile_cont(l_extendedprice, 0.75) AS q75, quantile_cont(l_extendedprice, 0.25) AS q25
  FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, l_returnflag, count(*) AS n,
       CAST(sum(CASE WHEN l_extendedprice > q75 + 1.5::DOUBLE * (q75 - q25) THEN 1 ELSE 0 END) AS BIGINT) AS flagged,
       CAST(sum(CASE WHEN l_extendedprice > q75 + 1.5::DOUBLE * (q75 - q25) THEN l_orderkey ELSE 0 END) AS BIGINT) AS which
FROM lineitem JOIN q USING (l_suppkey, l_returnflag) GROUP BY 1, 2""",
)
def stragglers(spark, sf_dir):
    rows = flag_stragglers(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"], "l_extendedprice")
    return rows.groupBy("l_suppkey", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("isStraggler").alias("flagged"),
        F.sum(F.col("isStraggler") * F.col("l_orderkey")).alias("which"),
    )


@query(
    "interpolated_percentile",
    """
SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_quantity, 0.5) AS p50,
       quantile_cont(l_quantity, 0.75) AS p75 FROM lineitem GROUP BY 1""",
)
def percentiles(spark, sf_dir):
    points = {"p25": 0.25, "p50": 0.5, "p75": 0.75}
    return group_percentiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", points)


@query(
    "percentiles_of_one_group",
    """
SELECT quantile_cont(l_extendedprice, 0.25) AS p25, quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem""",
)
def percentiles_of_all(spark, sf_dir):
    """All line items as one group, which is cut into slices."""
    rows = table(spark, sf_dir, "lineitem").withColumn("all", F.lit("x"))
    return group_percentiles(rows, ["all"], "l_extendedprice", {"p25": 0.25, "p99": 0.99}, rows_per_slice=500).drop("all")


@query(
    "wait_time",
    f"""
WITH {TASKS},
jobs AS (SELECT s_suppkey AS jobId, 780000000 AS submitTime, 5 AS mapsTotal FROM supplier),
v AS (SELECT * FROM tasks WHERE startTime > 0 AND finishTime > 0 AND elapsedTime > 0),
m AS (SELECT jobId, finishTime, elapsedTime, row_number() OVER (PARTITION BY jobId ORDER BY finishTime) AS rn,
             count(*) OVER (PARTITION BY jobId) AS n FROM v WHERE type = 'MAP'),
mm AS (SELECT jobId, max(finishTime) AS mf, max(elapsedTime) AS me,
              max(CASE WHEN rn = CAST(ceil(n * 70 / 100.0) AS BIGINT) AND rn < n THEN finishTime END) AS kth FROM m GROUP BY jobId),
r AS (SELECT jobId, max(finishTime) AS rf, max(elapsedTime) AS re FROM v WHERE type = 'REDUCE' GROUP BY jobId)
SELECT jobs.jobId, CAST(coalesce(mf - submitTime - me, 0)
       + coalesce(rf - CASE WHEN mf IS NOT NULL THEN kth WHEN mapsTotal > 0 THEN NULL ELSE submitTime END - re, 0) AS BIGINT) AS waitTime
FROM jobs LEFT JOIN mm USING (jobId) LEFT JOIN r USING (jobId)""",
)
def wait_times(spark, sf_dir):
    jobs = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("jobId"), F.lit(780000000).cast("bigint").alias("submitTime"), F.lit(5).alias("mapsTotal")
    )
    return wait_time(jobs, tasks(spark, sf_dir)).select("jobId", F.col("waitTime").cast("bigint").alias("waitTime"))


@query(
    "concurrency_even_buckets",
    f"""
WITH {TASKS},
g AS (SELECT jobId, min(startTime) AS lo, max(finishTime) + 1 AS hi,
             greatest((max(finishTime) + 1 - min(startTime)) // 25, 5) AS step FROM tasks GROUP BY jobId),
b AS (SELECT jobId, lo + i * step AS bs, least(lo + (i + 1) * step, hi) AS be
      FROM g, LATERAL (SELECT unnest(range(CAST(ceil((hi - lo) / step) AS BIGINT))) AS i))
SELECT b.jobId, bs AS bucket_start, be AS bucket_end,
       count(*) FILTER (WHERE type = 'MAP') AS mapCount, count(*) FILTER (WHERE type = 'REDUCE') AS reduceCount
FROM b LEFT JOIN tasks t ON t.jobId = b.jobId AND ((startTime >= bs AND startTime < be) OR (finishTime > bs AND finishTime <= be)
                                                  OR (startTime < bs AND finishTime > be))
GROUP BY ALL""",
)
def concurrency_points(spark, sf_dir):
    return concurrency(
        tasks(spark, sf_dir), ["jobId"], "startTime", "finishTime", "even",
        by={"mapCount": F.col("type") == "MAP", "reduceCount": F.col("type") != "MAP"},
    )


@query(
    "concurrency_summary",
    f"""
WITH {TASKS}, t AS (SELECT jobId, startTime // 86400 AS s, startTime // 86400 + elapsedTime AS e FROM tasks),
g AS (SELECT jobId, min(s) AS lo, max(e) + 1 AS hi FROM t GROUP BY jobId),
b AS (SELECT jobId, lo + i * 90 AS bs, least(lo + (i + 1) * 90, hi) AS be
      FROM g, LATERAL (SELECT unnest(range(CAST(ceil((hi - lo) / 90) AS BIGINT))) AS i)),
p AS (SELECT b.jobId, bs, count(t.jobId) AS n FROM b LEFT JOIN t ON t.jobId = b.jobId AND (
        (s >= bs AND s < be) OR (e > bs AND e <= be) OR (s < bs AND e > be)) GROUP BY 1, 2)
SELECT jobId, min(n) AS minParallelTasks, max(n) AS maxParallelTasks, CAST(floor(avg(n)) AS BIGINT) AS avgParallelTasks
FROM p GROUP BY 1""",
)
def concurrency_extremes(spark, sf_dir):
    """Days as the unit of time, 90 of them to a bucket."""
    rows = tasks(spark, sf_dir).select(
        "jobId", F.floor(F.col("startTime") / 86400).alias("s"), (F.floor(F.col("startTime") / 86400) + F.col("elapsedTime")).alias("e")
    )
    return concurrency_summary(concurrency(rows, ["jobId"], "s", "e", 90), ["jobId"])


ONE_GROUP = f"""
{TASKS}, span AS (
  SELECT 1 AS jobId, startTime, startTime + elapsedTime * 60 AS finishTime FROM tasks
  UNION ALL SELECT 1, CAST(floor(epoch(ts)) AS BIGINT), CAST(floor(epoch(ts)) AS BIGINT) + event_id % 400 FROM events
)"""


def one_group(spark, sf_dir):
    """Line items and events as the intervals of one group."""
    events = table(spark, sf_dir, "events").select(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("startTime"), "event_id")
    events = events.select("startTime", (F.col("startTime") + F.col("event_id") % 400).alias("finishTime"))
    items = tasks(spark, sf_dir).select("startTime", (F.col("startTime") + F.col("elapsedTime") * 60).alias("finishTime"))
    return items.unionByName(events).withColumn("jobId", F.lit(1))


@query("critical_path_one_group", f"WITH {ONE_GROUP}, {PATH} SELECT startTime, finishTime FROM path")
def path_of_one_group(spark, sf_dir):
    return critical_path(one_group(spark, sf_dir), ["jobId"], "startTime", "finishTime", rows_per_slice=300).drop("jobId")


@query(
    "scheduling_delay_one_group",
    f"""
WITH {ONE_GROUP}, {PATH}, busy AS (SELECT CAST(sum(finishTime - startTime) AS BIGINT) AS busy FROM path)
SELECT (SELECT max(finishTime) - min(startTime) + 1100 FROM span) - busy AS delay FROM busy""",
)
def delay_of_one_group(spark, sf_dir):
    rows = one_group(spark, sf_dir)
    wall = rows.groupBy("jobId").agg((F.min("startTime") - 100).alias("_s"), (F.max("finishTime") + 1000).alias("_e"))
    out = scheduling_delay(wall, rows, ["jobId"], "_s", "_e", "startTime", "finishTime", name="delay", rows_per_slice=300)
    return out.select(F.col("delay").cast("bigint").alias("delay"))


@query(
    "wait_time_one_job",
    f"""
WITH {TASKS}, v AS (SELECT * FROM tasks WHERE startTime > 0 AND finishTime > 0 AND elapsedTime > 0),
m AS (SELECT finishTime, elapsedTime, row_number() OVER (ORDER BY finishTime) AS rn, count(*) OVER () AS n FROM v WHERE type = 'MAP'),
mm AS (SELECT max(finishTime) AS mf, max(elapsedTime) AS me, max(CASE WHEN rn = CAST(ceil(n * 70 / 100.0) AS BIGINT) AND rn < n THEN finishTime END) AS kth FROM m),
r AS (SELECT max(finishTime) AS rf, max(elapsedTime) AS re FROM v WHERE type = 'REDUCE')
SELECT CAST(mf - 780000000 - me + rf - kth - re AS BIGINT) AS "waitTime" FROM mm, r""",
)
def wait_of_one_job(spark, sf_dir):
    """All attempts belong to one job, whose finish seconds are cut into slices."""
    jobs = table(spark, sf_dir, "region").filter("r_regionkey = 0").select(
        F.lit(1).alias("jobId"), F.lit(780000000).cast("bigint").alias("submitTime"), F.lit(5).alias("mapsTotal")
    )
    rows = tasks(spark, sf_dir).withColumn("jobId", F.lit(1))
    return wait_time(jobs, rows, rows_per_slice=200).select(F.col("waitTime").cast("bigint").alias("waitTime"))


@query(
    "concurrency_one_group",
    f"""
WITH {TASKS}, t AS (SELECT startTime // 86400 AS s, startTime // 86400 + elapsedTime AS e FROM tasks),
g AS (SELECT min(s) AS lo, max(e) + 1 AS hi FROM t),
b AS (SELECT lo + i * 5 AS bs, least(lo + (i + 1) * 5, hi) AS be FROM g, LATERAL (SELECT unnest(range(CAST(ceil((hi - lo) / 5) AS BIGINT))) AS i))
SELECT bs AS bucket_start, be AS bucket_end, count(s) AS task_count
FROM b LEFT JOIN t ON ((s >= bs AND s < be) OR (e > bs AND e <= be) OR (s < bs AND e > be)) GROUP BY 1, 2""",
)
def concurrency_of_one_group(spark, sf_dir):
    """Days as the unit of time, five of them to a bucket; the changes of one group are cut into slices."""
    rows = tasks(spark, sf_dir).select(
        F.lit(1).alias("jobId"), F.floor(F.col("startTime") / 86400).alias("s"), (F.floor(F.col("startTime") / 86400) + F.col("elapsedTime")).alias("e")
    )
    return concurrency(rows, ["jobId"], "s", "e", 5, rows_per_slice=50).drop("jobId")
