"""Stored forms that spare reading: clustered log files, snapshots with digests, window counts by day."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.plans.log_counts import count_logs_stored, refresh_counts
from meterline.session import scratch_path
from meterline.sinks.clustered import files_for, search_clustered, write_clustered
from meterline.sinks.snapshots import store_snapshot, stored_difference, stored_membership_change

from .common import logs, query, table


@query(
    "clustered_log_search",
    """
SELECT user_id, event_type AS level, count(*) AS n, true AS few_files FROM events
WHERE floor(epoch(ts)) > 1704672000 AND floor(epoch(ts)) < 1704758400 AND user_id % 4 = 1 GROUP BY 1, 2""",
)
def clustered_search(spark, sf_dir):
    """One tag and one day of the clustered layout; at most a quarter of the files is opened."""
    path = scratch_path(spark, "clustered")
    rows = logs(spark, sf_dir).withColumn("time", F.col("time").cast("timestamp"))
    folder = write_clustered(rows, path, files=32)
    total = spark.read.format("binaryFile").option("pathGlobFilter", "*.orc").load(folder).select("path").count()
    few = len(files_for(spark, path, 1704672000, 1704758400, "app1")) * 4 <= total
    found = search_clustered(spark, path, 1704672000, 1704758400, tag="app1")
    return found.groupBy(F.col("_plugin").cast("bigint").alias("user_id"), "level").agg(F.count(F.lit(1)).alias("n"), F.lit(few).alias("few_files"))


def _two_snapshots(spark, sf_dir):
    """Orders without every 500th, and orders without every 700th of which every 900th has another price."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    price = F.when(F.col("o_orderkey") % 900 == 0, F.col("cents") + 7).otherwise(F.col("cents"))
    prev, cur = scratch_path(spark, "snapshot"), scratch_path(spark, "snapshot")
    store_snapshot(rows.filter("o_orderkey % 500 <> 0"), prev, ["o_orderkey"], 32)
    store_snapshot(rows.filter("o_orderkey % 700 <> 0").withColumn("cents", price), cur, ["o_orderkey"], 32)
    return cur, prev


@query(
    "stored_membership_change",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 500 = 0 THEN 'added' ELSE 'removed' END AS change FROM orders
WHERE (o_orderkey % 500 = 0) <> (o_orderkey % 700 = 0)""",
)
def stored_membership(spark, sf_dir):
    return stored_membership_change(spark, *_two_snapshots(spark, sf_dir))


@query(
    "stored_snapshot_difference",
    """
SELECT o_orderkey, CASE WHEN o_orderkey % 500 = 0 THEN CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderkey % 900 = 0 THEN 7 ELSE 0 END ELSE 7 END AS cents
FROM orders WHERE o_orderkey % 700 <> 0 AND (o_orderkey % 500 = 0 OR o_orderkey % 900 = 0)""",
)
def stored_changes(spark, sf_dir):
    """Rows that are new or changed, with the change of their price."""
    cur, prev = _two_snapshots(spark, sf_dir)
    return stored_difference(spark, cur, prev, ["cents"]).select("o_orderkey", "cents")


@query(
    "stored_window_counts",
    """
SELECT level, CAST(floor(epoch(ts)) AS BIGINT) // 300 * 300 AS start_s, count(*) AS count
FROM (SELECT ts, event_type AS level FROM events UNION ALL SELECT ts, '*' FROM events)
WHERE (level = 'error' AND floor(epoch(ts)) > 1704459123 AND floor(epoch(ts)) < 1705276999) OR (level = '*' AND floor(epoch(ts)) > 1704672017 AND floor(epoch(ts)) < 1705000000)
GROUP BY 1, 2""",
)
def stored_counts(spark, sf_dir):
    """Counts by window from the stored days and the two cut windows. A third of one day's events come late:
    that day alone is counted anew."""
    path = scratch_path(spark, "counts")
    rows = logs(spark, sf_dir).withColumn("time", F.col("time").cast("timestamp"))
    late = (F.to_date("time") == "2024-01-10") & (F.pmod(F.xxhash64("message"), F.lit(3)) == 0)
    refresh_counts(rows.filter(~late), path)
    refresh_counts(rows, path, ["2024-01-10"])
    errors = count_logs_stored(spark, path, rows, 1704459123, 1705276999, level="error").withColumn("level", F.lit("error"))
    every = count_logs_stored(spark, path, rows, 1704672017, 1705000000).withColumn("level", F.lit("*"))
    return errors.unionByName(every)
