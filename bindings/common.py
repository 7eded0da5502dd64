"""Registration and shared views of the driver tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterline.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is what DuckDB runs on the same tables."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def round2(a: str, b: str, scale: int = 1) -> str:
    """SQL of ``scale * a / b`` rounded half up to two places in whole-number arithmetic."""
    a, b = f"CAST({a} AS HUGEINT)", f"CAST({b} AS HUGEINT)"
    return (
        f"CAST(sign({a}) * sign({b}) * ((200 * {scale} * abs({a}) + abs({b})) // (2 * abs({b}))) AS BIGINT) / 100.0::DOUBLE"
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log rows; every fifth has no document type."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("ts").alias("time"),
        F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("_documentType"),
        F.concat(F.col("props"), F.lit("#"), F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("message"),
        F.concat(F.lit("app"), (F.col("user_id") % 4).cast("string")).alias("_tag_appName"),
        F.col("user_id").cast("string").alias("_plugin"),
        F.col("event_type").alias("level"),
    )


def places(spark: SparkSession, df: DataFrame) -> DataFrame:
    """``df``, a sorted table, with the ``place`` (from 0) each row has in it: written as it lies, then
    numbered by its partitions, so that a wrong order shows."""
    path = scratch_path(spark, "sorted")
    df.withColumn("_row", F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("_part", F.shiftright("_row", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead")
    )
    place = F.col("_row").bitwiseAND((1 << 33) - 1) + F.col("_ahead")
    return rows.join(ahead, "_part").withColumn("place", place).drop("_row", "_part", "_ahead")


LOGS = """
logs AS (
  SELECT ts AS time,
         CASE WHEN event_id % 5 <> 0 THEN event_type END AS _documentType,
         props || '#' || lpad(CAST(event_id AS VARCHAR), 12, '0') AS message,
         'app' || CAST(user_id % 4 AS VARCHAR) AS _tag_appName,
         CAST(user_id AS VARCHAR) AS _plugin,
         event_type AS level
  FROM events
)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as counter samples: series ``user_id``, counters ``c`` (falls now and then) and ``k``."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "event_id", "user_id", "ts", F.col("event_type"),
        F.round(F.col("value") * 100).cast("bigint").alias("c"),
        F.regexp_extract("props", r"(\d+)", 1).cast("bigint").alias("k"),
    )


SAMPLES = r"""
samples AS (
  SELECT event_id, user_id, ts, event_type, CAST(round(value * 100) AS BIGINT) AS c,
         CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS k
  FROM events
)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as task attempts of a job per supplier; times in epoch seconds."""
    li = table(spark, sf_dir, "lineitem")
    start = F.unix_timestamp("l_shipdate")
    run = (F.col("l_quantity") * 86400).cast("bigint")
    return li.select(
        F.col("l_suppkey").alias("jobId"),
        F.col("l_orderkey").alias("orderId"),
        F.col("l_linenumber").alias("line"),
        F.when(F.col("l_returnflag") == "R", "REDUCE").otherwise("MAP").alias("type"),
        F.when(F.col("l_linestatus") == "O", "SUCCEEDED")
        .when(F.col("l_linenumber") % 2 == 0, "FAILED")
        .otherwise("KILLED")
        .alias("state"),
        F.when(F.col("l_linenumber") == 1, "OFF_SWITCH")
        .when(F.col("l_linenumber") == 2, "NODE_LOCAL")
        .when(F.col("l_linenumber") == 3, "RACK_LOCAL")
        .otherwise("OTHER")
        .alias("locality"),
        start.alias("startTime"),
        (start + run).alias("finishTime"),
        F.col("l_quantity").cast("bigint").alias("elapsedTime"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("elapsedShuffleTime"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("elapsedMergeTime"),
        (F.col("l_linenumber") * 3).cast("bigint").alias("elapsedReduceTime"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("hdfsBytesRead"),
        F.concat(F.lit("node"), (F.col("l_partkey") % 7).cast("string")).alias("node"),
    )


TASKS = """
tasks AS (
  SELECT l_suppkey AS jobId, l_orderkey AS orderId, l_linenumber AS line,
         CASE WHEN l_returnflag = 'R' THEN 'REDUCE' ELSE 'MAP' END AS type,
         CASE WHEN l_linestatus = 'O' THEN 'SUCCEEDED' WHEN l_linenumber % 2 = 0 THEN 'FAILED' ELSE 'KILLED' END AS state,
         CASE l_linenumber WHEN 1 THEN 'OFF_SWITCH' WHEN 2 THEN 'NODE_LOCAL' WHEN 3 THEN 'RACK_LOCAL' ELSE 'OTHER' END AS locality,
         CAST(epoch(l_shipdate) AS BIGINT) AS startTime,
         CAST(epoch(l_shipdate) AS BIGINT) + CAST(l_quantity * 86400 AS BIGINT) AS finishTime,
         CAST(l_quantity AS BIGINT) AS elapsedTime,
         CAST(round(l_discount * 100) AS BIGINT) AS elapsedShuffleTime,
         CAST(round(l_tax * 100) AS BIGINT) AS elapsedMergeTime,
         CAST(l_linenumber * 3 AS BIGINT) AS elapsedReduceTime,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS hdfsBytesRead,
         'node' || CAST(l_partkey % 7 AS VARCHAR) AS node
  FROM lineitem
)"""
