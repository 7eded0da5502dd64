"""Sinks: written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.session import scratch_path
from meterline.sinks import (
    compact_day,
    insert_overwrite_directory,
    keep_latest,
    read_result,
    upsert,
    write_batches,
    write_docs,
    write_result,
)
from meterline.sources.logs import read_logs, read_partitioned
from meterline.sources.tables import read_delimited
from meterline.operators.projections import add_date_parts
from meterline.plans.log_search import search_logs

from .common import logs, query, table


def _partitioned(spark, sf_dir):
    """Log events in the layout the ingest stream writes."""
    path = scratch_path(spark, "ingested")
    rows = logs(spark, sf_dir).withColumn("time", F.col("time").cast("timestamp"))
    data = F.struct(F.lit("n1").alias("node"), *rows.columns).alias("data")
    rows = add_date_parts(rows.select(data), "data.time")
    rows.hint("rebalance", "year", "month", "day").write.partitionBy("year", "month", "day").orc(path)
    return path


@query(
    "log_compaction",
    """
SELECT day(ts) AS day, event_type AS level, count(*) AS n, true AS few_files FROM events WHERE ts < TIMESTAMP '2024-02-01' GROUP BY 1, 2""",
)
def compaction(spark, sf_dir):
    """Every day of the ingested log compacted, then read back by glob."""
    src, out = _partitioned(spark, sf_dir), scratch_path(spark, "compacted")
    for (year, month, day) in [
        tuple(r) for r in read_partitioned(spark, src).select("year", "month", "day").distinct().collect()
    ]:
        compact_day(spark, src, out, year, month, day)
    rows = read_logs(spark, out, 2024, 1, "*").withColumn("_file", F.input_file_name())
    per_day = rows.groupBy(F.dayofmonth("data.time").alias("day"), F.col("data.level").alias("level")).agg(
        F.count(F.lit(1)).alias("n"), (F.count_distinct("_file") <= 10).alias("few_files")
    )
    return per_day.withColumn("day", F.col("day").cast("bigint"))


@query(
    "partitioned_log_search",
    """
SELECT user_id, count(*) AS n FROM events WHERE floor(epoch(ts)) > 1704672000 AND floor(epoch(ts)) < 1705276800 AND event_type = 'error' GROUP BY 1""",
)
def partitioned_search(spark, sf_dir):
    """Search in the partitioned layout: folders outside the range are not read."""
    rows = search_logs(read_partitioned(spark, _partitioned(spark, sf_dir)), 1704672000, 1705276800, level="error")
    return rows.groupBy(F.col("_plugin").cast("bigint").alias("user_id")).agg(F.count(F.lit(1)).alias("n"))


@query("stored_result", "SELECT l_returnflag, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1")
def stored_result(spark, sf_dir):
    root = scratch_path(spark, "results")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum("l_quantity").cast("bigint").alias("q"))
    for _ in range(2):
        write_result(rows, f"{root}/q1")
    return read_result(spark, root, "q1")


@query(
    "documents_by_type",
    """
SELECT CASE WHEN lang = 'en' THEN 'mysql' ELSE 'disk' END AS dir_plugin, CASE WHEN lang = 'en' THEN '-' ELSE source END AS dir_type, lang AS dir_instance, count(*) AS n
FROM documents GROUP BY 1, 2, 3""",
)
def docs_by_type(spark, sf_dir):
    path = scratch_path(spark, "documents")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "n_chars", F.when(F.col("lang") == "en", "mysql").otherwise("disk").alias("_plugin"), F.col("source").alias("_documentType"),
        F.col("lang").alias("plugin_instance"),
    )
    write_docs(docs, path)
    return spark.read.json(path).groupBy("dir_plugin", "dir_type", "dir_instance").agg(F.count(F.lit(1)).alias("n"))


@query(
    "newest_documents",
    """
SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 10""",
)
def newest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return keep_latest(rows, ["user_id"], "ts", 10, ["event_id"]).drop("ts")


@query("batched_documents", "SELECT count(*) AS n, true AS bounded, true AS whole FROM orders")
def batches(spark, sf_dir):
    path = scratch_path(spark, "batches")
    rows = table(spark, sf_dir, "orders")
    write_batches(rows, path, 500)
    back = spark.read.schema(rows.schema).json(path).withColumn("_file", F.input_file_name())
    per_file = back.groupBy("_file").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("k"))
    want = rows.agg(F.sum("o_orderkey")).scalar()
    return per_file.agg(F.sum("n").alias("n"), (F.max("n") <= 500).alias("bounded"), F.sum("k").alias("k")).select(
        "n", "bounded", (F.col("k") == want).alias("whole")
    )


@query(
    "upsert_latest",
    """
WITH u AS (SELECT c_custkey * 2 AS id, c_mktsegment AS segment, CAST(round(c_acctbal * 100) AS BIGINT) AS cents, CAST(-1 AS BIGINT) AS version FROM customer
           UNION ALL SELECT o_custkey, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END, CASE WHEN o_orderstatus <> 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) END, o_orderkey FROM orders)
SELECT id, arg_max(segment, version) FILTER (WHERE segment IS NOT NULL) AS segment, arg_max(cents, version) FILTER (WHERE cents IS NOT NULL) AS cents, max(version) AS version FROM u GROUP BY 1""",
)
def upserted(spark, sf_dir):
    current = table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") * 2).alias("id"), F.col("c_mktsegment").alias("segment"), F.round(F.col("c_acctbal") * 100).cast("bigint").alias("cents"),
        F.lit(-1).cast("bigint").alias("version"),
    )
    status = F.col("o_orderstatus")
    updates = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("id"), F.when(status == "O", F.col("o_orderpriority")).alias("segment"),
        F.when(status != "F", F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"), F.col("o_orderkey").alias("version"),
    )
    return upsert(current, updates, "id", "version")


@query("overwritten_directory", "SELECT CAST(p_size AS INTEGER) AS a, count(*) AS n FROM part GROUP BY 1")
def overwritten(spark, sf_dir):
    """A one-column table written as delimited text and read as an external table."""
    path = scratch_path(spark, "overwrite")
    rows = table(spark, sf_dir, "part").select(F.col("p_size").alias("a"))
    for _ in range(2):
        insert_overwrite_directory(rows, path)
    return read_delimited(spark, path, "a INT").groupBy("a").agg(F.count(F.lit(1)).alias("n"))
