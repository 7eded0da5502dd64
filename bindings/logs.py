"""Log search, payloads, windows and indexes."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.operators.aggregates import count_windows
from meterline.operators.ordering import add_index, preview
from meterline.operators.projections import add_date_parts
from meterline.plans.log_search import count_logs, find_logs, search_logs
from meterline.sources.logs import decode_logs

from .common import LOGS, logs, query, table

# A search range inside the data, in epoch seconds.
FROM_S, TO_S = 1704070807, 1706400000
IN_RANGE = f"floor(epoch(time)) > {FROM_S} AND floor(epoch(time)) < {TO_S}"


@query(
    "log_search_windows",
    f"""
WITH {LOGS},
w AS (
  SELECT time_bucket(INTERVAL '5 minutes', time) AS start, count(*) AS count
  FROM logs WHERE {IN_RANGE} AND level = 'error' GROUP BY 1
)
SELECT start, start + INTERVAL '5 minutes' AS "end", count, CAST(epoch(start) AS BIGINT) AS timestamp,
       CAST(row_number() OVER (ORDER BY start) AS INTEGER) AS index
FROM w""",
)
def log_search_windows(spark, sf_dir):
    return count_logs(logs(spark, sf_dir), FROM_S, TO_S, level="error")


@query(
    "log_search_rows_indexed",
    f"""
WITH {LOGS}
SELECT time, _documentType, message, _tag_appName, _plugin, level,
       CAST(floor(epoch(time)) AS BIGINT) AS timestamp,
       row_number() OVER (ORDER BY floor(epoch(time)), message) AS index
FROM logs WHERE {IN_RANGE}""",
)
def log_search_rows_indexed(spark, sf_dir):
    return find_logs(logs(spark, sf_dir), FROM_S, TO_S, doc_type="*")


@query(
    "log_search_terms",
    f"""
WITH {LOGS}
SELECT _plugin, message, time FROM logs
WHERE {IN_RANGE} AND _tag_appName = 'app1' AND level = 'click' AND _documentType = 'click'""",
)
def log_search_terms(spark, sf_dir):
    rows = search_logs(logs(spark, sf_dir), FROM_S, TO_S, tag="app1", level="click", doc_type="click")
    return rows.select("_plugin", "message", "time")


@query(
    "log_windows_all",
    """
SELECT time_bucket(INTERVAL '5 minutes', ts) AS start,
       time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes' AS "end", count(*) AS count,
       CAST(epoch(time_bucket(INTERVAL '5 minutes', ts)) AS BIGINT) AS timestamp
FROM events GROUP BY 1, 2, 4""",
)
def log_windows_all(spark, sf_dir):
    return count_windows(table(spark, sf_dir, "events"), "ts", "5 minutes")


@query(
    "log_date_parts",
    """
SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day,
       count(*) AS n FROM events GROUP BY 1, 2, 3""",
)
def log_date_parts(spark, sf_dir):
    rows = add_date_parts(table(spark, sf_dir, "events"), "ts")
    return rows.groupBy("year", "month", "day").agg(F.count(F.lit(1)).alias("n"))


@query(
    "log_payload_decode",
    """
SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type END AS level,
       CASE WHEN event_type <> 'view' THEN CAST(user_id AS VARCHAR) END AS _plugin,
       CASE WHEN event_type <> 'view' THEN CAST(floor(epoch(ts)) AS BIGINT) END AS second
FROM events""",
)
def log_payload_decode(spark, sf_dir):
    """Events as JSON payloads, those of one type cut short so that they do not parse."""
    ev = table(spark, sf_dir, "events")
    payload = F.to_json(
        F.struct(
            F.col("user_id").cast("string").alias("_plugin"),
            F.col("event_type").alias("level"),
            F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("time"),
            F.col("event_id").cast("string").alias("message"),
            F.lit("x").alias("unused"),
        )
    )
    bad = F.col("event_type") == "view"
    value = F.when(bad, F.lit("{broken")).otherwise(payload).cast("binary")
    out = decode_logs(ev.select("event_id", value.alias("value")), keep=["event_id"])
    return out.select(
        "event_id", F.col("data.level").alias("level"), F.col("data._plugin").alias("_plugin"),
        F.unix_timestamp("data.time").alias("second"),
    )


@query(
    "event_index_distributed",
    "SELECT event_id, row_number() OVER (ORDER BY value, event_id) AS index FROM events",
)
def event_index_distributed(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "value")
    return add_index(rows, "value", ["event_id"], distributed=True).select("event_id", "index")


@query("log_preview", f"WITH {LOGS} SELECT time, message FROM logs ORDER BY message LIMIT 10")
def log_preview(spark, sf_dir):
    return preview(logs(spark, sf_dir).select("time", "message").orderBy("message"), 10)
