"""Deltas, rates, ratios and latencies of counter samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.functions import hit_ratio, mean_latency, pct
from meterline.operators.counters import (
    counter_delta,
    counter_rate,
    cpu_percent,
    drop_first_sample,
    last_value_per_series,
)
from meterline.operators.slices import running_total, slice_groups

from .common import SAMPLES, query, round2, samples

KEYS, TIE = ["user_id"], ["event_id"]

LAGGED = f"""
{SAMPLES},
lagged AS (
  SELECT *, lag(c) OVER w AS pc, lag(k) OVER w AS pk, lag(ts) OVER w AS pts,
         lag(event_id) OVER w IS NOT NULL AS has_prev
  FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
)"""


def delta_sql(expr: str, where: str = "") -> str:
    return f"WITH {LAGGED} SELECT event_id, CAST({expr} AS BIGINT) AS c_delta FROM lagged {where}"


def deltas(spark, sf_dir, **policy):
    rows = counter_delta(samples(spark, sf_dir), KEYS, "ts", ["c"], tiebreak=TIE, **policy)
    return rows.select("event_id", "c_delta")


@query("delta_raw_first_null", delta_sql("c - pc"))
def delta_raw(spark, sf_dir):
    return deltas(spark, sf_dir)


@query(
    "delta_reset_zero_first_zero",
    delta_sql("CASE WHEN NOT has_prev THEN 0 WHEN c < pc THEN 0 ELSE c - pc END"),
)
def delta_zero(spark, sf_dir):
    return deltas(spark, sf_dir, reset="zero", first="zero")


@query(
    "delta_reset_current_first_passthrough",
    delta_sql("CASE WHEN NOT has_prev THEN c WHEN c < pc THEN c ELSE c - pc END"),
)
def delta_current(spark, sf_dir):
    return deltas(spark, sf_dir, reset="current", first="passthrough")


@query(
    "delta_reset_null_first_drop",
    delta_sql("CASE WHEN c >= pc THEN c - pc END", "WHERE has_prev"),
)
def delta_null(spark, sf_dir):
    return deltas(spark, sf_dir, reset="null", first="drop")


@query(
    "delta_drop_batch",
    f"""
WITH {LAGGED},
bad AS (SELECT DISTINCT date_trunc('minute', ts) AS poll FROM lagged WHERE c < pc)
SELECT event_id, c - pc AS c_delta FROM lagged
WHERE date_trunc('minute', ts) NOT IN (SELECT poll FROM bad)""",
)
def delta_drop_batch(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("poll", F.date_trunc("minute", "ts"))
    rows = counter_delta(rows, KEYS, "ts", ["c"], reset="drop_batch", poll=["poll"], tiebreak=TIE)
    return rows.select("event_id", "c_delta")


@query(
    "delta_gate",
    delta_sql("CASE WHEN NOT has_prev THEN 0 WHEN k > pk THEN c - pc ELSE 0 END"),
)
def delta_gate(spark, sf_dir):
    return deltas(spark, sf_dir, gate="k", first="zero")


@query(
    "delta_max_gap",
    delta_sql(
        "CASE WHEN NOT has_prev THEN 0 "
        "WHEN floor(epoch(ts)) - floor(epoch(pts)) > 10800 THEN 0 ELSE c - pc END"
    ),
)
def delta_gap(spark, sf_dir):
    return deltas(spark, sf_dir, max_gap_s=3 * 3600, first="zero")


@query(
    "delta_hot_series",
    f"""
WITH {SAMPLES}
SELECT event_id, c - lag(c) OVER (PARTITION BY event_id % 100 < 0 ORDER BY ts, event_id) AS c_delta FROM samples""",
)
def delta_hot_series(spark, sf_dir):
    """All samples in one series, cut into slices by time."""
    rows = samples(spark, sf_dir).withColumn("all", F.lit("one"))
    rows = counter_delta(rows, ["all"], "ts", ["c"], tiebreak=TIE, rows_per_slice=200)
    return rows.select("event_id", "c_delta")


@query(
    "rate_elapsed",
    f"""
WITH {SAMPLES},
run AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS total FROM samples),
lagged AS (
  SELECT *, lag(total) OVER w AS pt, lag(ts) OVER w AS pts FROM run WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
)
SELECT event_id,
       CASE WHEN floor(epoch(ts)) > floor(epoch(pts))
            THEN CAST(total - pt AS DOUBLE) / (floor(epoch(ts)) - floor(epoch(pts))) END AS total_rate
FROM lagged""",
)
def rate_elapsed(spark, sf_dir):
    """Rate of an ever-growing counter: the running sum of the samples."""
    rows = slice_groups(samples(spark, sf_dir), KEYS, "ts", tiebreak=TIE)
    rows = running_total(rows, KEYS, "ts", F.col("c"), TIE, name="total")
    return counter_rate(rows, KEYS, "ts", ["total"], tiebreak=TIE).select("event_id", "total_rate")


@query(
    "rate_nominal_interval",
    f"""
WITH {LAGGED}
SELECT event_id, CASE WHEN NOT has_prev OR c < pc THEN 0.0 ELSE CAST(c - pc AS DOUBLE) / 10 END AS c_rate FROM lagged""",
)
def rate_interval(spark, sf_dir):
    rows = counter_rate(
        samples(spark, sf_dir), KEYS, "ts", ["c"], per="interval", interval_s=10, reset="zero", first="zero",
        tiebreak=TIE,
    )
    return rows.select("event_id", "c_rate")


@query("first_sample_dropped", f"WITH {LAGGED} SELECT event_id, user_id FROM lagged WHERE has_prev")
def first_sample_dropped(spark, sf_dir):
    return drop_first_sample(samples(spark, sf_dir), KEYS, "ts", TIE).select("event_id", "user_id")


@query(
    "cpu_percent",
    f"""
WITH {SAMPLES},
vm AS (SELECT event_id, user_id, ts, c * 1000000000 AS cpu_ns, user_id % 4 + 1 AS vcpus FROM samples),
lagged AS (SELECT *, lag(cpu_ns) OVER w AS p, lag(ts) OVER w AS pts FROM vm WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id,
       CASE WHEN cpu_ns >= p AND floor(epoch(ts)) > floor(epoch(pts))
            THEN 100.0::DOUBLE * CAST(cpu_ns - p AS DOUBLE) / ((floor(epoch(ts)) - floor(epoch(pts))) * vcpus * 1e9) END AS cpu_percent
FROM lagged""",
)
def vm_cpu_percent(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumns(
        {"cpu_ns": F.col("c") * 1000000000, "vcpus": F.col("user_id") % 4 + 1}
    )
    return cpu_percent(rows, KEYS, "ts", "cpu_ns", "vcpus", TIE).select("event_id", "cpu_percent")


@query(
    "last_value_per_series",
    f"""
WITH {SAMPLES}
SELECT user_id, arg_max(k, ts) FILTER (WHERE k <> 0) AS k, max(ts) FILTER (WHERE k <> 0) AS ts FROM samples GROUP BY user_id""",
)
def last_values(spark, sf_dir):
    return last_value_per_series(samples(spark, sf_dir), KEYS, "ts", "k")


@query(
    "hit_ratio_of_deltas",
    f"""
WITH {LAGGED}, d AS (
  SELECT event_id, CASE WHEN has_prev AND c >= pc THEN c - pc ELSE 0 END AS h,
         CASE WHEN has_prev AND k >= pk THEN k - pk ELSE 0 END AS m FROM lagged)
SELECT event_id,
       CASE WHEN h + m = 0 THEN 0.0 ELSE {round2("h", "h + m", 100)} END AS ratio,
       CASE WHEN h + m = 0 THEN 0 ELSE CAST(floor(100.0::DOUBLE * h / (h + m)) AS BIGINT) END AS whole
FROM d""",
)
def hit_ratio_of_deltas(spark, sf_dir):
    rows = counter_delta(
        samples(spark, sf_dir), KEYS, "ts", ["c", "k"], reset="zero", first="zero", tiebreak=TIE
    )
    return rows.select(
        "event_id",
        hit_ratio("c_delta", "k_delta").alias("ratio"),
        hit_ratio("c_delta", "k_delta", whole=True).alias("whole"),
    )


@query(
    "mean_latency_of_deltas",
    f"""
WITH {LAGGED}
SELECT event_id, CASE WHEN NOT has_prev THEN NULL WHEN k = pk THEN 0.0::DOUBLE
                 ELSE CAST(c - pc AS DOUBLE) / (k - pk) END AS latency FROM lagged""",
)
def mean_latency_of_deltas(spark, sf_dir):
    rows = counter_delta(samples(spark, sf_dir), KEYS, "ts", ["c", "k"], tiebreak=TIE)
    return rows.select("event_id", mean_latency("c_delta", "k_delta").alias("latency"))


@query(
    "percent_of_limit",
    f"""
WITH {SAMPLES}
SELECT event_id, {round2("k", "nullif(user_id, 0)", 100)} AS used FROM samples""",
)
def percent_of_limit(spark, sf_dir):
    return samples(spark, sf_dir).select("event_id", pct("k", "user_id").alias("used"))
