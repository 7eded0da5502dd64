"""Window counts of logs, kept up to date by day and merged at query time.

Stored counts have one row for each five-minute window and combination of terms. A day whose logs
changed (late rows included) is counted anew and replaces its folder. A query adds up the stored counts of whole
windows and reads raw rows for the two windows that the ends of its range cut.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.projections import ANY
from .log_search import search_logs

WINDOW_S = 300
TERMS = {"tag": "_tag_appName", "plugin": "_plugin", "level": "level", "doc_type": "_documentType"}
COUNTS = "start_s BIGINT, _tag_appName STRING, _plugin STRING, level STRING, _documentType STRING, count BIGINT, date DATE"


def _start(time) -> F.Column:
    seconds = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / 1_000_000)
    return (seconds - F.pmod(seconds, F.lit(WINDOW_S))).cast("bigint")


def partial_counts(logs: DataFrame) -> DataFrame:
    """Mergeable counts of log rows by window, terms and date (UTC)."""
    start = _start("time").alias("start_s")
    counted = logs.filter(F.col("time").isNotNull()).groupBy(start, *TERMS.values()).agg(F.count(F.lit(1)).alias("count"))
    return counted.withColumn("date", F.to_date(F.timestamp_seconds("start_s")))


def refresh_counts(logs: DataFrame, path: str, dates: Sequence[str] | None = None) -> None:
    """Replace the stored counts of ``dates`` (ISO days; all days of ``logs`` if not given).

    ``logs`` holds all rows of those days. Days that are not named keep their folders as they are.
    """
    rows = logs
    if dates is not None:
        day = F.to_date(F.col("time").cast("timestamp"))
        rows = logs.filter(day.isin([datetime.strptime(d, "%Y-%m-%d").date() for d in dates]))
    counted = partial_counts(rows).hint("rebalance", "date")
    counted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def _terms(df: DataFrame, **terms: str | None) -> DataFrame:
    for name, value in terms.items():
        if value is not None and value != ANY:
            df = df.filter(F.col(TERMS[name]) == value)
    return df


def count_logs_stored(spark: SparkSession, path: str, logs: DataFrame, start_s: int, end_s: int, **terms: str | None) -> DataFrame:
    """``start_s, count`` of the windows with events strictly between two epoch seconds (both excluded).

    Equal to counting ``search_logs(logs, ...)`` by window, if the stored counts are up to date.
    """
    low = start_s + 1  # the first second that counts
    first, last = -(-low // WINDOW_S) * WINDOW_S, end_s // WINDOW_S * WINDOW_S  # whole windows begin in [first, last)
    stored = _terms(spark.read.schema(COUNTS).parquet(path), **terms)
    if first < last:
        days = [datetime.fromtimestamp(s, timezone.utc).date() for s in (first, last - 1)]
        stored = stored.filter(F.col("date").between(F.lit(days[0]), F.lit(days[1])) & (F.col("start_s") >= first) & (F.col("start_s") < last))
        ragged = [(start_s, first), (last - 1, end_s)]
    else:
        stored, ragged = stored.filter(F.lit(False)), [(start_s, end_s)]
    parts = stored.select("start_s", "count")
    for a, b in ragged:
        if b - a > 1:
            raw = search_logs(logs, a, b, **terms)
            parts = parts.unionByName(raw.groupBy(_start("time").alias("start_s")).agg(F.count(F.lit(1)).alias("count")))
    return parts.groupBy("start_s").agg(F.sum("count").cast("bigint").alias("count"))
