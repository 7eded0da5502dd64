"""Log search: filtered rows, and counts per window."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import epoch_seconds
from ..operators.aggregates import count_windows
from ..operators.ordering import add_index
from ..operators.projections import ANY

FIELDS = ["time", "_documentType", "message", "_tag_appName", "_plugin", "level"]


def _instant(seconds: int, kind: T.DataType) -> Column:
    """A literal of the column's own type, so that the comparison reaches the file reader."""
    if isinstance(kind, T.TimestampNTZType):
        text = datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%d %H:%M:%S")
        return F.lit(text).cast("timestamp_ntz")
    return F.timestamp_seconds(F.lit(seconds))


def _days(df: DataFrame, start_s: int, end_s: int) -> DataFrame:
    """Partition predicate for the dates the range touches (one day of slack for the zone)."""
    if not {"year", "month", "day"} <= set(df.columns):
        return df
    first = datetime.fromtimestamp(start_s - 86_400, timezone.utc).date()
    last = datetime.fromtimestamp(end_s + 86_400, timezone.utc).date()
    return df.filter(F.make_date("year", "month", "day").between(F.lit(first), F.lit(last)))


def search_logs(
    df: DataFrame,
    start_s: int,
    end_s: int,
    tag: str | None = None,
    plugin: str | None = None,
    level: str | None = None,
    doc_type: str = ANY,
) -> DataFrame:
    """Events strictly between two epoch seconds (both ends excluded) that match the terms.

    A term that is None or ``*`` sets no predicate, so NULL values stay; a given term never
    matches NULL. The range is stated on the timestamp itself: whole seconds after
    ``start_s`` begin one second later.
    """
    nested = "data" in df.columns
    kind = (df.schema["data"].dataType["time"] if nested else df.schema["time"]).dataType
    rows = _days(df, start_s, end_s)
    rows = rows.select(*[f"data.{f}" for f in FIELDS]) if nested else rows
    rows = rows.filter((F.col("time") >= _instant(start_s + 1, kind)) & (F.col("time") < _instant(end_s, kind)))
    for col, value in (("_tag_appName", tag), ("_plugin", plugin), ("level", level), ("_documentType", doc_type)):
        if value is not None and value != ANY:
            rows = rows.filter(F.col(col) == value)
    return rows


def count_logs(df: DataFrame, start_s: int, end_s: int, width: str = "5 minutes", **terms) -> DataFrame:
    """Matching events per window: start, end, count, timestamp, index."""
    return add_index(count_windows(search_logs(df, start_s, end_s, **terms), "time", width), "start")


def find_logs(df: DataFrame, start_s: int, end_s: int, tiebreak=("message",), **terms) -> DataFrame:
    """Matching events in time order with an index, numbered without gathering them."""
    rows = search_logs(df, start_s, end_s, **terms).withColumn("timestamp", epoch_seconds("time"))
    return add_index(rows, "timestamp", tiebreak, distributed=True)
