"""High-water marks and lifecycle state for incremental jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sinks.versions import Versions

IDS = "id STRING"
MARK_SCHEMA = "name STRING, mark BIGINT, last_id STRING, written_at TIMESTAMP"
# States after which a workflow is analysed.
TERMINAL_STATES = ["SUCCEEDED", "KILLED", "FAILED"]


def empty_marks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MARK_SCHEMA)


def read_marks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MARK_SCHEMA).parquet(path)


def newest_mark(marks: DataFrame, name: str) -> DataFrame:
    """The one-row mark of a job (no row before its first run)."""
    mine = marks.filter(F.col("name") == name)
    return mine.groupBy("name").agg(F.max_by(F.struct("mark", "last_id"), F.struct("mark", "written_at")).alias("m"))


def read_since(
    df: DataFrame, mark_col: str, marks: DataFrame, name: str, id_col: str | None = None, default: int | None = None
) -> DataFrame:
    """Rows at or past the mark, without the row the mark was taken from.

    Without a mark yet, ``default`` (such as the current time) stands in; with neither, all rows.
    """
    now = newest_mark(marks, name)
    mark = F.coalesce(now.select("m.mark").scalar(), F.lit(default))
    fresh = df.filter(F.coalesce(F.col(mark_col) >= mark, mark.isNull()))
    if id_col is None:
        return fresh
    last = now.select("m.last_id").scalar()
    return fresh.filter(F.coalesce(F.col(id_col).cast("string") != last, F.lit(True)))


def advance_mark(processed: DataFrame, mark_col: str, path: str, name: str, id_col: str | None = None) -> None:
    """Append the new mark; call it after the write of ``processed`` has succeeded.

    Marks are only ever appended, so a job that dies before this line keeps the old one.
    """
    ident: Column = F.col(id_col).cast("string") if id_col else F.lit(None).cast("string")
    top = processed.agg(
        F.max(mark_col).cast("bigint").alias("mark"), F.max_by(ident, F.struct(mark_col, ident)).alias("last_id")
    ).filter(F.col("mark").isNotNull())
    top.select(
        F.lit(name).alias("name"), "mark", "last_id", F.current_timestamp().alias("written_at")
    ).write.mode("append").parquet(path)


def advance_lifecycle(
    current: DataFrame,
    updates: DataFrame,
    now_s: Column | int,
    key: str = "wfId",
    timeout_s: int = 86_400,
    terminal: Sequence[str] = tuple(TERMINAL_STATES),
) -> DataFrame:
    """Workflow documents after a look at their current state.

    ``current``: key, status, time (epoch s), workflowMonitorStatus. ``updates``: key, status.
    Terminal states become ``processed``; running ones stay; any other takes its new status
    and is given up (``processed``) when it is older than the timeout.
    """
    now = now_s if isinstance(now_s, Column) else F.lit(now_s)
    seen = updates.select(F.col(key).alias("_uk"), F.col("status").alias("_us"))
    rows = current.join(seen, F.col(key) == F.col("_uk"), "left")
    waiting = F.coalesce(F.col("workflowMonitorStatus") == "init", F.lit(False)) & F.col("_us").isNotNull()
    ended = waiting & F.col("_us").isin(list(terminal))
    other = waiting & ~F.col("_us").isin([*terminal, "RUNNING"])
    expired = other & (now - F.col("time") > timeout_s)
    return rows.withColumns(
        {
            "status": F.when(ended | other, F.col("_us")).otherwise(F.col("status")),
            "workflowMonitorStatus": F.when(ended | expired, F.lit("processed")).otherwise(
                F.col("workflowMonitorStatus")
            ),
        }
    ).drop("_uk", "_us")


def _marks(spark: SparkSession, path: str, name: str) -> Versions:
    return Versions(spark, f"{path.rstrip('/')}/{name}")


def advance_mark_set(processed: DataFrame, mark_col: str, id_col: str, path: str, name: str, keep: int = 2) -> None:
    """Move a job's mark to the newest value of ``processed``; call it after the write has succeeded.

    The mark holds the ids that were processed at its value, so rows tied there are told apart one by
    one. The ids are a table of their own, however many; the mark is replaced in one step, and all but the
    last ``keep`` marks are removed. Rows older than the mark do not move it back.
    """
    spark = processed.sparkSession
    versions = _marks(spark, path, name)
    number, state = versions.latest()
    top = processed.agg(F.max(mark_col).cast("bigint")).first()[0]
    if top is None or top < state.get("mark", top):
        return
    ids = processed.filter(F.col(mark_col) == top).select(F.col(id_col).cast("string").alias("id"))
    if top == state.get("mark"):
        ids = ids.unionByName(spark.read.schema(IDS).parquet(state["ids"]))
    folder = versions.new_folder("ids")
    ids.dropna().distinct().write.parquet(folder)
    versions.commit(number, {"mark": top, "ids": folder})
    versions.prune(keep, lambda s: {s["ids"]})


def read_after(df: DataFrame, mark_col: str, id_col: str, path: str, name: str, default: int | None = None) -> DataFrame:
    """Rows past the mark, and those at it whose id has not been processed.

    Only rows at the mark are joined with its ids. Without a mark yet ``default`` stands in (such as the
    current time); with neither, all rows. Rows without an id at the mark are read again.
    """
    _, state = _marks(df.sparkSession, path, name).latest()
    if not state:
        return df if default is None else df.filter(F.col(mark_col) >= default)
    done = df.sparkSession.read.schema(IDS).parquet(state["ids"]).withColumnRenamed("id", "_done")
    tied = df.filter(F.col(mark_col) == state["mark"]).join(done, F.col(id_col).cast("string") == F.col("_done"), "left_anti")
    return df.filter(F.col(mark_col) > state["mark"]).unionByName(tied)
