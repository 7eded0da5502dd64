"""File sinks: compaction, results, routed documents, retention, batches, upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import string_to_array
from ..operators.ordering import top_within
from ..operators.sets import union_docs

# Plugins whose documents have no folder level for the document type.
FLAT_PLUGINS = ["mysql", "mongod", "postgres", "tpcc", "jmeter", "jvm"]
# Plugins whose folder has another name.
FOLDER_NAMES = {"elasticsearch": "elasticsearchagent"}


def pack(sizes: dict[str, int], bins: int, most: int) -> list[list[str]]:
    """Files dealt out by first fit, largest first, into about ``bins`` bins of at most ``most`` bytes.

    A bin takes as much as ``bins`` of them need, a little more until so few are enough, but never more than
    ``most``: then there are as many as it takes. A file larger than that has a bin of its own.
    """
    room = min(most, max([1, -(-sum(sizes.values()) // bins), *sizes.values()]))
    while True:
        packed: list[list[str]] = []
        left: list[int] = []
        for path in sorted(sizes, key=lambda p: (-sizes[p], p)):
            at = next((i for i, free in enumerate(left) if sizes[path] <= free), len(packed))
            if at == len(packed):
                packed.append([])
                left.append(room)
            packed[at].append(path)
            left[at] -= sizes[path]
        if len(packed) <= bins or room >= most:
            return packed
        room = min(most, room + room // 20 + 1)


def packed_rows(spark: SparkSession, src: str, bins: Sequence[Sequence[str]], cols: Sequence[str]) -> DataFrame:
    """Rows of an ORC table's files, each bin read by one task, in place: nothing is shuffled."""
    schema = spark.read.orc(src).schema
    reader = spark.read.schema(schema).option("basePath", src)
    parts = [reader.orc(list(paths)).select(*cols).coalesce(1) for paths in bins]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out


def compact_day(
    spark: SparkSession,
    src: str,
    out: str,
    year: int,
    month: int,
    day: int,
    files: int = 10,
    max_file_bytes: int = 4 * 1024**3,
    per_job: int = 200,
) -> str:
    """One day of the partitioned ingest layout into few files under ``out/Y/M/D``.

    The day's files are listed with their sizes and packed into bins; a task reads the files of a bin
    and writes one, so rows move nowhere else. Fails if the target exists. ``files`` is how many
    files a day usually gets; a day too large for that gets as many as keep each below
    ``max_file_bytes`` (a file larger than that already stays one), ``per_job`` of them in a job.
    """
    folder = f"{src.rstrip('/')}/year={year}/month={month}/day={day}"
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.orc").load(folder).select("path", "length")
    sizes = {r["path"]: r["length"] for r in listed.collect()}  # one row for each file of the day
    bins = pack(sizes, files, max_file_bytes)
    target = f"{out.rstrip('/')}/{year}/{month}/{day}"
    cols = ["data", "year", "month", "day"]
    if not bins:
        spark.read.orc(src).select(*cols).limit(0).write.orc(target)
    for at in range(0, len(bins), per_job):
        rows = packed_rows(spark, src, bins[at : at + per_job], cols)
        rows.write.mode("errorifexists" if at == 0 else "append").orc(target)
    return target


def write_result(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").orc(path)
    return path


def read_result(spark: SparkSession, root: str, query_id: str) -> DataFrame:
    """The stored result of a query."""
    return spark.read.orc(f"{root.rstrip('/')}/{query_id}")


def insert_overwrite_directory(df: DataFrame, path: str, view: str = "insert_overwrite_source") -> str:
    """``INSERT OVERWRITE DIRECTORY`` of a table as delimited text."""
    df.createOrReplaceTempView(view)
    spark = df.sparkSession
    spark.sql(f"INSERT OVERWRITE DIRECTORY '{path}' USING csv OPTIONS (sep '\x01') SELECT * FROM {view}")
    spark.catalog.dropTempView(view)
    return path


def flat_documents(df: DataFrame) -> DataFrame:
    """Documents ready to write: internal type dropped, JSON-in-text arrays parsed (as new columns' values)."""
    out = df.drop("actual_plugin_type")
    texts = [f.name for f in out.schema.fields if isinstance(f.dataType, T.StringType) and f.name.endswith("_json")]
    return out.withColumns({t[: -len("_json")]: string_to_array(F.col(t)) for t in texts}).drop(*texts)


def route_columns(df: DataFrame) -> DataFrame:
    """Folder levels of each document: ``dir_plugin``, ``dir_type`` (``-`` for flat plugins), ``dir_instance``."""
    plugin = F.col("_plugin")
    renamed = plugin
    for name, folder in FOLDER_NAMES.items():
        renamed = F.when(plugin == name, F.lit(folder)).otherwise(renamed)
    instance = F.col("plugin_instance") if "plugin_instance" in df.columns else F.lit(None).cast("string")
    return df.withColumns(
        {
            "dir_plugin": renamed,
            "dir_type": F.when(plugin.isin(FLAT_PLUGINS), F.lit("-")).otherwise(F.col("_documentType")),
            "dir_instance": F.coalesce(instance, F.lit("-")),
        }
    )


def write_docs(df: DataFrame, path: str) -> str:
    """JSON documents, one folder per plugin, type and instance.

    Rows are rebalanced by route first: few files per folder, and Spark splits a route
    that is too large for one task.
    """
    routed = route_columns(df)
    levels = ["dir_plugin", "dir_type", "dir_instance"]
    routed.hint("rebalance", *levels).write.mode("append").partitionBy(*levels).json(path)
    return path


def keep_latest(df: DataFrame, keys: Sequence[str], time: str, n: int = 10, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The newest ``n`` documents of each route."""
    order = [F.col(time).desc(), *[F.col(t).desc() for t in tiebreak]]
    return top_within(df, keys, order, n, "_rank").drop("_rank")


def write_batches(df: DataFrame, path: str, rows: int = 500) -> str:
    """Newline-delimited JSON, at most ``rows`` documents per file; a failed task fails the write."""
    df.write.mode("append").option("maxRecordsPerFile", rows).json(path)
    return path


def upsert(current: DataFrame, updates: DataFrame, key: Sequence[str] | str, version: str) -> DataFrame:
    """Current rows with updates applied: per column, the newest value that is not NULL."""
    keys = [key] if isinstance(key, str) else list(key)
    rows = union_docs(current, updates)
    aggs = [F.max(version).alias(version)]
    for c in rows.columns:
        if c in keys or c == version:
            continue
        known = F.col(c).isNotNull()
        aggs.append(F.max_by(F.when(known, F.col(c)), F.when(known, F.col(version))).alias(c))
    return rows.groupBy(*keys).agg(*aggs).select(*rows.columns)
