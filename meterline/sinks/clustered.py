"""Log files laid out for search: clustered by tag and time, with Bloom filters and a table of file ranges.

Rows are put in the order of a space-filling curve (the bits of a tag's hash and of the time, interleaved),
so a file holds few tags over a short time rather than all tags over a day. The ORC writer adds
Bloom filters on the searched columns. A small table tells for every file which times and which tag
hashes it spans; a search reads that table first and hands Spark only the files that can hold a match.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.projections import ANY
from ..plans.log_search import search_logs
from .versions import Versions

BITS = 10
CURVE = "_curve"
BLOOM = ("_tag_appName", "_plugin", "level")
RANGES = "file STRING, low BIGINT, high BIGINT, tag_low INT, tag_high INT, no_tag BOOLEAN, rows BIGINT"


def tag_cell(tag: Column) -> Column:
    """The highest ``BITS`` bits of a tag's hash; NULL has none."""
    return F.when(tag.isNotNull(), F.shiftrightunsigned(F.xxhash64(tag), 64 - BITS).cast("int"))


def interleaved(a: Column, b: Column, bits: int = BITS) -> Column:
    """The bits of two numbers taken in turn, the highest first."""
    out = F.lit(0).cast("bigint")
    for i in range(bits):
        for shift, value in ((2 * i + 1, a), (2 * i, b)):
            bit = F.shiftright(value.cast("bigint"), i).bitwiseAND(F.lit(1))
            out = out.bitwiseOR(F.shiftleft(bit, shift))
    return out


def _micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def write_clustered(rows: DataFrame, path: str, tag: str = "_tag_appName", time: str = "time", files: int | None = None, bloom: Sequence[str] = BLOOM) -> str:
    """Write log rows as a new version of the table at ``path``; ``files`` as Spark sees fit if not given."""
    versions = Versions(rows.sparkSession, path)
    number, _ = versions.latest()
    ends = rows.agg(F.min(_micros(F.col(time))).alias("low"), F.max(_micros(F.col(time))).alias("high"))
    # one row: the whole range of time
    spread = (F.col("high") - F.col("low") + 1) / F.lit(1 << BITS)
    cell = F.floor((_micros(F.col(time)) - F.col("low")) / spread)
    placed = rows.crossJoin(F.broadcast(ends)).withColumn(
        CURVE, interleaved(F.coalesce(tag_cell(F.col(tag)), F.lit(0)), F.coalesce(cell, F.lit(0)))
    ).drop("low", "high")
    order = [CURVE, tag, time]
    ranged = placed.repartitionByRange(*order) if files is None else placed.repartitionByRange(files, *order)
    folder = versions.new_folder("rows")
    writer = ranged.sortWithinPartitions(*order).drop(CURVE).write
    writer.option("orc.bloom.filter.columns", ",".join(bloom)).option("orc.bloom.filter.fpp", "0.01").orc(folder)
    back = rows.sparkSession.read.schema(rows.schema).orc(folder)
    ranges = back.select(F.input_file_name().alias("file"), _micros(F.col(time)).alias("t"), F.col(tag).alias("tag")).groupBy("file").agg(
        F.min("t").alias("low"), F.max("t").alias("high"), F.min(tag_cell(F.col("tag"))).alias("tag_low"), F.max(tag_cell(F.col("tag"))).alias("tag_high"),
        F.some(F.col("tag").isNull()).alias("no_tag"), F.count(F.lit(1)).alias("rows"),
    )
    table = versions.new_folder("ranges")
    ranges.write.parquet(table)
    versions.commit(number, {"rows": folder, "ranges": table, "schema": rows.schema.json()})
    return folder


def files_for(spark: SparkSession, path: str, start_s: int, end_s: int, tag: str | None = None) -> list[str]:
    """Files that can hold events strictly between two epoch seconds, of a tag if one is given."""
    _, state = Versions(spark, path).latest()
    ranges = spark.read.schema(RANGES).parquet(state["ranges"])
    hit = (F.col("high") >= (start_s + 1) * 1_000_000) & (F.col("low") < end_s * 1_000_000)
    if tag is not None and tag != ANY:
        hit = hit & (F.col("tag_low") <= tag_cell(F.lit(tag))) & (F.col("tag_high") >= tag_cell(F.lit(tag)))
    # names of the files to read, which Spark lists on the driver anyway
    return sorted(r["file"] for r in ranges.filter(hit).select("file").collect())


def search_clustered(spark: SparkSession, path: str, start_s: int, end_s: int, tag: str | None = None, **terms) -> DataFrame:
    """``search_logs`` over the files that can hold a match."""
    _, state = Versions(spark, path).latest()
    schema = T.StructType.fromJson(json.loads(state["schema"]))
    files = files_for(spark, path, start_s, end_s, tag)
    rows = spark.read.schema(schema).orc(files) if files else spark.createDataFrame([], schema)
    return search_logs(rows, start_s, end_s, tag, **terms)
