"""Helpers shared by the operators: text keys, scratch tables, sorted-run grouping, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterline.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: list[list[str]] = []  # tables of the stage that ``stage_scratch`` watches


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: later jobs start from files
    that every executor reaches, so nothing upstream runs twice or is lost."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    if _made:
        _made[-1].append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def delete_paths(spark: SparkSession, paths: Iterable[str]) -> None:
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(conf).delete(place, True)


def discard(df: DataFrame) -> None:
    """Delete a ``stored`` table that nothing reads any more: what was made from it is stored too."""
    delete_paths(df.sparkSession, [df.scratch])


@contextmanager
def stage_scratch() -> Iterator[list[str]]:
    """Names of the tables that are stored meanwhile, for whoever knows when they are done with."""
    _made.append([])
    try:
        yield _made[-1]
    finally:
        _made.pop()


def text_key(text: Column) -> Column:
    """128-bit key of a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def sorted_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``keys`` as tables; the input is sorted by ``keys``.

    Only the run at hand is held, which callers keep bounded by cutting large groups into
    blocks beforehand.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        begin = 0
        for i, row in enumerate(rows):
            if row != last:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, begin, last = [], i, row
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    Each step is a minimum per node (combined before the shuffle) and a join back to the
    edges. The edges of a node pass through one task of that join, one after the other and without
    being held; a component of very many nodes ends as a star, so the last steps have such a node.
    Tables between steps are written to the shared folder. Returns ``node, root`` for every node that has an edge,
    ``root`` being the smallest node of its component.
    """

    def shape(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = stored(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges"
    )
    before = shape(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))
        )).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        last, now = now, stored(small, "edges")
        after = shape(now)
        discard(last)
        if after == before:
            break
        before = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
