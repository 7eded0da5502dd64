"""Snapshots that carry digests of their key ranges, so that equal ranges are not read again.

A snapshot's rows are dealt out by the hash of their key to ``ranges`` folders, and in each to ``CELLS`` cells
in whose order they are stored. Beside them lies a table of digests: for each cell how many rows it has and
two sums over row hashes that do not depend on the order. Two snapshots are compared range by range and
then, in the ranges that differ, cell by cell; only rows of cells that differ are read and joined.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import diff_snapshots, membership_change
from .versions import Versions

CELLS = 64
RANGE, CELL = "_range", "_cell"
DIGESTS = f"{RANGE} INT, {CELL} INT, n BIGINT, a DECIMAL(38,0), b BIGINT"


def _place(keys: Sequence[str], ranges: int) -> tuple[Column, Column]:
    h = F.xxhash64(*keys)
    return F.pmod(h, F.lit(ranges)).cast("int"), F.pmod(F.shiftrightunsigned(h, 32), F.lit(CELLS)).cast("int")


def store_snapshot(df: DataFrame, path: str, keys: Sequence[str], ranges: int = 256) -> str:
    """Write ``df`` as a snapshot; choose ``ranges`` so that one is a few hundred megabytes at most.

    Snapshots can be compared if they agree in keys, columns and ``ranges``.
    """
    spark = df.sparkSession
    versions = Versions(spark, path)
    at, cell = _place(keys, ranges)
    folder = versions.new_folder("rows")
    placed = df.withColumns({RANGE: at, CELL: cell}).hint("rebalance", RANGE)
    placed.sortWithinPartitions(RANGE, CELL).write.partitionBy(RANGE).option("parquet.block.size", 8 << 20).parquet(folder)
    stored = _rows(spark, folder, df.schema)
    first, second = F.xxhash64(*df.columns), F.xxhash64(F.lit(1), *df.columns)
    digests = stored.groupBy(RANGE, CELL).agg(
        F.count(F.lit(1)).alias("n"), F.sum(first.cast("decimal(20,0)")).cast("decimal(38,0)").alias("a"), F.bit_xor(second).alias("b")
    )
    table = versions.new_folder("digests")
    digests.write.parquet(table)
    number, _ = versions.latest()
    versions.commit(number, {"rows": folder, "digests": table, "keys": list(keys), "ranges": ranges, "schema": df.schema.json()})
    return path


def _rows(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    full = T.StructType([*schema.fields, T.StructField(CELL, T.IntegerType()), T.StructField(RANGE, T.IntegerType())])
    return spark.read.schema(full).parquet(folder)


class StoredSnapshot:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        _, self.state = Versions(spark, path).latest()
        self.schema = T.StructType.fromJson(json.loads(self.state["schema"]))

    def digests(self) -> DataFrame:
        return self.spark.read.schema(DIGESTS).parquet(self.state["digests"])

    def rows(self) -> DataFrame:
        return _rows(self.spark, self.state["rows"], self.schema).select(*self.schema.names)

    def changed_rows(self, ranges: Sequence[int], cells: DataFrame) -> DataFrame:
        """Rows of the given cells; only the folders of ``ranges`` are read."""
        rows = _rows(self.spark, self.state["rows"], self.schema).filter(F.col(RANGE).isin([int(r) for r in ranges]))
        return rows.join(cells, [RANGE, CELL], "left_semi").select(*self.schema.names)


def _differing(cur: DataFrame, prev: DataFrame, by: Sequence[str]) -> DataFrame:
    """Places (columns ``by``) whose digests differ, or that one side only has."""
    sums = [F.sum("n").alias("n"), F.sum("a").alias("a"), F.bit_xor("b").alias("b")]
    both = cur.groupBy(*by).agg(*sums).withColumn("_side", F.lit(1)).unionByName(prev.groupBy(*by).agg(*sums).withColumn("_side", F.lit(-1)))
    apart = F.sum(F.col("_side") * F.col("n")) != 0
    apart = apart | (F.sum(F.col("_side") * F.col("a")) != 0) | (F.bit_xor("b") != 0) | (F.count(F.lit(1)) == 1)
    return both.groupBy(*by).agg(apart.alias("_apart")).filter("_apart").select(*by)


def changed_parts(cur: StoredSnapshot, prev: StoredSnapshot) -> tuple[DataFrame, DataFrame]:
    """Rows of both snapshots in the cells that differ; all other rows are the same in both."""
    if any(cur.state[k] != prev.state[k] for k in ("keys", "ranges")) or cur.schema.names != prev.schema.names:
        raise ValueError("snapshots of different keys, columns or ranges cannot be compared by their digests")
    spark, a, b = cur.spark, cur.digests(), prev.digests()
    ranges = [r[0] for r in _differing(a, b, [RANGE]).collect()]  # at most one row for each range
    here = F.col(RANGE).isin(ranges) if ranges else F.lit(False)
    cells = _differing(a.filter(here), b.filter(here), [RANGE, CELL])
    if not ranges:
        return spark.createDataFrame([], cur.schema), spark.createDataFrame([], prev.schema)
    return cur.changed_rows(ranges, cells), prev.changed_rows(ranges, cells)


def stored_membership_change(spark: SparkSession, cur: str, prev: str) -> DataFrame:
    """``membership_change`` of two stored snapshots."""
    now, before = StoredSnapshot(spark, cur), StoredSnapshot(spark, prev)
    a, b = changed_parts(now, before)
    return membership_change(a, b, now.state["keys"])


def stored_difference(
    spark: SparkSession, cur: str, prev: str, cols: Sequence[str], time: str | None = None, interval_s: float | None = None
) -> DataFrame:
    """``diff_snapshots`` of two stored snapshots, for the rows that changed or are new. A row that is the same
    in both has no change in any column and is left out."""
    now, before = StoredSnapshot(spark, cur), StoredSnapshot(spark, prev)
    a, b = changed_parts(now, before)
    return diff_snapshots(a.exceptAll(b), b, now.state["keys"], cols, time, interval_s)
