"""Row indexes, ranks, top-k, paging and global sorts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .slices import ROWS_PER_SLICE, row_number_within

PARTITION_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def add_index(
    df: DataFrame,
    order: Sequence[str] | str,
    tiebreak: Sequence[str] = (),
    distributed: bool = False,
    name: str = "index",
) -> DataFrame:
    """1-based row number over the whole table.

    The plain form is one global window: right for results whose size follows the
    time range (counts per window). ``distributed=True`` is for raw rows: a range
    partitioning on the order columns puts the rows in order without gathering them,
    each partition numbers its own, and the row counts of the partitions (one row per
    partition) give the offsets. The ranged rows are checkpointed first, because the
    counts and the rows must come from one and the same partitioning.
    """
    cols = [order, *tiebreak] if isinstance(order, str) else [*order, *tiebreak]
    if not distributed:
        return df.withColumn(name, F.row_number().over(Window.orderBy(*cols)))
    ensure_checkpoint_dir(df.sparkSession)
    numbered = (
        df.repartitionByRange(*cols)
        .sortWithinPartitions(*cols)
        .withColumn("_row", F.monotonically_increasing_id())
        .checkpoint()
    )
    part = F.shiftright("_row", PARTITION_BITS)
    offsets = numbered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = offsets.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = numbered.join(F.broadcast(offsets), part == F.col("_part"))
    local = F.col("_row") - F.shiftleft(F.col("_part"), PARTITION_BITS)
    return joined.withColumn(name, local + F.col("_before") + 1).drop("_row", "_part", "_before")


def rank_within(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    tiebreak: Sequence[str] = (),
    descending: bool = True,
    name: str = "order",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """1-based rank of every row inside its group, largest first by default."""
    return row_number_within(df, group, order, tiebreak, descending, rows_per_slice, name)


def top_within(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, name: str = "order"
) -> DataFrame:
    """The first ``n`` rows of each group.

    The ``<= n`` filter on ``row_number`` becomes a partial limit before the shuffle,
    so a large group sends at most ``n`` rows per map task.
    """
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(name) <= n)


def number_groups(
    df: DataFrame,
    order: str,
    groups: int = 4,
    tiles: int | str = 1,
    part: Sequence[str] = (),
    tiebreak: Sequence[str] = (),
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Positional ``group`` and ``phase`` numbers of lines that list them implicitly.

    Lines repeat groups 1..``groups`` for each tile; when all tiles are through, the
    next phase begins. ``tiles`` is a number or a column name.
    """
    rows = row_number_within(df, part, order, tiebreak, rows_per_slice=rows_per_slice, name="_pos")
    n = F.col("_pos") - 1
    per_phase = F.lit(groups) * (F.col(tiles) if isinstance(tiles, str) else F.lit(tiles))
    return rows.withColumns(
        {
            "group": (n % groups + 1).cast("int"),
            "phase": (F.floor(n / per_phase) + 1).cast("int"),
        }
    ).drop("_pos")


def long_running(
    df: DataFrame,
    min_runtime: Column,
    n: int = 20,
    runtime: str = "runtime",
    state: str = "state",
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """The ``n`` longest-running active sessions above a threshold."""
    busy = df.filter((F.col(runtime) > min_runtime) & (F.col(state) == "active"))
    return busy.orderBy(F.col(runtime).desc(), *[F.col(t) for t in tiebreak]).limit(n)


def by_size(df: DataFrame, col: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Largest first."""
    return df.orderBy(F.col(col).desc(), *[F.col(t) for t in tiebreak])


def search_page(
    df: DataFrame, terms: dict, sort: Sequence[str] | str, offset: int = 0, size: int = 500
) -> DataFrame:
    """Equality terms ANDed, sorted, one page of the result."""
    out = df
    for column, value in terms.items():
        out = out.filter(F.col(column) == F.lit(value))
    cols = [sort] if isinstance(sort, str) else list(sort)
    return out.orderBy(*cols).offset(offset).limit(size)


def find_one(df: DataFrame, terms: dict) -> DataFrame:
    """The row that matches all terms, provided exactly one does; otherwise no row."""
    hits = df
    for column, value in terms.items():
        hits = hits.filter(F.col(column) == F.lit(value))
    two = hits.limit(2)
    return two.withColumn("_hits", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))).filter(
        "_hits = 1"
    ).drop("_hits")


def generate_records(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """``n`` records of 100 bytes: a 10-byte random key and a 90-byte payload."""
    row = F.col("id")
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), row.cast("string")), 256)
    payload = F.rpad(F.concat(F.lpad(row.cast("string"), 20, "0"), digest), 90, "X")
    return spark.range(n).select(F.substring(digest, 1, 10).alias("key"), payload.alias("payload"))


def global_sort(df: DataFrame, key: str | Sequence[str], parts: int | None = None) -> DataFrame:
    """Total order over range partitions: as many as Spark sees fit, or ``parts``."""
    keys = [key] if isinstance(key, str) else list(key)
    ranged = df.repartitionByRange(*keys) if parts is None else df.repartitionByRange(parts, *keys)
    return ranged.sortWithinPartitions(*keys)


def top_processes(
    df: DataFrame,
    by: str = "cpu",
    n: int = 5,
    pattern: str | None = None,
    group: Sequence[str] = ("host", "time"),
    name: str = "processname",
    tiebreak: Sequence[str] = ("pid",),
) -> DataFrame:
    """Busiest processes of each host and poll; ``pattern`` keeps matching names only."""
    rows = df.filter(F.col(name).rlike(pattern)) if pattern else df
    return top_within(rows, group, [F.col(by).desc(), *[F.col(t) for t in tiebreak]], n)


def preview(df: DataFrame, n: int = 10) -> DataFrame:
    return df.limit(n)
