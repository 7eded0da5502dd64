"""Ordered work inside groups of any size.

A window over ``partitionBy(key)`` sends every row of one key to one task. Here
keys that hold a large share of the rows are first cut into *slices*: ranges of
the order column, numbered upwards. Work inside a slice is an ordinary window
partitioned by key **and** slice; what must cross a slice border (the last row,
the last value seen, a row count) travels in a small edge table with one row per
hot slice.

Operators that follow one another on the same keys and order can share one slicing:
pass them the result of ``slice_groups`` and drop its columns with ``drop_slices`` at
the end. Windows are partitioned by ``_width`` too, which a key determines anyway, so
that the filter of the edge tables is pushed below them: where no key is hot, AQE finds
an empty broadcast side and removes the edge branches before they read anything.

Size bounds. Candidates are the keys with more than ``rows_per_slice`` rows. A candidate
is hot when it holds more than ``piece`` rows, where ``piece`` is the larger of
``rows_per_slice`` and the candidates' rows / ``HOT_LIMIT``. So there are fewer than
``HOT_LIMIT`` hot keys and at most ``2 * SPREAD * HOT_LIMIT`` slices in all, however
large the input is. Ranges that hold a burst are cut once more; there are fewer than
``HOT_LIMIT`` of those, and their parts are bounded in the same way. All three tables are
therefore safe to broadcast. Every other key stays in slice 0 and costs nothing beyond
the count.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOT_LIMIT = 16_384
SPREAD = 16
ROWS_PER_SLICE = 1_000_000
SLICE = "_slice"
WIDTH = "_width"
MAX_SUBS = 1 << 20  # above 2 * SPREAD * HOT_LIMIT, the most parts one range can be cut into


def position(df: DataFrame, order: str) -> Column:
    """The order column as a DOUBLE that grows with it."""
    kind = df.schema[order].dataType
    col = F.col(order)
    if isinstance(kind, T.TimestampNTZType):
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), col).cast("double")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("double")
    if isinstance(kind, T.NumericType):
        return col.cast("double")
    raise TypeError(f"{order}: rows cannot be sliced by a {kind.simpleString()} column")


def same_keys(left: Sequence[str], right: Sequence[str]) -> Column:
    """Null-safe equality of two key lists."""
    cond = F.lit(True)
    for a, b in zip(left, right):
        cond = cond & F.col(a).eqNullSafe(F.col(b))
    return cond


def slice_groups(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    rows_per_slice: int = ROWS_PER_SLICE,
    descending: bool = False,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Add ``_slice`` (0 for ordinary keys, growing with the order for hot ones) and ``_width``.

    ``_width`` is set on rows of hot keys only; filtering on it lets Catalyst turn
    the left joins into inner ones, so ordinary rows never reach the edge table.

    A hot key is cut into ranges of equal width between its smallest and its largest finite
    position; infinities and NaN have slices of their own at the ends, so that one of them cannot
    stretch the ranges. With no keys, all rows are one group. A range that still holds more than
    ``piece`` rows (a burst) is cut again between its own first and last position, and if
    all its rows share one order value, by the first tiebreak column.
    """
    if not keys:
        # a key that is always 0, which the optimizer cannot know: the joins below stay equi-joins
        whole = df.withColumn("_whole", F.pmod(F.xxhash64(order), F.lit(1)))
        return slice_groups(whole, ["_whole"], order, rows_per_slice, descending, tiebreak).drop("_whole")
    pos = position(df, order)
    names = [f"_hot{i}" for i in range(len(keys))]
    finite = F.when(F.abs(pos) < F.lit(float("inf")), pos)
    stats = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(
        F.count(F.lit(1)).alias("_n"), F.min(finite).alias("_lo"), F.max(finite).alias("_hi")
    )
    # at most one candidate per ``rows_per_slice`` input rows, so one task can add them up
    share = F.sum("_n").over(Window.partitionBy(F.lit(0))) / F.lit(HOT_LIMIT)
    spread = F.col("_hi") > F.col("_lo")
    hot = (
        stats.filter(F.col("_n") > rows_per_slice)
        .withColumn("_piece", F.greatest(F.lit(float(rows_per_slice)), share))
        .filter(F.col("_n") > F.col("_piece"))
        .withColumn("_slices", F.ceil(F.col("_n") / F.col("_piece")) * F.lit(SPREAD))
        .withColumn(WIDTH, F.when(spread, (F.col("_hi") - F.col("_lo")) / F.col("_slices")).otherwise(F.lit(1.0)))
        .select(*names, "_lo", "_slices", WIDTH, "_piece")
    )
    # in rising order: -Infinity, the ranges, Infinity, NaN
    number = F.least(F.floor((finite - F.col("_lo")) / F.col(WIDTH)), F.col("_slices") - 1) + 1
    number = F.when(finite.isNotNull(), number).when(F.isnan(pos), F.col("_slices") + 2).when(pos > 0, F.col("_slices") + 1).otherwise(F.lit(0))
    if descending:
        number = F.col("_slices") + 2 - number
    # NULL order values sort first going up, last going down
    edge = F.col("_slices") + 3 if descending else F.lit(-1)
    number = F.when(pos.isNull(), edge).otherwise(number)
    cell = F.when(F.col(WIDTH).isNull(), F.lit(0)).otherwise(number + 2).cast("bigint")
    rows = df.join(F.broadcast(hot), same_keys(keys, names), "left").withColumn("_cell", cell)
    rows = rows.drop(*names, "_lo", "_slices")

    tie = _tie_position(df, tiebreak)
    ends = [F.min(pos).alias("_p0"), F.max(pos).alias("_p1"), F.min(tie).alias("_t0"), F.max(tie).alias("_t1")]
    names = [f"_dense{i}" for i in range(len(keys))]
    by_tie = ~F.coalesce(F.col("_p1") > F.col("_p0"), F.lit(False))
    low = F.when(by_tie, F.col("_t0")).otherwise(F.col("_p0"))
    high = F.when(by_tie, F.col("_t1")).otherwise(F.col("_p1"))
    dense = (
        rows.filter(F.col(WIDTH).isNotNull())
        .groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_cell").alias("_dense_cell"))
        .agg(F.count(F.lit(1)).alias("_n"), F.max("_piece").alias("_p"), *ends)
        .filter(F.col("_n") > F.col("_p"))
        .withColumns({"_by_tie": by_tie, "_low": low, "_high": high})
        .filter(F.col("_high") > F.col("_low"))
        .withColumn("_subs", F.ceil(F.col("_n") / F.col("_p")) * F.lit(SPREAD))
        .withColumn("_sub_width", (F.col("_high") - F.col("_low")) / F.col("_subs"))
        .select(*names, "_dense_cell", "_by_tie", "_low", "_subs", "_sub_width")
    )
    cond = same_keys(keys, names) & (F.col("_cell") == F.col("_dense_cell"))
    out = rows.join(F.broadcast(dense), cond, "left")
    at = F.when(F.col("_by_tie"), tie).otherwise(pos)
    sub = F.least(F.floor((at - F.col("_low")) / F.col("_sub_width")), F.col("_subs") - 1)
    if descending:
        # ties are broken upwards even when the order goes down
        sub = F.when(F.col("_by_tie"), sub).otherwise(F.col("_subs") - 1 - sub)
    out = out.withColumn(SLICE, F.col("_cell") * F.lit(MAX_SUBS) + F.coalesce(sub, F.lit(0)))
    return out.drop(*names, "_dense_cell", "_by_tie", "_low", "_subs", "_sub_width", "_cell", "_piece")


def _tie_position(df: DataFrame, tiebreak: Sequence[str]) -> Column:
    """Position of the first tiebreak column, NULL if there is none that has one."""
    if tiebreak:
        try:
            return position(df, tiebreak[0])
        except TypeError:
            pass
    return F.lit(None).cast("double")


def drop_slices(df: DataFrame) -> DataFrame:
    """Remove the columns that ``slice_groups`` added."""
    return df.drop(SLICE, WIDTH)


def _slice_once(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    rows_per_slice: int,
    descending: bool = False,
    tiebreak: Sequence[str] = (),
) -> tuple[DataFrame, list[str]]:
    """The sliced rows, and the slice columns to drop at the end (none if the input came sliced)."""
    if SLICE in df.columns:
        return df, []
    return slice_groups(df, keys, order, rows_per_slice, descending, tiebreak), [SLICE, WIDTH]


def _window(keys: Sequence[str]):
    return Window.partitionBy(*keys, SLICE, WIDTH)


def _edge_table(sliced: DataFrame, keys: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """One row per hot slice; key columns renamed so it can be joined back."""
    renamed = [F.col(k).alias(f"_edge{i}") for i, k in enumerate(keys)]
    return sliced.filter(F.col(WIDTH).isNotNull()).groupBy(*renamed, F.col(SLICE).alias("_edge_slice")).agg(*aggs)


def _before(keys: Sequence[str]) -> tuple[Window, list[str]]:
    names = [f"_edge{i}" for i in range(len(keys))]
    w = Window.partitionBy(*names).orderBy("_edge_slice")
    return w, names


def _join_edges(rows: DataFrame, edges: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    cond = same_keys(keys, names) & (F.col(SLICE) == F.col("_edge_slice"))
    return rows.join(F.broadcast(edges), cond, "left").drop(*names, "_edge_slice")


def _order(order: str, tiebreak: Sequence[str], descending: bool = False) -> list[Column]:
    first = F.col(order).desc() if descending else F.col(order).asc()
    return [first, *[F.col(t).asc() for t in tiebreak]]


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    cols: Sequence[str],
    tiebreak: Sequence[str] = (),
    rows_per_slice: int = ROWS_PER_SLICE,
    name: str = "_prev",
) -> DataFrame:
    """Add the previous row of each key as a struct of ``order`` and ``cols`` (NULL on the first)."""
    fields = list(dict.fromkeys([order, *cols]))
    sliced, extra = _slice_once(df, keys, order, rows_per_slice, tiebreak=tiebreak)
    row = F.struct(*fields)
    local = F.lag(row).over(_window(keys).orderBy(*_order(order, tiebreak)))
    rank = F.struct(order, *tiebreak)
    edges = _edge_table(sliced, keys, [F.max_by(row, rank).alias("_last")])
    w, names = _before(keys)
    edges = edges.withColumn("_carry", F.lag("_last").over(w)).drop("_last")
    out = _join_edges(sliced.withColumn(name, local), edges, keys, names)
    return out.withColumn(name, F.coalesce(name, "_carry")).drop("_carry", *extra)


def carry_forward(
    df: DataFrame,
    part: Sequence[str],
    order: str,
    cols: str | Sequence[str],
    tiebreak: Sequence[str] = (),
    rows_per_slice: int = ROWS_PER_SLICE,
    names: dict[str, str] | None = None,
) -> DataFrame:
    """Fill NULLs of ``cols`` with the last value seen at or before the row.

    ``names`` maps a column to the column that receives the filled value (itself by default).
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    names = names or {}
    sliced, extra = _slice_once(df, part, order, rows_per_slice, tiebreak=tiebreak)
    w_local = _window(part).orderBy(*_order(order, tiebreak))
    w_local = w_local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rank = F.struct(order, *tiebreak)
    lasts = [
        F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), rank)).alias(f"_last{i}")
        for i, c in enumerate(cols)
    ]
    edges = _edge_table(sliced, part, lasts)
    w, edge_names = _before(part)
    w = w.rowsBetween(Window.unboundedPreceding, -1)
    for i in range(len(cols)):
        edges = edges.withColumn(f"_carry{i}", F.last(f"_last{i}", ignorenulls=True).over(w)).drop(f"_last{i}")
    rows = sliced.withColumns({f"_own{i}": F.last(c, ignorenulls=True).over(w_local) for i, c in enumerate(cols)})
    out = _join_edges(rows, edges, part, edge_names)
    out = out.withColumns({names.get(c, c): F.coalesce(f"_own{i}", f"_carry{i}") for i, c in enumerate(cols)})
    return out.drop(*extra, *[f"_own{i}" for i in range(len(cols))], *[f"_carry{i}" for i in range(len(cols))])


@dataclass(frozen=True)
class Scan:
    """An associative step along the rows of a group: ``aggregate`` over some rows, ``combine`` of two results.

    ``reach`` says which rows count: ``"upto"`` those up to the current one, ``"before"`` those before
    it (NULL on the first), ``"whole"`` all of the group. NULL values play no part.
    """

    value: Column
    aggregate: Callable[[Column | str], Column]
    combine: Callable[[Column, Column], Column]
    reach: str = "upto"


def total(value: Column, reach: str = "upto") -> Scan:
    return Scan(value, F.sum, lambda a, b: a + b, reach)


def highest(value: Column, reach: str = "upto") -> Scan:
    return Scan(value, F.max, lambda a, b: F.greatest(a, b), reach)


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    scans: Mapping[str, Scan],
    tiebreak: Sequence[str] = (),
    descending: bool = False,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Add a column for each scan, in groups of any size.

    Inside a slice a scan is a window; what the slices before it come to travels in the edge table,
    one aggregate per slice, and is combined with the window's result. Nothing depends on how the
    rows of a group are cut, since the steps are associative.
    """
    values = {f"_value{i}": s.value for i, s in enumerate(scans.values())}
    sliced, extra = _slice_once(df.withColumns(values), keys, order, rows_per_slice, descending, tiebreak)
    ordered = _window(keys).orderBy(*_order(order, tiebreak, descending))
    frames = {
        "upto": ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow),
        "before": ordered.rowsBetween(Window.unboundedPreceding, -1),
        "whole": _window(keys),
    }
    edges = _edge_table(sliced, keys, [s.aggregate(v).alias(f"_part{i}") for i, (v, s) in enumerate(zip(values, scans.values()))])
    slices, names = _before(keys)
    spans = {"whole": Window.partitionBy(*names)}
    for i, s in enumerate(scans.values()):
        span = spans.get(s.reach, slices.rowsBetween(Window.unboundedPreceding, -1))
        edges = edges.withColumn(f"_carry{i}", s.aggregate(f"_part{i}").over(span))
    edges = edges.drop(*[f"_part{i}" for i in range(len(scans))])
    own = {name: s.aggregate(v).over(frames[s.reach]) for v, (name, s) in zip(values, scans.items())}
    out = _join_edges(sliced.withColumns(own), edges, keys, names)
    both = {}
    for i, (name, s) in enumerate(scans.items()):
        carry, here = F.col(f"_carry{i}"), F.col(name)
        if s.reach == "whole":  # a sliced group's total has the slice's own rows in it
            both[name] = F.coalesce(carry, here)
        else:
            both[name] = F.when(carry.isNull(), here).when(here.isNull(), carry).otherwise(s.combine(carry, here))
    return out.withColumns(both).drop(*values, *[f"_carry{i}" for i in range(len(scans))], *extra)


def with_next(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    col: str,
    tiebreak: Sequence[str] = (),
    rows_per_slice: int = ROWS_PER_SLICE,
    name: str = "_next",
) -> DataFrame:
    """Add ``col`` of the next row of each key (NULL on the last)."""
    sliced, extra = _slice_once(df, keys, order, rows_per_slice, tiebreak=tiebreak)
    local = F.lead(F.struct(col)).over(_window(keys).orderBy(*_order(order, tiebreak)))
    edges = _edge_table(sliced, keys, [F.min_by(F.struct(col), F.struct(order, *tiebreak)).alias("_first")])
    slices, names = _before(keys)
    edges = edges.withColumn("_ahead", F.lead("_first").over(slices)).drop("_first")
    out = _join_edges(sliced.withColumn(name, local), edges, keys, names)
    return out.withColumn(name, F.coalesce(name, "_ahead")[col]).drop("_ahead", *extra)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    weight: Column,
    tiebreak: Sequence[str] = (),
    descending: bool = False,
    rows_per_slice: int = ROWS_PER_SLICE,
    name: str = "running",
) -> DataFrame:
    """Running sum of a weight inside each key, the current row included."""
    weighted = df.withColumn("_weight", weight)
    sliced, extra = _slice_once(weighted, keys, order, rows_per_slice, descending, tiebreak)
    w_local = _window(keys).orderBy(*_order(order, tiebreak, descending))
    w_local = w_local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = _edge_table(sliced, keys, [F.sum("_weight").alias("_sum")])
    w, names = _before(keys)
    w = w.rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.withColumn("_carry", F.sum("_sum").over(w)).drop("_sum")
    rows = sliced.withColumn(name, F.sum("_weight").over(w_local))
    out = _join_edges(rows, edges, keys, names)
    total = F.col(name) + F.coalesce(F.col("_carry"), F.lit(0))
    return out.withColumn(name, total).drop("_carry", "_weight", *extra)


def row_number_within(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    tiebreak: Sequence[str] = (),
    descending: bool = False,
    rows_per_slice: int = ROWS_PER_SLICE,
    name: str = "index",
) -> DataFrame:
    """1-based position inside each key."""
    return running_total(
        df, keys, order, F.lit(1).cast("bigint"), tiebreak, descending, rows_per_slice, name
    )
