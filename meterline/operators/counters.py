"""Counter snapshots to deltas, rates, ratios of deltas and latencies.

One parameterised operator covers every reset, first-sample, gate and gap rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import epoch_seconds
from .slices import ROWS_PER_SLICE, same_keys, with_previous

RESETS = ("raw", "zero", "current", "null", "drop_batch")
FIRSTS = ("null", "zero", "drop", "passthrough")


def check_policies(reset: str, first: str) -> None:
    if reset not in RESETS:
        raise ValueError(f"reset must be one of {RESETS}, not {reset!r}")
    if first not in FIRSTS:
        raise ValueError(f"first must be one of {FIRSTS}, not {first!r}")


def delta_value(
    cur: Column,
    prev: Column,
    has_prev: Column,
    reset: str,
    first: str,
    gate_delta: Column | None = None,
    elapsed_s: Column | None = None,
    max_gap_s: float | None = None,
) -> Column:
    """The delta of one counter under the given rules (shared by batch and stream)."""
    diff = cur - prev
    if reset == "zero":
        diff = F.when(diff < 0, F.lit(0)).otherwise(diff)
    elif reset == "current":
        diff = F.when(diff < 0, cur).otherwise(diff)
    elif reset == "null":
        diff = F.when(diff >= 0, diff)
    if gate_delta is not None:
        diff = F.when(gate_delta > 0, diff).otherwise(F.lit(0))
    if max_gap_s is not None:
        diff = F.when(elapsed_s > max_gap_s, F.lit(0)).otherwise(diff)
    if first == "zero":
        start = F.lit(0)
    elif first == "passthrough":
        start = cur
    else:
        start = F.lit(None)
    return F.when(has_prev, diff).otherwise(start)


def counter_delta(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    cols: Sequence[str],
    reset: str = "raw",
    first: str = "null",
    gate: str | None = None,
    max_gap_s: float | None = None,
    poll: Sequence[str] | None = None,
    tiebreak: Sequence[str] = (),
    suffix: str = "_delta",
    keep_elapsed: bool = False,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Difference of each counter from the previous sample of the same series.

    ``reset`` says what a negative difference becomes: kept (``raw``), 0 (``zero``),
    the current value (``current``), NULL (``null``), or the loss of the whole poll
    (``drop_batch``; ``poll`` names the columns that identify a poll).
    ``first`` does the same for the first sample: NULL, 0, the row dropped, or the raw
    value passed through. With ``gate`` all deltas are 0 unless that counter grew;
    after a gap longer than ``max_gap_s`` they are 0.
    """
    check_policies(reset, first)
    if reset == "drop_batch" and not poll:
        raise ValueError("drop_batch needs the columns that identify a poll")
    wanted = list(dict.fromkeys([*cols, *([gate] if gate else [])]))
    rows = with_previous(df, keys, time, wanted, tiebreak, rows_per_slice)
    has_prev = F.col("_prev").isNotNull()
    elapsed = epoch_seconds(time) - epoch_seconds(F.col("_prev")[time])
    gate_delta = F.col(gate) - F.col("_prev")[gate] if gate else None
    deltas = {
        f"{c}{suffix}": delta_value(
            F.col(c), F.col("_prev")[c], has_prev, reset, first, gate_delta, elapsed, max_gap_s
        )
        for c in cols
    }
    if reset == "drop_batch":
        negative = F.lit(False)
        for c in cols:
            negative = negative | F.coalesce(F.col(c) - F.col("_prev")[c] < 0, F.lit(False))
        names = [f"_poll{i}" for i in range(len(poll))]
        bad = rows.filter(negative).select(*[F.col(p).alias(n) for p, n in zip(poll, names)]).distinct()
        rows = rows.join(bad, same_keys(poll, names), "left_anti")
    if first == "drop":
        rows = rows.filter(has_prev)
    if keep_elapsed:
        deltas["elapsed_s"] = elapsed
    return rows.withColumns(deltas).drop("_prev")


def counter_rate(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    cols: Sequence[str],
    per: str = "elapsed",
    interval_s: float | str | None = None,
    reset: str = "raw",
    first: str = "null",
    digits: int | None = None,
    tiebreak: Sequence[str] = (),
    suffix: str = "_rate",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Delta per second.

    ``per="elapsed"`` divides by the whole seconds between the samples (NULL unless
    they moved forward); ``per="interval"`` divides by the nominal poll interval,
    a number or the name of a column.
    """
    if per not in ("elapsed", "interval"):
        raise ValueError("per must be 'elapsed' or 'interval'")
    if per == "interval" and interval_s is None:
        raise ValueError("per='interval' needs interval_s")
    rows = counter_delta(
        df, keys, time, cols, reset=reset, first=first, tiebreak=tiebreak,
        suffix="_d", keep_elapsed=True, rows_per_slice=rows_per_slice,
    )
    if per == "elapsed":
        seconds = F.when(F.col("elapsed_s") > 0, F.col("elapsed_s"))
        if first in ("zero", "passthrough"):
            seconds = F.when(F.col("elapsed_s").isNull(), F.lit(1)).otherwise(seconds)
    else:
        seconds = F.col(interval_s) if isinstance(interval_s, str) else F.lit(interval_s)
    out = {}
    for c in cols:
        rate = F.col(f"{c}_d").cast("double") / seconds.cast("double")
        out[f"{c}{suffix}"] = rate if digits is None else F.round(rate, digits)
    return rows.withColumns(out).drop("elapsed_s", *[f"{c}_d" for c in cols])


def drop_first_sample(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    tiebreak: Sequence[str] = (),
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Remove the first sample of each series.

    The first sample is the minimum of the order columns, so a map-side combined
    aggregate finds it and no window is needed.
    """
    names = [f"_first{i}" for i in range(len(keys))]
    rank = F.struct(time, *tiebreak)
    firsts = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.min(rank).alias("_rank"))
    joined = df.join(firsts, same_keys(keys, names), "left")
    return joined.filter(rank > F.col("_rank")).drop(*names, "_rank")


def cpu_percent(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    cpu_ns: str,
    vcpus: str,
    tiebreak: Sequence[str] = (),
    name: str = "cpu_percent",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Virtual machine CPU use between two samples; NULL after a restart."""
    rows = with_previous(df, keys, time, [cpu_ns], tiebreak, rows_per_slice)
    used = F.col(cpu_ns) - F.col("_prev")[cpu_ns]
    seconds = epoch_seconds(time) - epoch_seconds(F.col("_prev")[time])
    value = F.lit(100.0) * used / (seconds * F.col(vcpus) * F.lit(1e9))
    return rows.withColumn(name, F.when((used >= 0) & (seconds > 0), value)).drop("_prev")


def last_value_per_series(df: DataFrame, series: Sequence[str], time: str, value: str) -> DataFrame:
    """Newest value of each series that is neither NULL nor 0."""
    usable = F.col(value).isNotNull() & (F.col(value) != 0)
    return df.groupBy(*series).agg(
        F.max_by(F.when(usable, F.col(value)), F.when(usable, F.col(time))).alias(value),
        F.max(F.when(usable, F.col(time))).alias(time),
    )
