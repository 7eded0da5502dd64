"""Counter deltas over a stream, by the same rules as the batch operator."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.counters import check_policies

RESTARTED = "restarted"

# ship the functions below with the job, so that executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


ELAPSED = "elapsed_s"
_WHOLE = (T.LongType, T.IntegerType, T.ShortType, T.ByteType)
NO_TIME = np.iinfo("int64").min  # what NumPy makes of a missing time


def _values(column: pd.Series) -> list:
    """The column as Python values, which are exact for whole numbers and decimals; None where one is missing."""
    values = column.tolist()
    return [None if v is None or v is pd.NA or v != v else v for v in values]


def _column(values: list, kind: T.DataType):
    """Counter values without a detour by doubles: whole numbers, decimals, or floats."""
    if isinstance(kind, T.DecimalType):
        return np.array([*values, None], dtype=object)[:-1]
    mask = np.array([v is None for v in values], dtype=bool)
    plain = [0 if v is None else v for v in values]
    if isinstance(kind, _WHOLE):
        return pd.arrays.IntegerArray(np.array(plain, dtype="int64"), mask)
    return pd.arrays.FloatingArray(np.array(plain, dtype="float64"), mask)


def _in_order(rows: pd.DataFrame, times: list[int], tiebreak: list[str]) -> list[int]:
    """The places of the rows in order of time, missing values last."""
    ties = [_values(rows[t]) for t in tiebreak]
    ranks = [(t == NO_TIME, t, *[(v[i] is None, 0 if v[i] is None else v[i]) for v in ties]) for i, t in enumerate(times)]
    return sorted(range(len(times)), key=ranks.__getitem__)


def _series_deltas(
    rows: pd.DataFrame, last: tuple | None, time: str, tiebreak: list[str], cols: list[str], wanted: list[str],
    kinds: dict[str, T.DataType], reset: str, first: str, gate: str | None, max_gap_s: float | None, suffix: str,
) -> tuple[pd.DataFrame, tuple | None]:
    """Deltas of one series' new rows in order of time, and the row to remember.

    A stream has many series with a few new rows each, so rows are taken one by one: column
    operations cost far more per call than these rows do.
    """
    times = rows[time].to_numpy("datetime64[us]").astype("int64").tolist()
    if len(times) > 1:
        order = _in_order(rows, times, tiebreak)
        if order != list(range(len(times))):
            rows, times = rows.take(order), [times[i] for i in order]
    now = {w: _values(rows[w]) for w in wanted}
    deltas = {c: [] for c in cols}
    restarted, gaps, kept = [], [], []
    oldest, prev = (None, None) if last is None else (last[0], last)
    for i, t in enumerate(times):
        if oldest is not None and t != NO_TIME and t < oldest:
            for c in cols:
                deltas[c].append(None)
            restarted.append(False)
            gaps.append(None)
            kept.append(True)
            continue
        cur = (t, *[now[w][i] for w in wanted])
        has_prev = prev is not None and prev[0] != NO_TIME
        gap = t // 1_000_000 - prev[0] // 1_000_000 if has_prev and t != NO_TIME else None
        grew = gate is None or (prev is not None and _less(prev[wanted.index(gate) + 1], cur[wanted.index(gate) + 1]))
        fell = False
        for at, c in enumerate(cols, 1):
            value, before = cur[at], None if prev is None else prev[at]
            diff = None if value is None or before is None else value - before
            if diff is not None and diff < 0:
                fell = True
                diff = {"zero": 0, "current": value, "null": None}.get(reset, diff)
            if not grew or (max_gap_s is not None and gap is not None and gap > max_gap_s):
                diff = 0
            if not has_prev:
                diff = {"zero": 0, "passthrough": value}.get(first)
            deltas[c].append(diff)
        restarted.append(fell)
        gaps.append(gap)
        kept.append(has_prev or first != "drop")
        prev = cur
    out = rows.assign(
        **{f"{c}{suffix}": _column(deltas[c], kinds[c]) for c in cols},
        **{RESTARTED: np.array(restarted, dtype=bool), ELAPSED: _column(gaps, T.LongType())},
    )
    if not all(kept):
        out = out[kept]
    if prev is not None and prev[0] == NO_TIME:
        prev = (NO_TIME // 1000, *prev[1:])
    return out, prev


def _less(a, b) -> bool:
    return a is not None and b is not None and a < b


def stream_counter_delta(
    stream: DataFrame,
    keys: Sequence[str],
    time: str,
    cols: Sequence[str],
    reset: str = "raw",
    first: str = "null",
    gate: str | None = None,
    max_gap_s: float | None = None,
    tiebreak: Sequence[str] = (),
    suffix: str = "_delta",
    expire_after_s: float | None = None,
) -> DataFrame:
    """Delta of each counter from the previous sample of its series, across micro-batches.

    State is the last row of each series, exact for whole numbers and decimals. A sample older
    than the remembered one gets NULL and does not replace it. ``restarted`` tells whether a
    counter fell, ``elapsed_s`` how many whole seconds lie between the samples; with
    ``reset="drop_batch"`` pass the batches through ``drop_restarted_polls``.

    ``expire_after_s`` forgets a series once the watermark (which the stream must then have) has
    passed its last sample by that long: a container or process that is gone leaves no state, and one
    that comes back later starts anew.
    """
    check_policies(reset, first)
    keys, cols = list(keys), list(cols)
    wanted = list(dict.fromkeys([*cols, *([gate] if gate else [])]))
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    whole = {w: isinstance(kinds[w], _WHOLE) for w in wanted}
    out_schema = T.StructType(
        [
            *stream.schema.fields,
            *[T.StructField(f"{c}{suffix}", kinds[c]) for c in cols],
            T.StructField(RESTARTED, T.BooleanType()),
            T.StructField(ELAPSED, T.LongType()),
        ]
    )
    state_schema = T.StructType(
        [T.StructField("time_us", T.LongType()), *[T.StructField(w, kinds[w]) for w in wanted]]
    )
    names = [f.name for f in out_schema.fields]

    def update(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = list(chunks)
        rows = rows[0] if len(rows) == 1 else pd.concat(rows, ignore_index=True)
        last = state.get if state.exists else None
        out, last = _series_deltas(rows, last, time, list(tiebreak), cols, wanted, kinds, reset, first, gate, max_gap_s, suffix)
        if last is not None:
            us, *values = last
            exact = lambda w, v: int(v) if whole[w] else v if isinstance(kinds[w], T.DecimalType) else float(v)
            state.update((int(us), *[v if v is None else exact(w, v) for w, v in zip(wanted, values)]))
            if expire_after_s is not None:
                due = int(us) // 1000 + int(expire_after_s * 1000)
                state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield out[names]

    return stream.groupBy(*keys).applyInPandasWithState(
        update, out_schema, state_schema, "append",
        GroupStateTimeout.NoTimeout if expire_after_s is None else GroupStateTimeout.EventTimeTimeout,
    )


def stream_counter_rate(
    stream: DataFrame,
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
    expire_after_s: float | None = None,
) -> DataFrame:
    """Delta per second across micro-batches, by the rules of the batch ``counter_rate``."""
    if per not in ("elapsed", "interval"):
        raise ValueError("per must be 'elapsed' or 'interval'")
    if per == "interval" and interval_s is None:
        raise ValueError("per='interval' needs interval_s")
    rows = stream_counter_delta(
        stream, keys, time, cols, reset=reset, first=first, tiebreak=tiebreak, suffix="_d", expire_after_s=expire_after_s
    )
    if per == "elapsed":
        seconds = F.when(F.col(ELAPSED) > 0, F.col(ELAPSED))
        if first in ("zero", "passthrough"):
            seconds = F.when(F.col(ELAPSED).isNull(), F.lit(1)).otherwise(seconds)
    else:
        seconds = F.col(interval_s) if isinstance(interval_s, str) else F.lit(interval_s)
    out = {}
    for c in cols:
        rate = F.col(f"{c}_d").cast("double") / seconds.cast("double")
        out[f"{c}{suffix}"] = rate if digits is None else F.round(rate, digits)
    return rows.withColumns(out).drop(ELAPSED, *[f"{c}_d" for c in cols])


def drop_restarted_polls(batch: DataFrame, poll: Sequence[str]) -> DataFrame:
    """Rows of polls in which no counter fell.

    Right for a stored table of deltas, or for micro-batches that hold their polls whole. Where a
    poll may be split over micro-batches, write the deltas first and apply this to the stored rows.
    """
    bad = batch.filter(F.col(RESTARTED)).select(*poll).distinct()
    return batch.join(bad, list(poll), "left_anti")
