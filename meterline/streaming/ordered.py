"""Counter deltas of samples that arrive out of order, by the rules of the batch operator.

Samples wait in the state until the watermark says that nothing older can come, and are then
taken in order: what was shuffled within the allowed delay gives the same deltas as the sorted
table. ``stream_counter_delta`` in ``counters`` answers at once instead and gives a late sample NULL.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator, Sequence
from itertools import islice

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.counters import check_policies

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICROS, GROUP = "_micros", "_group"
GROUPS = 1024  # units of the state
CHUNK_ROWS = 10_000  # samples packed into one value

# ship the classes below with the job, so that executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _rank(value) -> tuple:
    """NULL before everything else, as in an ascending sort."""
    return (value is not None, 0 if value is None else value)


def _pack(rows: list[tuple]) -> list[tuple[bytes]]:
    return [(pickle.dumps(rows[i : i + CHUNK_ROWS], 5),) for i in range(0, len(rows), CHUNK_ROWS)]


class OrderedDeltas(StatefulProcessor):
    """State of a group of series: the samples held, in packed chunks, the last sample taken of each series, packed
    too, and one timer. So a batch makes a few calls to the store a group, however many series there are."""

    def __init__(self, names: list[str], keys: list[str], time: str, cols: list[str], wanted: list[str], tiebreak: list[str], reset: str,
                 first: str, gate: str | None, max_gap_s: float | None, expire_after_s: float | None):
        self.names, self.cols, self.wanted = names, cols, wanted
        self.reset, self.first, self.gate, self.max_gap_s, self.expire_after_s = reset, first, gate, max_gap_s, expire_after_s
        self.micros = names.index(time)
        self.key_at, self.wanted_at, self.tie_at = ([names.index(c) for c in some] for some in (keys, wanted, tiebreak))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        packed = T.StructType([T.StructField("packed", T.BinaryType())])
        self.held = handle.getListState("held", packed)
        self.last = handle.getValueState("last", packed)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at, first = self.micros, None
        # the time travels in microseconds, which are in the column before the group
        new = ((*r[:at], r[-2], *r[at + 1 : -2]) for r in map(tuple, rows))
        while chunk := list(islice(new, CHUNK_ROWS)):
            low = min(r[at] for r in chunk)
            first = low if first is None else min(first, low)
            self.held.appendValue(_pack(chunk)[0])
        # a timer that is due already fires in this batch and sees to what is held then
        if first is not None:
            self._wake_at(first, list(self.handle.listTimers()))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        limit, at = watermark * 1000, self.micros
        ready, rest = [], []
        for (packed,) in self.held.get():
            for r in pickle.loads(packed):
                (ready if r[at] <= limit else rest).append(r)
        last = pickle.loads(self.last.get()[0]) if self.last.exists() else {}
        if ready:
            ready.sort(key=lambda r: (r[at], *[_rank(r[t]) for t in self.tie_at]))
            yield from self._deltas(ready, last)
            self.held.clear()
            for chunk in _pack(rest):
                self.held.appendValue(chunk)
        due = min([r[at] for r in rest], default=None)
        gone = []
        if self.expire_after_s is not None:
            expire = int(self.expire_after_s * 1_000_000)
            # what comes later is newer than the watermark: further from the last sample than that
            gone = [k for k, v in last.items() if v[0] + expire <= limit]
            for k in gone:
                del last[k]
            due = min([v[0] + expire for v in last.values()] + [due] * (due is not None), default=None)
        if last and (ready or gone):
            self.last.update((pickle.dumps(last, 5),))
        elif gone:
            self.last.clear()
        if due is not None:
            # the timer that fired may still be listed, but it is spent
            self._wake_at(due, [t for t in self.handle.listTimers() if t > watermark])

    def close(self) -> None:
        pass

    def _wake_at(self, micros: int, timers: list[int]) -> None:
        due = -(-micros // 1000)
        if all(due < t for t in timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(due)

    def _deltas(self, rows: list[tuple], last: dict[tuple, tuple]) -> Iterator[Row]:
        """Answers to samples in order; ``last`` is kept up."""
        answer = Row(*self.names)
        for row in rows:
            series = tuple(["NaN" if (x := row[k]) != x else x for k in self.key_at])
            prev = last.get(series)
            now = (row[self.micros], *[row[w] for w in self.wanted_at])
            if prev is not None and self.expire_after_s is not None and now[0] - prev[0] > self.expire_after_s * 1_000_000:
                prev = None  # silent for so long that its state would be gone, whatever the batches were
            if prev is not None or self.first != "drop":
                yield answer(*row, *[self._delta(c, now, prev) for c in self.cols])
            last[series] = now

    def _delta(self, col: str, now: tuple, prev: tuple | None):
        at = self.wanted.index(col) + 1
        cur = now[at]
        if prev is None:
            return {"zero": _zero(cur), "passthrough": cur}.get(self.first)
        diff = None if cur is None or prev[at] is None else cur - prev[at]
        if diff is not None and diff < 0:
            diff = {"zero": _zero(cur), "current": cur, "null": None}.get(self.reset, diff)
        if self.gate:
            g = self.wanted.index(self.gate) + 1
            if now[g] is None or prev[g] is None or not now[g] - prev[g] > 0:
                diff = _zero(cur)
        # whole seconds on both ends, as in the batch operator
        if self.max_gap_s is not None and now[0] // 1_000_000 - prev[0] // 1_000_000 > self.max_gap_s:
            diff = _zero(cur)
        return diff


def _zero(like):
    return type(like)(0) if like is not None else 0


def stream_ordered_delta(
    stream: DataFrame,
    keys: Sequence[str],
    time: str,
    cols: Sequence[str],
    delay: str,
    reset: str = "raw",
    first: str = "null",
    gate: str | None = None,
    max_gap_s: float | None = None,
    tiebreak: Sequence[str] = (),
    suffix: str = "_delta",
    expire_after_s: float | None = None,
    groups: int = GROUPS,
) -> DataFrame:
    """Delta of each counter from the previous sample of its series, samples up to ``delay`` late put in order.

    A sample is answered once the watermark (the newest time seen less ``delay``) has reached it; one that comes
    later than that is left out (Spark counts such rows in its progress reports). The state of a series is
    what arrived within the delay, and its last sample; ``expire_after_s`` forgets a
    series that has been silent for so long. Policies are those of ``counter_delta``, except
    ``drop_batch``, which needs whole polls (see ``counters.drop_restarted_polls``).

    Series are dealt by a hash of their keys into ``groups`` groups that are the units of the state: the samples a
    group holds are rewritten when some of them are due, and are in one worker's memory then. The number must stay as it is
    while a checkpoint lives; a checkpoint of the form with one state a series cannot be continued.

    The state lives in Spark's RocksDB store, which this operator needs: it is set for the session here.
    """
    check_policies(reset, first)
    if reset == "drop_batch":
        raise ValueError("drop_batch needs whole polls; apply drop_restarted_polls to stored deltas")
    stream.sparkSession.conf.set(PROVIDER, ROCKS_DB)
    keys, cols = list(keys), list(cols)
    wanted = list(dict.fromkeys([*cols, *([gate] if gate else [])]))
    kinds = {f.name: f.dataType for f in stream.schema.fields}
    # instants are held as numbers, which mean the same whatever the time zone of a session; the watermark stays with its column
    instants = [n for n, k in kinds.items() if isinstance(k, T.TimestampType)]
    rows = stream.withWatermark(time, delay).withColumns({
        **{n: F.unix_micros(n) for n in instants if n != time},
        MICROS: F.unix_micros(time), GROUP: F.pmod(F.xxhash64(*keys), F.lit(groups)).cast("int"),
    })
    out = T.StructType([
        *[T.StructField(n, T.LongType() if n in instants else k) for n, k in kinds.items()],
        *[T.StructField(f"_{i}{suffix}", kinds[c]) for i, c in enumerate(cols)],
    ])
    worker = OrderedDeltas(out.names, keys, time, cols, wanted, list(tiebreak), reset, first, gate, max_gap_s, expire_after_s)
    answers = rows.groupBy(GROUP).transformWithState(worker, out, "append", "eventTime")
    return answers.select(
        *[F.timestamp_micros(n).alias(n) if n in instants else F.col(n) for n in kinds],
        *[F.col(f"_{i}{suffix}").alias(f"{c}{suffix}") for i, c in enumerate(cols)],
    )
