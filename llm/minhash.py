"""MinHash banding with exact verification, for documents and for lines.

Items are texts with a 16-byte key. A source function turns Arrow batches into
``(keys, contents)``; it runs once for the signatures and once to fetch the contents of items
that share a band with another. The steps:

1. signatures, cut into bands; packed band hashes are shuffled to find those that two items share;
2. the surviving (item, band) rows; buckets with the same members are kept once;
3. buckets are cut into blocks of ``BLOCK`` members, and a task verifies two blocks of a bucket
   on the full sets. It emits each member's number of links and a spanning forest of them, so a
   bucket of n members never makes n^2 rows; a pair that meets in several buckets counts in
   the first.

Two passes skip rows that cannot matter by a Bloom filter of at most ``2^BLOOM_BITS`` bits: a
fixed bound on what is collected and broadcast. Where it fills up, more rows pass; the exact
joins behind it give the same result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, stored

BLOCK = 128
BLOOM_BITS = 26
FLAT_BYTES = 1 << 20
#: Items are shingled in parts of this size together: the arrays of a part stay in a core's cache.
PART_BYTES = 1 << 16
#: Band hashes of a group that one task looks through at once, about; and those a task packs at once.
GROUP_HASHES = 1 << 19
PACKED_HASHES = 1 << 20
HELD_KEYS = 200_000
_P = 0x9E3779B97F4A7C15


def choose_bands(threshold: float, recall: float, rows: int) -> int:
    """Bands of ``rows`` rows so that a pair at the threshold meets in one with this probability."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)))


def mix(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(_P)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Spans:
    """Hashes of byte spans by differences of one running sum."""

    def __init__(self, size: int):
        self.up, self.down = _powers(size, _P), _powers(size, pow(_P, -1, 1 << 64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=out[1:])
        return out

    def hashed(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start])


_SPANS: list[Spans] = []


def spans_for(size: int) -> Spans:
    """Powers for ``size`` bytes, kept from call to call."""
    if not _SPANS or len(_SPANS[0].up) <= size:
        _SPANS[:] = [Spans(max(size + 1, 2 * FLAT_BYTES))]
    return _SPANS[0]


def flat_parts(contents: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of items of about ``PART_BYTES`` together."""
    begin = held = 0
    for i, c in enumerate(contents):
        if held and held + len(c) > PART_BYTES:
            yield begin, i
            begin, held = i, 0
        held += len(c) + 1
    if begin < len(contents):
        yield begin, len(contents)


def word_shingles(contents: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n``-word shingles of items whose words are joined by single spaces, one
    after the other, and each item's count. Fewer than ``n`` words make one shingle; no word none."""
    line = b" ".join(contents) + b" "
    data = np.frombuffer(line, dtype=np.uint8)
    spans = spans_for(len(data))
    words = data != 32
    edge = np.flatnonzero(np.diff(words.view(np.int8), prepend=0))
    starts, ends = edge[0::2], edge[1::2]
    h = spans.hashed(spans.sums(data), starts, ends)
    item_end = np.cumsum(np.fromiter(map(len, contents), dtype=np.int64, count=len(contents)) + 1)
    per = np.diff(np.searchsorted(starts, item_end), prepend=0)
    first = np.cumsum(per) - per
    length = np.minimum(per, n)
    rolling = np.zeros(len(h), dtype=np.uint64)
    left = np.repeat(first + per, per) - np.arange(len(h))
    for k in range(min(n, len(h))):
        ahead = np.zeros_like(h)
        ahead[: len(h) - k] = h[k:] if k else h
        rolling = np.where(left > k, rolling * np.uint64(0xC2B2AE3D27D4EB4F) + ahead, rolling)
    count = np.where(per > 0, per - length + 1, 0)
    keep = left >= np.repeat(length, per)
    return mix(rolling[keep]), count


def char_shingles(contents: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``n``-character shingles of each item (UTF-8); a shorter item makes one, an empty one none."""
    line = b"".join(contents)
    data = np.frombuffer(line, dtype=np.uint8)
    spans = spans_for(len(data))
    size = np.fromiter(map(len, contents), dtype=np.int64, count=len(contents))
    at = None  # where each character starts, and the end; without it characters are bytes
    if not line.isascii():
        at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        size = np.diff(np.searchsorted(at, np.cumsum(size)), prepend=0)
    ends = np.cumsum(size)
    count = np.where(size > 0, np.maximum(size - n + 1, 1), 0)
    sums, down = spans.sums(data), spans.down[: len(data)]
    if at is not None:
        sums, down = sums[at], down[at[:-1]]
    # one of each character; those that would reach into the next item are left out
    h = np.zeros(len(down), dtype=np.uint64)
    if len(h) >= n:
        np.subtract(sums[n:], sums[:-n], out=h[: len(h) - n + 1])
    h *= down
    begin, end = (ends - size)[size > 0], ends[size > 0]
    inside = np.ones(len(h), dtype=bool)
    inside[np.maximum(end[:, None] - np.arange(1, n), 0)] = False
    short = end - begin < n
    begin, end = begin[short], end[short]
    h[begin] = (sums[end] - sums[begin]) * down[begin]
    inside[begin] = True
    return mix(h[inside]), count


def distinct(hashes: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """Each item's different hashes in order; ``hashes`` is sorted in place, item by item."""
    ends = np.cumsum(count)
    for part in np.split(hashes, ends[:-1]):
        part.sort()
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[(ends - count)[count > 0]] = True
    return np.split(hashes[new], np.append(0, np.cumsum(new))[ends[:-1]])


def signatures(shingles: np.ndarray, count: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """Band hashes (items with shingles only) from ``bands * rows`` minimum hashes."""
    begins = (np.cumsum(count) - count)[count > 0]
    if not len(begins):
        return np.empty((0, bands), dtype=np.int64)
    # both halves of a hash are random, so low * x + high is, for each odd x, a random order of its own
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    high = shingles.astype(np.uint32)
    odd = np.random.default_rng(20240601).integers(1, 1 << 32, size=bands * rows, dtype=np.uint32) | np.uint32(1)
    out, value = np.empty((len(begins), bands), dtype=np.uint64), np.empty_like(low)
    for b in range(bands):
        h = np.full(len(begins), b + 1, dtype=np.uint64)
        for r in range(rows):
            np.multiply(low, odd[b * rows + r], out=value)
            np.add(value, high, out=value)
            h = mix(h ^ np.minimum.reduceat(value, begins).astype(np.uint64))
        out[:, b] = h
    return out.view(np.int64)


def bloom(df: DataFrame, value: Column) -> tuple[int, np.ndarray]:
    """Filter of uniformly hashed longs: two bits of each, in a table of bounded size."""
    rows = stored(df.select(value.alias("h")), "hashes")
    n = rows.count()
    bits = 1 << min(BLOOM_BITS, max(16, (16 * n).bit_length()))
    low, high = F.col("h").bitwiseAND(bits - 1), F.shiftrightunsigned("h", 32).bitwiseAND(bits - 1)
    spots = rows.select(F.explode(F.array(low, high)).alias("p"))
    words = spots.groupBy(F.shiftright("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("m")
    )
    got = words.toArrow()
    discard(rows)
    out = np.zeros(bits // 64, dtype=np.int64)
    out[got.column("w").to_numpy()] = got.column("m").to_numpy()
    return bits, out.view(np.uint64)


def may_hold(table: tuple[int, np.ndarray], h: np.ndarray) -> np.ndarray:
    bits, words = table
    h = h.view(np.uint64)
    ok = np.ones(len(h), dtype=bool)
    for p in (h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)):
        ok &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return ok


def key_long(k: Column) -> Column:
    """First eight bytes of a 16-byte key as a long, as ``_key_longs`` reads them."""
    return F.conv(F.substring(F.hex(k), 1, 16), 16, -10).cast("long")


def _key_longs(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), dtype=">i8").reshape(-1, 2)[:, 0].astype(np.int64)


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary column of longs, cut before each of ``ends``."""
    offsets = np.concatenate([[0], ends]).astype(np.int32) * 8
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _longs(column: pa.Array) -> np.ndarray:
    """All longs of a binary column without nulls, one row after the other."""
    if not len(column):
        return np.empty(0, dtype=np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]].view(np.int64) if data else np.empty(0, dtype=np.int64)


def _by_hash(h: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in unsigned order with their tags, each at most twice; one with different tags keeps two of these."""
    h = h.view(np.uint64)
    order = np.argsort(h)
    h, tag = h[order], tag[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (tag[1:] != tag[:-1])
    h, tag = h[new], tag[new]
    two = np.ones(len(h), dtype=bool)
    two[2:] = h[2:] != h[:-2]
    return h[two], tag[two]


def shared_bands(signed: DataFrame, bands: int) -> DataFrame:
    """``h``: band hashes that belong to two different items of ``signed`` (``k``, ``bands`` packed), each once.

    Hashes travel packed, by their leading bits, in groups of about ``GROUP_HASHES``. A task sends each hash at most
    twice of ``PACKED_HASHES``, so a group stays small however many items share one. Items are told apart by 64 bits of their keys."""
    bits = (signed.count() * bands // GROUP_HASHES).bit_length()
    borders = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.empty(0, dtype=np.uint64)

    def packed(h: list[np.ndarray], tag: list[np.ndarray]) -> pa.RecordBatch:
        hashes, tags = _by_hash(np.concatenate(h), np.concatenate(tag))
        ends = np.append(np.searchsorted(hashes, borders), len(hashes))
        some = np.flatnonzero(np.diff(ends, prepend=0))
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), _packed(hashes, ends[some]), _packed(tags, ends[some])], names=["g", "h", "tag"])

    def pack(batches):
        h, tag, held = [], [], 0
        for batch in batches:
            h.append(_longs(batch.column("bands")).copy())
            tag.append(np.repeat(_longs(batch.column("k"))[::2], bands))
            held += len(h[-1])
            if held > PACKED_HASHES:
                yield packed(h, tag)
                h, tag, held = [], [], 0
        if held:
            yield packed(h, tag)

    def meet(group: pa.Table) -> pa.Table:
        parts = [[_longs(c) for c in group.column(name).chunks] for name in ("h", "tag")]
        h, _ = _by_hash(*map(np.concatenate, parts))
        return pa.table({"h": h[1:][h[1:] == h[:-1]].view(np.int64)})

    own = signed.filter("bands IS NOT NULL").select("k", "bands")
    return own.mapInArrow(pack, "g int, h binary, tag binary").groupBy("g").applyInArrow(meet, "h long")


class _Links:
    """What the cells of a task have found: degrees, and links that join what was apart."""

    def __init__(self, degrees: bool):
        self.up: dict[bytes, bytes] = {}
        self.degrees: dict[bytes, int] | None = {} if degrees else None
        self.edges: list[tuple] = []

    def find(self, x: bytes) -> bytes:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up.setdefault(y, y)
        return x

    def link(self, a: bytes, b: bytes) -> None:
        if self.degrees is not None:
            for x in (a, b):
                self.degrees[x] = self.degrees.get(x, 0) + 1
        x, y = self.find(a), self.find(b)
        if x != y:
            self.up[max(x, y)] = min(x, y)
            self.edges.append((a, None, b))

    def flush(self) -> Iterator[pa.RecordBatch]:
        out = self.edges + [(k, d, None) for k, d in (self.degrees or {}).items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _LINKS.types, strict=True)], schema=_LINKS)
        self.__init__(self.degrees is not None)


def _common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of each set of ``left`` with each of ``right``."""
    if len(left) * len(right) <= 8:
        return np.array([[len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for j in right] for i in left])
    values, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = times > 1
    place = np.cumsum(shared) - 1
    pick = shared[number]
    owner, spot = owner[pick], place[number[pick]]
    out = np.zeros((len(left), len(right)))
    total, width = int(shared.sum()), 16384
    for at in range(0, total, width):
        part = (spot >= at) & (spot < at + width)
        grid = np.zeros((len(sets), min(width, total - at)), dtype=np.float32)
        grid[owner[part], spot[part] - at] = 1
        out += grid[left] @ grid[right].T
    return out.astype(np.int64)


_LINKS = pa.schema([("k", pa.binary()), ("deg", pa.int64()), ("other", pa.binary())])
_CELL = ("bk", "i", "j", "block", "k", "bs", "content")


_TWO = np.arange(2)
_TWO_OPEN, _TWO_MET = np.array([[False, True], [False, False]]), np.zeros((2, 2), dtype=bool)


def _open_pairs(rows: list[tuple], links: _Links) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members of the cell's two blocks, and which pairs of them are to be compared here: those that meet in no
    bucket before this one and, where only components are asked for, are not connected yet."""
    bk, i, j = rows[0][:3]
    if len(rows) == 2 and i == j:  # most cells
        a, b = rows
        open_ = not any(x < bk for x in set(a[5]).intersection(b[5])) and (links.degrees is not None or links.find(a[4]) != links.find(b[4]))
        return _TWO, _TWO, _TWO_OPEN if open_ else _TWO_MET
    block = np.array([r[3] for r in rows])
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    pairs = np.ones((len(left), len(right)), dtype=bool)
    if i == j:
        pairs = np.triu(pairs, 1)
    before = [[b for b in r[5] if b < bk] for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(b) for b in before])
    if len(owner) and pairs.any():
        values, number = np.unique(np.array([b for bs in before for b in bs]), return_inverse=True)
        member = np.zeros((len(rows), len(values)), dtype=np.float32)
        member[owner, number] = 1
        pairs &= member[left] @ member[right].T == 0
    if links.degrees is None and pairs.any():
        known: dict[bytes, int] = {}
        root = np.array([known.setdefault(links.find(r[4]), len(known)) for r in rows])
        pairs &= root[left][:, None] != root[right][None, :]
    return left, right, pairs


def _verify_cell(rows: list[tuple], sets: list[np.ndarray], pairs: tuple[np.ndarray, np.ndarray, np.ndarray], threshold: float, links: _Links) -> None:
    """Compare the open pairs; ``sets`` are given for the rows that have one."""
    left, right, open_ = pairs
    if open_ is _TWO_OPEN:
        both = np.concatenate(sets)
        both.sort()
        common = np.count_nonzero(both[1:] == both[:-1])
        if common >= threshold * (len(sets[0]) + len(sets[1]) - common) - 1e-9:
            links.link(rows[0][4], rows[1][4])
        return
    use = np.zeros(len(rows), dtype=bool)
    use[left[open_.any(axis=1)]] = True
    use[right[open_.any(axis=0)]] = True
    keep_left, keep_right = use[left], use[right]
    left, right, open_ = left[keep_left], right[keep_right], open_[keep_left][:, keep_right]
    place = np.cumsum(use) - 1
    held = [sets[i] for i in np.flatnonzero(use)]
    sizes = np.array([len(s) for s in sets])
    both = _common(held, place[left], place[right])
    near = open_ & (both >= threshold * (sizes[left][:, None] + sizes[right][None, :] - both) - 1e-9)
    for x, y in zip(*(p.tolist() for p in np.nonzero(near)), strict=True):
        links.link(rows[left[x]][4], rows[right[y]][4])


_NO_SET = np.empty(0, dtype=np.uint64)


def _verify(batches: Iterator[pa.RecordBatch], sets_of: Callable, threshold: float, degrees: bool) -> Iterator[pa.RecordBatch]:
    """Cells arrive sorted; they are worked through in parts of bounded size, and the last one of a
    part waits for the rest of its rows. Only rows with a pair to compare are shingled."""
    held: list[tuple] = []
    links = _Links(degrees)

    def work(rows: list[tuple]) -> None:
        begin = 0
        waiting, size = [], 0
        for at in range(1, len(rows) + 1):
            if at == len(rows) or rows[at][:3] != rows[begin][:3]:
                cell = rows[begin:at]
                pairs = _open_pairs(cell, links)
                if pairs[2] is _TWO_OPEN or pairs[2].any():
                    waiting.append((cell, pairs))
                    size += sum(len(r[6]) for r in cell)
                begin = at
                if size > FLAT_BYTES:
                    compare(waiting)
                    waiting, size = [], 0
        compare(waiting)

    def compare(cells: list[tuple]) -> None:
        todo = []
        for n, (_, (left, right, open_)) in enumerate(cells):
            some = [0, 1] if open_ is _TWO_OPEN else np.union1d(left[open_.any(axis=1)], right[open_.any(axis=0)]).tolist()
            todo += [(n, r) for r in some]
        contents = [cells[n][0][r][6] for n, r in todo]
        sets = [[_NO_SET] * len(cell) for cell, _ in cells]
        for a, b in flat_parts(contents):
            for (n, r), found in zip(todo[a:b], sets_of(contents[a:b]), strict=True):
                sets[n][r] = found
        for (cell, pairs), own in zip(cells, sets, strict=True):
            _verify_cell(cell, own, pairs, threshold, links)

    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            held += zip(*(batch.column(c).slice(at, 1024).to_pylist() for c in _CELL), strict=True)
            last = next((n for n in range(len(held) - 1, 0, -1) if held[n - 1][:3] != held[n][:3]), 0)
            if last:
                work(held[:last])
                held = held[last:]
            if len(links.up) > HELD_KEYS:
                yield from links.flush()
    if held:
        work(held)
    yield from links.flush()


def similar(
    rows: DataFrame, source: Callable, shingle: Callable, threshold: float, recall: float, band_rows: int, extra: str = "",
    degrees: bool = True,
) -> tuple[DataFrame, DataFrame | None]:
    """Pairs of different items with Jaccard similarity of at least ``threshold``.

    ``source(batch) -> (keys, contents, more)`` names the items of an Arrow batch of ``rows``, with
    arrays of further columns (declared in ``extra``, unused for batches of ``text`` alone); ``shingle(contents) -> (hashes, counts)`` gives
    their shingles. Returns the links and, with ``extra``, the items. Links are ``k, deg, other``: rows without ``other``
    (only with ``degrees``) add ``deg`` links to item ``k``; rows with it are links that connect the components. Items
    (``k`` and the further columns) are those with shingles; the others have no links.
    """
    bands = choose_bands(threshold, recall, band_rows)
    spark = rows.sparkSession

    def sign(batches):
        for batch in batches:
            keys, contents, more = source(batch)
            # each different item of a batch is signed once; its other rows have no bands
            seen: dict[bytes, int] = {}
            first = [i for i, k in enumerate(keys) if seen.setdefault(k, i) == i]
            own = [contents[i] for i in first]
            found, some = [np.empty((0, bands), dtype=np.int64)], []
            for a, b in flat_parts(own):
                hashes, count = shingle(own[a:b])
                found.append(signatures(hashes, count, bands, band_rows))
                some += [first[a + i] for i in np.flatnonzero(count > 0)]
            flat = np.concatenate(found).reshape(-1)
            lists = _packed(flat, np.arange(bands, len(flat) + 1, bands))
            signed_keys = set(map(keys.__getitem__, some))
            again = [i for i, k in enumerate(keys) if seen[k] != i and k in signed_keys]
            for at, of in ((some, lists), (again, pa.nulls(len(again), pa.binary()))):
                if at:
                    take = pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in at], pa.binary()), of, *[x.take(take) for x in more.values()]], names=["k", "bands", *more])

    signed = stored(rows.mapInArrow(sign, "k binary, bands binary" + (f", {extra}" if extra else "")), "signatures")
    held = spark.sparkContext.broadcast(bloom(shared_bands(signed, bands), F.col("h")))
    once = signed.filter("bands IS NOT NULL").select("k", "bands")

    def survivors(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = _longs(batch.column("bands"))
            ok = np.flatnonzero(may_hold(held.value, flat))
            keys = batch.column("k").take(pa.array(ok // bands))
            yield pa.RecordBatch.from_arrays([keys, pa.array(flat[ok])], names=["k", "bk"])

    met = stored(once.mapInArrow(survivors, "k binary, bk long").distinct(), "met")
    buckets = met.groupBy("bk").agg(
        F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("k")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "k")).alias("y")
    ).filter("c > 1")
    buckets = buckets.groupBy("c", "x", "y").agg(F.min("bk").alias("bk"))
    items = stored(signed.drop("bands"), "items") if extra else None
    discard(signed)
    members = stored(met.join(buckets.select("bk", "c"), "bk"), "members")
    discard(met)
    lists = members.groupBy("k").agg(F.sort_array(F.collect_list("bk")).alias("bs"))
    wanted = spark.sparkContext.broadcast(bloom(lists, key_long(F.col("k"))))

    def fetch(batches):
        for batch in batches:
            keys, contents, _ = source(batch)
            if not keys:
                continue
            ok = np.flatnonzero(may_hold(wanted.value, _key_longs(keys)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([keys[i] for i in ok], pa.binary()), pa.array([contents[i] for i in ok], pa.binary())],
                names=["k", "content"],
            )

    content = rows.select("text").mapInArrow(fetch, "k binary, content binary").groupBy("k").agg(F.first("content").alias("content"))
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    cells = members.join(lists.join(content, "k"), "k").withColumn("block", F.pmod(F.xxhash64("k"), blocks).cast("int"))
    cells = cells.select("bk", "k", "bs", "content", "block", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("o"))
    cells = cells.select("bk", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "k", "bs", "content")
    # cells of a large bucket are dealt out over all tasks
    cells = cells.repartition("bk", "i", "j").sortWithinPartitions("bk", "i", "j")

    def sets_of(contents):
        return distinct(*shingle(contents))

    found = cells.mapInArrow(lambda it: _verify(it, sets_of, threshold, degrees), "k binary, deg long, other binary")
    links = stored(found, "links")
    discard(members)
    return links, items
