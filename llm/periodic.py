"""Periodic runs of words, found by a dictionary of basic factors.

For each power of two the factors (stretches of so many words) of a text get numbers, equal ones the
same: those of length 2L come from the pairs of numbers at i and i + L. Factors that occur once in
their text can be part of no repetition and are left out from then on, so few places remain after
the first steps of ordinary prose.

A factor of length L whose next occurrence lies d <= L places on (within twice its length) makes the
stretch of d + L words have smallest period d. Next occurrences that follow one another with the same
distance form an arithmetic progression: from the first to the last of them the period holds, and
before and behind it breaks, so each progression is a run, extended as far as it goes. A run of
period q and at least ``max(24, 3q)`` words has such a progression at L = 16 if q <= 16, else where
L is the smallest power of two from q on: lengths below 16 are numbered, but propose nothing. Runs
that several lengths propose are kept once.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 24
LEAST_PERIODS = 3
FIRST_FACTOR = 16
PART_WORDS = 500_000
_OUT = [
    ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()),
    ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()),
]
Runs = list[tuple[int, int, int]]


def words_of(text: str | None) -> list[bytes]:
    """Words between white space (0x20, 0x09 to 0x0D), as UTF-8."""
    return (text or "").encode("utf-8").split()


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with a periodic end in a tenth of the documents, by the crc32 of the id; a null id changes nothing."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    tail = words[a : a + p]
    return words[:a] + (tail * ((n - a) // len(tail) + 1))[: n - a]


def _numbered(texts: list[list[bytes]]) -> np.ndarray:
    """A number for each word, -1 between texts and where a word is the only one of its kind in its text."""
    known: dict[bytes, int] = {}
    ids = np.full(sum(map(len, texts)) + len(texts), -1, dtype=np.int64)
    doc = np.empty(len(ids), dtype=np.int64)
    at, fresh = 0, itertools.count()
    for k, words in enumerate(texts):
        ids[at : at + len(words)] = np.fromiter(map(known.setdefault, words, fresh), dtype=np.int64, count=len(words))
        doc[at : at + len(words) + 1] = k
        at += len(words) + 1
    some = np.flatnonzero(ids >= 0)
    ids[some] += 1
    top = int(ids.max(initial=0)) + 1
    return _ranked(some, doc[some] * top + ids[some], len(ids))[0]


def _ranked(places: np.ndarray, keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers by place (-1 where a key occurs once), places with a next occurrence, and its distance."""
    order = np.argsort(keys, kind="stable")
    keys, places = keys[order], places[order]
    same = np.zeros(len(keys) + 1, dtype=bool)
    same[1:-1] = keys[1:] == keys[:-1]
    again = same[:-1] | same[1:]
    rank = np.cumsum(~same[:-1])
    out = np.full(size, -1, dtype=np.int64)
    out[places[again]] = rank[again]
    here = np.flatnonzero(same[1:])
    return out, places[here], places[np.minimum(here + 1, max(len(places) - 1, 0))] - places[here]


def progressions(texts: list[list[bytes]]) -> np.ndarray:
    """Runs of all texts as rows ``begin, length, period``; places count through the texts, one more between them."""
    rank = _numbered(texts)
    found = [np.empty((0, 3), dtype=np.int64)]
    step = 1
    while True:
        alive = np.flatnonzero(rank >= 0)
        alive = alive[alive + step < len(rank)]
        alive = alive[rank[alive + step] >= 0]
        if not len(alive):
            break
        top = int(rank.max()) + 1
        rank, place, distance = _ranked(alive, rank[alive] * top + rank[alive + step], len(rank))
        step *= 2
        if step < FIRST_FACTOR:
            continue
        near = np.flatnonzero(distance <= step)
        near = near[np.argsort(place[near], kind="stable")]
        place, distance = place[near], distance[near]
        if not len(place):
            continue
        new = np.ones(len(place), dtype=bool)
        new[1:] = (np.diff(place) != 1) | (np.diff(distance) != 0)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place)) - 1
        length = place[last] - place[first] + distance[first] + step
        rows = np.stack([place[first], length, distance[first]], axis=1)
        found.append(rows[length >= np.maximum(LEAST_WORDS, LEAST_PERIODS * distance[first])])
    return np.unique(np.concatenate(found), axis=0)


def runs_of(texts: list[list[bytes]]) -> list[Runs]:
    """``start, length, period`` of every run of each text, by start, then period."""
    out: list[Runs] = [[] for _ in texts]
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts)) + 1
    ends = np.cumsum(sizes)
    rows = progressions(texts)
    for k, (begin, length, period) in zip(np.searchsorted(ends, rows[:, 0], side="right").tolist(), rows.tolist(), strict=True):
        out[k].append((begin - int(ends[k] - sizes[k]), length, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list[bytes], runs: Runs) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    keep = np.cumsum(gone)[:-1] == 0
    return words if keep.all() else list(itertools.compress(words, keep.tolist()))


def _report(words: list[bytes], runs: Runs) -> tuple:
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    start, length, period = best or (None, None, None)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (
        len(runs), start, length, period, 1000 * length // period if best else None,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest(),
    )


def _reports(batches: Iterator[pa.RecordBatch], plant: bool) -> Iterator[pa.RecordBatch]:
    ids: list[int | None] = []
    texts: list[list[bytes]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        if texts:
            rows = [_report(words, runs) for words, runs in zip(texts, runs_of(texts), strict=True)]
            columns = [pa.array(c, kind) for c, (_, kind) in zip(zip(*rows, strict=True), _OUT, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *columns], names=["id", *(n for n, _ in _OUT)])
            ids.clear()
            texts.clear()

    held = 0
    for batch in batches:
        for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
            words = words_of(text.as_py())
            if texts and held + len(words) > PART_WORDS:
                yield from flush()
                held = 0
            ids.append(doc_id)
            texts.append(planted(words, doc_id) if plant else words)
            held += len(words)
    yield from flush()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256``.

    A run is a stretch of words with smallest period q, at least ``max(24, 3q)`` words long, that no
    neighbouring word extends. ``start, length, period`` are those of the run with the greatest
    length/period (ties: smallest start, then period), null without runs; ``runs_sha256`` is the digest of
    all runs, ``collapsed_sha256`` that of the words without those repeated, joined by blanks. With
    ``plant`` the ends of a tenth of the texts are made periodic first, by the crc32 of their id.

    Null and blank texts have no words and no runs. Rows with null or repeated ids are kept one by one
    (a null id plants nothing); an empty table gives an empty result; other columns play no part.
    Texts are worked through whole, in parts of about ``PART_WORDS`` words; a longer text is a part of
    its own and takes some 60 bytes of memory a word. No rows are shuffled.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "id long, " + ", ".join(f"{n} {'long' if kind == pa.int64() else 'string'}" for n, kind in _OUT)
    return rows.mapInArrow(lambda it: _reports(it, plant), schema).withColumnRenamed("id", id_col)
