"""Fuzzy line dedup: character-shingle MinHash, high-recall banding, exact Jaccard verification,
distributed union-find, one line left of each component."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored, text_key
from .minhash import char_shingles, similar

CHARS = 8
THRESHOLD = 0.8
RECALL = 0.999
BAND_ROWS = 4

_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b in b"\t\v\f\r" else b for b in range(256))


def _lines(text: str | None) -> list[tuple[int, bytes]]:
    """Numbers and contents of the lines that are not blank: A-Z lower-cased, runs of ASCII white
    space as one space, none at the ends."""
    if not text:
        return []
    raw = text.encode("utf-8").translate(_FOLD)
    lines = raw.split(b"\n")
    if b"  " in raw:
        lines = [b" ".join(line.split()) for line in lines]
    return [(i, c) for i, line in enumerate(lines) if (c := line.strip(b" "))]


def _source(batch: pa.RecordBatch) -> tuple[list[bytes], list[bytes], dict]:
    found = [_lines(t) for t in batch.column("text").to_pylist()]
    contents = [c for lines in found for _, c in lines]
    rows = pa.array([row for row, lines in enumerate(found) for _ in lines], pa.int64())
    more = {c: batch.column(c).take(rows) for c in batch.schema.names if c != "text"} | {"n": pa.array([n for lines in found for n, _ in lines], pa.int32())}
    return [hashlib.md5(c).digest() for c in contents], contents, more


def without_lines(text: str, numbers: list[int]) -> str:
    gone = set(numbers)
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)


def _rebuild(batches):
    for batch in batches:
        texts = [
            t if not n else without_lines(t, n)
            for t, n in zip(batch.column("text").to_pylist(), batch.column("numbers").to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [pa.array(texts, pa.string()) if name == "text" else batch.column(name) for name in batch.schema.names],
            names=batch.schema.names,
        )


def dropped_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    chars: int = CHARS, threshold: float = THRESHOLD, recall: float = RECALL,
) -> DataFrame:
    """``id, d, numbers``: numbers (from 0) of the lines that go, for each document that loses any;
    ``d`` is the key of the document's text."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("d", text_key(F.col("text")))
    shingle = lambda c: char_shingles(c, chars)
    links, places = similar(rows, _source, shingle, threshold, recall, BAND_ROWS, "id bigint, d binary, n int", degrees=False)
    roots = components(links.filter("other IS NOT NULL"), "k", "other").withColumnsRenamed({"node": "k"})
    # the first line of each text of a line, then of each component: both combined before the shuffle
    place = F.struct(F.col("id").isNull(), "id", "d", "n")
    each = places.groupBy("k").agg(F.count(F.lit(1)).alias("times"), F.min(place).alias("first"))
    # most lines stand alone, and go no further
    each = each.join(roots, "k", "left").filter("times > 1 OR root IS NOT NULL")
    each = stored(each.withColumn("root", F.coalesce("root", "k")), "each")
    first = each.groupBy("root").agg(F.min("first").alias("first"), F.sum("times").alias("times")).filter("times > 1")
    fate = each.join(first.select("root", F.col("first").alias("kept")), "root").select("k", "kept")
    gone = places.join(fate, "k").filter(place != F.col("kept"))
    return gone.groupBy("id", "d").agg(F.collect_set("n").alias("numbers"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str = "lines_dropped", **options) -> DataFrame:
    """All rows of ``docs`` with repeated lines taken out of the text, and how many (``count_col``, replaced where it exists).

    Lines (between line feeds) that are alike after folding A-Z and white space, or whose sets of
    character shingles have a Jaccard similarity of at least the threshold, are linked; of each
    connected group the first line stays: smallest id (null last), then key of the text, then
    line number. Blank lines stay. Lines shorter than a shingle make one shingle. Rows that repeat
    id and text are alike and lose the same lines. Null and empty texts stay as they are, empty
    tables give an empty result, and columns beside the text are passed on.
    """
    drops = dropped_lines(docs, id_col, text_col, **options)
    keyed = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("__id"), text_key(F.col(text_col)).alias("__d"),
        F.col(text_col).alias("text"),
    )
    # the drops are the small side: texts need not be sorted
    joined = keyed.join(drops.hint("shuffle_hash"), F.col("__id").eqNullSafe(F.col("id")) & (F.col("__d") == F.col("d")), "left")
    others = [c for c in docs.columns if c != text_col]
    flat = joined.select(
        *[F.col("row").getField(c).alias(f"c{i}") for i, c in enumerate(others)], "text", "numbers"
    )
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flat.schema)
    built = flat.mapInArrow(_rebuild, kinds)
    back = [F.col(f"c{others.index(c)}").alias(c) if c != text_col else F.col("text").alias(c) for c in docs.columns if c != count_col]
    return built.select(*back, F.coalesce(F.size("numbers"), F.lit(0)).alias(count_col))
