"""N-gram Jaccard join of documents by MinHash banding."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored, text_key
from .minhash import similar, word_shingles

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
BAND_ROWS = 4

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def normalised(text: str | None) -> bytes:
    """Words (digits, letters, all beyond ASCII; A-Z lower-cased) joined by single spaces."""
    return b" ".join((text or "").encode("utf-8").translate(_TABLE).split())


def _source(batch: pa.RecordBatch) -> tuple[list[bytes], list[bytes], dict]:
    texts = batch.column("text").to_pylist()
    return [hashlib.md5((t or "").encode("utf-8")).digest() for t in texts], [normalised(t) for t in texts], {}


def jaccard_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    n: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL,
) -> DataFrame:
    """Near-duplicate classes: texts whose sets of ``n``-word shingles have a Jaccard similarity
    of at least ``threshold`` are linked, and connected texts form a class.

    One row per row of ``docs``: the id, ``k`` (key of the text), ``class_id`` (smallest id of
    the class), ``n_links`` (other texts its text is linked to), ``n_copies`` (rows with the same
    text), ``kept`` (whether this is the class's document with the smallest id, then key). Texts
    of fewer than ``n`` words have one shingle; a text without a word (null, empty) is a class of
    its own. Null ids come last and give a null ``class_id`` only if the class has no other. Rows
    that repeat id and text are alike in all columns. Empty tables give an empty result; other
    columns play no part.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    links, _ = similar(rows.select("text"), _source, lambda c: word_shingles(c, n), threshold, recall, BAND_ROWS)
    degree = links.filter("other IS NULL").groupBy("k").agg(F.sum("deg").alias("n_links"))
    roots = components(links.filter("other IS NOT NULL"), "k", "other").withColumnsRenamed({"node": "k"})
    worded = F.coalesce(F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False))
    ids = stored(rows.select("id", text_key(F.col("text")).alias("k"), worded.alias("worded")), "ids")
    texts = ids.groupBy("k").agg(F.count(F.lit(1)).alias("n_copies"), F.min("id").alias("low"))
    texts = texts.join(degree, "k", "left").join(roots, "k", "left").withColumn("root", F.coalesce("root", "k"))
    texts = stored(texts, "texts")
    # smallest id first, a null id last; then the smaller key
    first = texts.groupBy("root").agg(F.min(F.struct(F.col("low").isNull(), "low", "k")).alias("first"))
    texts = texts.join(first, "root").select(
        "k", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("first.low").alias("low"), F.col("first.k").alias("first_k")
    )
    alone = ~F.col("worded")
    return ids.join(texts, "k").select(
        F.col("id").alias(id_col), "k",
        F.when(alone, F.col("id")).otherwise(F.col("low")).alias("class_id"),
        F.when(alone, 0).otherwise(F.col("n_links")).alias("n_links"), "n_copies",
        (alone | ((F.col("k") == F.col("first_k")) & F.col("id").eqNullSafe(F.col("low")))).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one left of each class, columns as they were. Rows that repeat id and
    text count as one, save for texts without a word, which all stay."""
    kept = jaccard_classes(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias("kept_id"), F.col("k").alias("kept_k")).distinct()
    worded = F.coalesce(F.col(text_col).rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"), F.lit(False))
    keyed = docs.filter(worded).select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("k"))
    found = keyed.join(kept, (F.col("k") == F.col("kept_k")) & F.col("id").eqNullSafe(F.col("kept_id"))).dropDuplicates(["k", "id"])
    return found.select("row.*").unionByName(docs.filter(~worded))


def keep_one_of_whole(docs: DataFrame, whole: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those whose whole texts, in ``whole``, are near copies of another's that is still there.

    For texts that were shortened on the way: what is left of a near copy need not resemble its
    original any more. Only the whole texts of the documents at hand are compared, and the one with the
    smallest id of each class stays; ids that are null or not in ``whole`` stay, and one that has several
    whole texts stays if one of them does.
    """
    ids = docs.select(F.col(id_col).alias("id")).distinct()
    # read three times: without the table, texts would be shuffled as often
    at_hand = stored(whole.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(ids, "id", "left_semi"), "whole")
    classes = jaccard_classes(at_hand, "id", "text").groupBy("id").agg(F.max("kept").alias("kept"))
    gone = classes.filter("NOT kept").select(F.col("id").alias("gone_id"))
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"))
    return keyed.join(gone, F.col("id") == F.col("gone_id"), "left_anti").select("row.*")
