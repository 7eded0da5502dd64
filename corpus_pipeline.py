"""The corpus pipeline: language ID, line dedup, near-duplicate removal, mixing, token encoding."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.bpe import encode_digests
from llm.common import delete_paths, discard, stage_scratch, stored, table
from llm.langid import UNKNOWN, identify
from llm.linededup import dedup_lines
from llm.mixing import mix_by_weight
from llm.neardup import keep_one, keep_one_of_whole

#: a text follows no learned language if more than this share of its words is in doubt (``llm.langid``)
MOST_DOUBT = 0.5

ORACLE_SQL = None  # a trained field, MinHash and tokenizers are beyond SQL; the tests hold the stages against brute force


_left: dict[int, list[str]] = {}  # by number of the stage: the tables it has worked with


def _stage(number: int):
    """A stage begins when the result of the one before is written: what that one stored can go.

    Nothing else goes: the first stage frees nothing, so the last stage's tables outlive a second run.
    ``run`` calls the bare ``work`` and keeps its own account.
    """

    def add(work):
        @wraps(work)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            delete_paths(spark, _left.pop(number - 1, []))
            with stage_scratch() as made:
                out = work(spark, docs, sf_dir)
            _left.setdefault(number, []).extend(made)
            return out

        run_stage.work = work
        return run_stage

    return add


@_stage(0)
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter, or whose words fit no learned
    language, go; a text of several languages stays, whatever their number. Null ids are kept if their text is. The field is learned from the documents
    themselves, as the query ``op9_language_id`` does. The text is labelled in its row, so nothing is
    joined back. Columns named like the stage's own results stay as they are."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    found = identify(docs, held_out, keep_columns=True, doubt=True, as_row=True)
    return found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("doubt") <= MOST_DOUBT)).select("row.*")


@_stage(1)
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand elsewhere before; ``n_chars`` follows the text. A
    document that loses all its lines goes, since its first copy has them all. Further columns pass through."""
    count = "dropped"
    while count in docs.columns:
        count += "_"
    left = dedup_lines(docs, count_col=count)
    gone = (F.col(count) > 0) & ~F.coalesce(F.col("text").rlike(r"[^\x09-\x0D\x20]"), F.lit(False))
    return left.filter(~gone).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@_stage(2)
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id.

    The texts at hand have lost the lines that stand elsewhere, so what is left of a near copy may be
    just the lines in which it differs. Documents are therefore compared twice: as they are, and by
    their whole texts in ``documents`` of ``sf_dir`` (not if that is empty: a table made elsewhere)."""
    left = keep_one(docs)
    # stored, since the second comparison reads the ids and the rows
    return keep_one_of_whole(stored(left, "left"), table(spark, sf_dir, "documents")) if sf_dir else left


@_stage(3)
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's documents, each as often as it is taken. The one document of a source at which its quota
    ends is taken in part by the mix; here it counts once more from half on, since texts stay whole.
    Columns named like the mix's own stay as they are."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "source")
    taken = mix_by_weight(rows)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    copies = taken.select("row", times.alias("times")).filter("times > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


@_stage(4)
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoded text of every document as digests (null texts as empty); repeated rows are encoded alike."""
    return encode_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing to target weights", mixing),
    ("BPE encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and read again.

    What a stage stored goes as soon as its result is written, the result as soon as the next one is. Tables that the
    last stage's lazy result reads stay, so runs do not disturb each other."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        with stage_scratch() as made:
            out = stage.work(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        last, docs = docs, stored(out, name.replace(" ", "-"))
        delete_paths(spark, made)
        if i:
            discard(last)
    return docs
