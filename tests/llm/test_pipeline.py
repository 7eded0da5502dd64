"""The stages one after the other on a small corpus, each held against what it must do."""

import collections
import random
import re

import numpy as np
from fixtures import passage, ordered
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from llm import langid
from llm.common import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark):
    rng = random.Random(21)
    make = {"en": "the and thing ous ent ing ly er".split(), "fr": "eau oux ment quel aille ch re".split()}
    rows = []
    for i in range(60):
        lang = ("en", "fr")[i % 2]
        line = lambda: " ".join("".join(rng.choice(make[lang]) for _ in range(rng.randint(2, 4))) for _ in range(12))
        rows.append((i, "\n".join(line() for _ in range(4)), lang, f"s{i % 3}", 0))
    rows.append((100, rows[2][1], "en", "s0", 0))  # a copy
    rows.append((101, rows[4][1].replace("\n", " "), "en", "s1", 0))  # the same words on one line
    rows += [(102, "12 34 !!", None, "s0", 0), (103, None, None, None, 0), (104, "", "en", "s1", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark):
    docs = corpus(spark)
    kept = {}
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, ""), name.replace(" ", "-"))
        kept[name] = docs
    first, lines, near, mixed, ids = kept.values()
    for df in (first, lines, near, mixed):
        assert df.columns == COLUMNS
    everything = {r.doc_id for r in corpus(spark).collect()}
    assert {r.doc_id for r in first.collect()} == everything - {102, 103, 104}
    assert {r.doc_id for r in lines.collect()} == everything - {100, 102, 103, 104}
    assert all(r.n_chars == len(r.text) for r in lines.collect())
    assert {r.doc_id for r in near.collect()} == set(range(60))
    times = collections.Counter(r.doc_id for r in mixed.collect())
    assert max(times.values()) <= 2
    words = lambda df: sum(len(re.findall(r"\S+", r.text)) for r in df.collect())
    assert abs(words(mixed) - 1.5 * words(near)) <= 0.05 * words(near) + 60
    assert ordered((r.doc_id,) for r in ids.select("doc_id").collect()) == ordered((r.doc_id,) for r in mixed.select("doc_id").collect())


def test_text_in_several_languages_stays_and_one_in_none_goes(spark, monkeypatch):
    letters = {"aa": "abcd", "bb": "efgh", "cc": "ijkl", "dd": "mnop"}
    rng = random.Random(22)
    say = lambda lang, n: " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(n))
    rows = [(i, say(lang, 60), lang, "s", 0) for i, lang in enumerate(list(letters) * 20)]
    rows.append((500, " ".join(say(lang, 15) for lang in letters), None, "s", 0))  # in equal parts
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in pipeline.language_id(spark, docs, "").collect()} == {r[0] for r in rows}
    # words without a known feature, read with weights and transitions of zero, are at chance for any number of labels
    for n in (2, 3, 20):
        labels = [f"l{i}" for i in range(n)]
        blank = labels, np.zeros((1 << langid.FEATURE_BITS, n), dtype=np.float32), np.zeros((n, n))
        sure = labels, np.tile(np.eye(n, dtype=np.float32)[0] * 9, (1 << langid.FEATURE_BITS, 1)), np.zeros((n, n))
        for model, left in ((blank, set()), (sure, {r[0] for r in rows})):
            monkeypatch.setattr(langid, "learn", lambda *a, model=model: model)
            assert {r.doc_id for r in pipeline.language_id(spark, docs, "").collect()} == left


def test_registered():
    names = [q for q in entry.queries() if re.match(r"op\d+_", q)]
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in names) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert [n for n, _ in pipeline.STAGES] and 4 <= len(pipeline.STAGES) <= 5 and pipeline.ORACLE_SQL is None


CLASHING = ["size", "source_size", "target", "taken", "score", "lang_pred", "doubt", "lines_dropped", "dropped", "row", "__times", "__copy", "__k", "__source"]


def test_columns_with_the_stages_own_names_pass_through(spark):
    docs = corpus(spark)
    wide = docs.select(*docs.columns, *[F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHING])
    plain = docs
    for name, stage in pipeline.STAGES[:-1]:
        wide, plain = (stored(stage(spark, df, ""), name.replace(" ", "-")) for df in (wide, plain))
        assert wide.columns == [*COLUMNS, *CLASHING]
        rows = wide.collect()
        assert ordered((r.doc_id, r.text) for r in rows) == ordered((r.doc_id, r.text) for r in plain.collect())
        assert all(r[c] == f"{c}:{r.doc_id}" for r in rows for c in CLASHING)
    assert pipeline.encoding(spark, wide, "").count() == plain.count()


def test_near_copies_go_though_line_dedup_left_a_remnant(spark, tmp_path):
    rng = random.Random(31)
    base = [[passage(rng, 12) for _ in range(20)] for _ in range(10)]
    rows = [(i, "\n".join(lines), "en", "s0", 0) for i, lines in enumerate(base)]
    # near copies, one line of twenty changed, and documents that share a few lines only
    rows += [(100 + i, "\n".join([*lines[:9], passage(rng, 12), *lines[10:]]), "en", "s1", 0) for i, lines in enumerate(base)]
    rows += [(200 + i, "\n".join([*lines[:4], *(passage(rng, 12) for _ in range(16))]), "en", "s2", 0) for i, lines in enumerate(base)]
    rows += [rows[0], (None, "a text without an id", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    lines = stored(pipeline.line_dedup(spark, docs, str(tmp_path)), "line-dedup")
    assert {r.doc_id for r in lines.collect()} >= {r[0] for r in rows}
    left = pipeline.near_duplicates(spark, lines, str(tmp_path))
    assert left.columns == COLUMNS
    assert {r.doc_id for r in left.collect()} == {None, *range(10), *range(200, 210)}


def test_empty_table_and_repeated_rows(spark):
    docs = corpus(spark)
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES[:-1]:
        empty = stored(stage(spark, empty, ""), "empty")
        assert empty.columns == COLUMNS and empty.count() == 0
    assert pipeline.encoding(spark, empty, "").count() == 0
    twice = docs.unionByName(docs)
    for name, stage in pipeline.STAGES[:3]:
        twice = stored(stage(spark, twice, ""), "twice")
    assert sorted(r.doc_id for r in twice.collect()) == list(range(60))


def test_two_runs_do_not_disturb_each_other(spark, tmp_path):
    corpus(spark).write.parquet(f"{tmp_path}/documents.parquet")
    first, second = pipeline.run(spark, str(tmp_path)), pipeline.run(spark, str(tmp_path))
    assert ordered(first.collect()) == ordered(second.collect())
