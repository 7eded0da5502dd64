"""Source divergence, periodic runs and toxicity against plain versions and held-out labels."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import divergence as dv
from llm import toxicity as tx
from llm.periodic import periodic_runs, planted, runs_of, words_of

from fixtures import SCHEMA, documents, frame, ordered, passage

# ---- source divergence

_TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
_FOLD = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_divergence(rows, least_docs=10, top=10):
    in_docs, count, groups = Counter(), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = _TERM.findall((text or "").translate(_FOLD))
        count[lang, source].update(terms)
        in_docs.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (x, t), n in in_docs.items() if x == lang and n >= least_docs)
        sources = sorted(s for x, s in groups if x == lang)
        v = len(kept)

        def shares(c, kept=kept, v=v):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * v) for t in kept}

        gap = lambda p, q: (p - q) ** 2 // (p + q)
        whole = Counter()
        for s in sources:
            whole.update(count[lang, s])
        of_lang, own = shares(whole), {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(gap(own[s][t], own[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, gap(own[s][t], of_lang[t])) for t in kept if count[lang, s][t] and own[s][t] > of_lang[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, r) for r, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def audit_rows():
    rng = random.Random(8)
    pool = [passage(rng, 1) for _ in range(60)] + ["ÄÖ", "äö", "漢字" * 4, "漢字" * 4 + "x", "w" * 8, "w" * 9, "w" * 16, "w" * 17, "w" * 33, "z" * 500]
    rows = []
    for i in range(160):
        words = [rng.choice(pool[: 20 + 5 * (i % 9)] + pool[-10:]).upper() if rng.random() < 0.1 else rng.choice(pool) for _ in range(rng.randrange(0, 40))]
        rows.append((rng.choice([" ", "\n", "7", "_"]).join(words) if words else rng.choice([None, "", "12 %"]), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", None, "é"])))
    return rows + [("only once", "xx", "s"), ("only twice", "xx", "t"), ("", "yy", "lone")] + [rows[0]] * 3


def test_divergence_equals_plain_version(spark, monkeypatch):
    rows = audit_rows()
    df = spark.createDataFrame([(i, *r, "x", 1) for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, item string, rank int").repartition(3)
    want = plain_divergence(rows)
    assert {r[2] for r in want} == {"pair", "term"}
    assert sorted(tuple(r) for r in dv.divergence(df).collect()) == want
    # small parts, cells and blocks, and texts in pieces, give the same
    for name, value in (("PART_BYTES", 64), ("TERMS_A_CELL", 8), ("SOURCES_A_BLOCK", 2)):
        monkeypatch.setattr(dv, name, value)
    assert sorted(tuple(r) for r in dv.divergence(df).collect()) == want


def test_divergence_without_rows_or_kept_words(spark):
    schema = "text string, lang string, source string"
    assert dv.divergence(spark.createDataFrame([], schema)).collect() == []
    got = dv.divergence(spark.createDataFrame([("a b", "en", "x"), (None, "en", "y")], schema)).collect()
    assert sorted(tuple(r) for r in got) == [("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)]


def test_radix_order_is_the_order_of_unsigned_words():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(0, 1 << 64, 5000, dtype=np.uint64) % np.uint64(m) for m in (1 << 40, 7))
    assert dv.radix_order([b, a]).tolist() == np.lexsort((a, b)).tolist()
    top = np.array([1 << 63, 1, (1 << 64) - 1, 0], dtype=np.uint64)
    assert top[dv.radix_order([top])].tolist() == sorted(top.tolist())


def test_shares_are_exact_for_counts_beyond_64_bits(spark):
    count, total, kept = 7 * 10**12, 9 * 10**13 - 50, 12
    want = 1 + 10**9 * (count + 2) // (total + 2 * kept)
    assert dv._shares(np.array([count]), np.array([total + 2 * kept]))[0] == want
    df = spark.createDataFrame([(count, total, kept)], "n long, total long, v long")
    assert df.select(dv.share("n", "total", "v")).first()[0] == want


# ---- periodic runs


def plain_runs(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(24, 3 * q) and not any(
                all(words[k] == words[k + d] for k in range(i, i + length - d)) for d in range(1, q)
            ):
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_report(words):
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
    return (
        len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest(),
    )


def run_texts():
    rng = random.Random(4)
    texts = [words_of(r[1]) for r in documents()]
    for _ in range(120):
        words, alphabet = [], [b"%d" % i for i in range(rng.choice([1, 2, 3, 40]))]
        for _ in range(rng.randrange(1, 6)):
            base = [rng.choice(alphabet) for _ in range(rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 40]))]
            words += base * rng.randrange(1, 9) + base[: rng.randrange(len(base) + 1)] + [rng.choice(alphabet) for _ in range(rng.randrange(12))]
        texts.append(words)
    square = [b"a", b"b"] * 5 + [b"c"]
    return [*texts, square * 4, (square * 3 + [b"d"]) * 3, [b"x"] * 23, [b"x"] * 24, [b"x", b"y"] * 12, [b"x"] * 500]


def test_runs_equal_plain_version():
    texts = run_texts()
    want = [plain_runs(t) for t in texts]
    assert sum(map(len, want)) > 100 and max(map(len, want)) > 2
    assert runs_of(texts) == want
    assert [runs_of([t])[0] for t in texts] == want


def test_periodic_query_equals_plain_version(spark):
    rows = documents()
    rng = random.Random(6)
    rows += [(1000 + i, passage(rng, rng.randrange(20, 200)), "en", "s", 0, "x", "y", 1, 2.0, "z") for i in range(60)]
    got = periodic_runs(frame(spark, rows), plant=True)
    want = [(r[0], *plain_report(planted(words_of(r[1]), r[0]))) for r in rows]
    assert sum(w[1] > 0 for w in want) > 5
    assert ordered(got.collect()) == ordered(want)
    assert periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []


def test_planted_words_follow_the_stated_rule():
    for doc_id in range(200):
        words = [b"%d" % i for i in range(doc_id % 37)]
        h, n = zlib.crc32(str(doc_id).encode()), len(words)
        want = list(words)
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            want = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        assert planted(words, doc_id) == want
    assert planted([b"a"], None) == [b"a"]


def test_a_long_text_is_one_part():
    base = [b"%d" % i for i in range(70_000)]
    assert runs_of([base * 3 + [b"end"], [b"u"] * 30]) == [[(0, 210_000, 70_000)], [(0, 30, 1)]]


# ---- toxicity

INSULTS = ["blockhead", "numbskull", "nitwit"]


def labelled(n=360):
    rng = random.Random(3)
    rows, marks = [], []
    pool = [passage(rng, 1) for _ in range(300)]
    for i in range(n):
        toxic = i % 4 == 1
        words = [rng.choice(pool) for _ in range(rng.randrange(20, 300))]
        if toxic:
            # held-out misspellings were never seen whole
            bad = [rng.choice(INSULTS) + (rng.choice(["s", "z", "ish"]) if zlib.crc32(str(i).encode()) % 4 == 2 else "") for _ in range(max(2, len(words) // 10))]
            for w in bad:
                words[rng.randrange(len(words))] = w
        rows.append((i, " ".join(words), "en", "s", 0, "x", "y", 1, 2.0, "z"))
        marks.append((i, int(toxic), i % 2))
    return rows, marks


@pytest.fixture(scope="module")
def scored(spark):
    rows, marks = labelled()
    rows += [(5000, None, None, None, 0, "x", "y", 1, 2.0, "z"), (5001, "", None, None, 0, "x", "y", 1, 2.0, "z"), (None, "no id", None, None, 0, "x", "y", 1, 2.0, "z")]
    calm = " ".join(r[1] for r in rows if r[0] is not None and r[0] < 5000 and r[0] % 4 != 1)
    long = " ".join([calm, "blockhead nitwit blockhead nitwit", "w" * 300, calm])
    rows += [(5002, long, None, None, 0, "x", "y", 1, 2.0, "z"), rows[3], rows[3]]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([*marks, marks[0], (None, 1, 1), (7, None, 0), (99_999, 1, 1)], "doc_id long, toxic int, score int")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    out = tx.score_toxicity(docs, labels, held_out, rounds=30)
    return rows, dict((i, t) for i, t, _ in marks), [tuple(r) for r in out.collect()], out.columns


def test_toxicity_on_held_out_misspellings(scored):
    rows, toxic, got, columns = scored
    assert columns == ["doc_id", "held_out", "score", "predicted"] and len(got) == len(rows)
    assert all(0 <= s <= 1 and p == int(s >= 0.3) for _, _, s, p in got)
    held = [(i, s) for i, h, s, _ in got if h and i in toxic]
    assert all(h == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for i, h, _, _ in got)
    bad = np.array([s for i, s in held if toxic[i]])
    good = np.array([s for i, s in held if not toxic[i]])
    # their words were never seen whole, yet they rank before the others
    assert len(bad) > 10 and np.mean(good >= 0.3) < 0.05 and np.mean(bad[:, None] > good[None, :]) > 0.9
    seen = [p for i, h, _, p in got if not h and toxic.get(i)]
    assert np.mean(seen) > 0.95


def test_misspellings_share_vectors():
    rows, marks = labelled()
    use = [(r, y) for r, (_, y, _) in zip(rows, marks, strict=True) if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    model = tx.fit([tx.words_of(r[1]) for r, _ in use], np.array([y for _, y in use]), 30)
    by_subword = model.by_subword()
    plain = tx.margins(sorted({w for r in rows for w in r[1].split() if not any(w.startswith(x) for x in INSULTS)}), by_subword)
    for w in INSULTS:
        exact, unseen = tx.margins([w], by_subword)[0], tx.margins([w + "s", w + "z", "x" + w], by_subword)
        assert (unseen > 0.4 * exact).all() and (unseen > np.quantile(plain, 0.97)).all()


def test_toxicity_edge_texts(scored):
    _, _, got, _ = scored
    by_id = defaultdict(list)
    for i, _, s, p in got:
        by_id[i].append((s, p))
    assert by_id[5000] == by_id[5001] and by_id[5000][0][1] == 0
    assert by_id[5002][0][1] == 1  # a few words of thirty thousand
    assert len(set(by_id[3])) == 1 and len(by_id[3]) == 3


def test_toxicity_without_labels_or_rows(spark):
    docs = frame(spark, documents())
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in tx.score_toxicity(docs, empty, held_out).collect()} == {0}
    one = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert {r.predicted for r in tx.score_toxicity(docs, one, held_out).collect()} == {0}
    assert tx.score_toxicity(docs.limit(0), one, held_out).collect() == []


def test_windows_cover_texts():
    for n in (0, 1, 31, 32, 33, 48, 49, 100, 1000):
        begin, end, text = tx.windows(np.array([5, n, 3]))
        own = text == 1
        covered = set()
        for b, e in zip(begin[own], end[own], strict=True):
            covered |= set(range(b, e))
        assert covered == set(range(5, 5 + n)) and own.sum() >= 1 and (end - begin).max() <= tx.WINDOW


def test_words_of_any_length_are_cut():
    assert tx.words_of("A " + "b" * 200) == ["a", "b" * 64, "b" * 64, "b" * 64, "b" * 8]
    assert tx.words_of(None) == []
