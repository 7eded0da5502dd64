"""Near-duplicate documents and lines, and fingerprints, against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from fixtures import documents, frame, ordered, passage
from pyspark.sql import functions as F

from llm import minhash
from llm.common import components
from llm.iblt import PIECE, fingerprints
from llm.linededup import CHARS, dedup_lines
from llm.minhash import char_shingles, choose_bands, word_shingles
from llm.neardup import jaccard_classes, keep_one, normalised


def groups(sets, threshold=0.8):
    """Component of each set, and its number of links."""
    up, links = list(range(len(sets))), collections.Counter()

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both / len(sets[i] | sets[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                up[find(i)] = find(j)
    return [find(i) for i in range(len(sets))], links


def shingled(text):
    w = normalised(text).split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected_classes(rows):
    texts = list(dict.fromkeys(r[1] or "" for r in rows))
    root, links = groups([shingled(t) for t in texts])
    ids = collections.defaultdict(list)
    for r in rows:
        ids[root[texts.index(r[1] or "")]].append(r[0])
    out = []
    for r in rows:
        i = texts.index(r[1] or "")
        own = [x for x in ids[root[i]] if x is not None]
        alone = not shingled(r[1])
        out.append((r[0], r[0] if alone else min(own, default=None), 0 if alone else links[i], sum((x[1] or "") == texts[i] for x in rows)))
    return out


def test_word_shingles_are_one_per_distinct_run():
    hashes, count = word_shingles([b"a b c d e f", b"", b"a b c", b"b c d e f"], 5)
    assert count.tolist() == [2, 0, 1, 1] and hashes[1] == hashes[3] and len(set(hashes.tolist())) == 3
    assert choose_bands(0.8, 0.9999, 4) == 18


@pytest.mark.parametrize("block", [128, 3])
def test_classes(spark, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rng = random.Random(12)
    words = passage(rng, 200).split()
    family = []
    for i in range(25):  # many near copies: several blocks of a bucket
        w = list(words)
        w[rng.randrange(200)] = f"new{i}"
        family.append((500 + i, " ".join(w), "en", "s", 0, "", "", 0, 0.0, ""))
    rows = documents() + family
    got = jaccard_classes(frame(spark, rows)).select("doc_id", "class_id", "n_links", "n_copies")
    assert ordered(got.collect()) == ordered(expected_classes(rows))


def test_one_of_each_group_stays(spark):
    rows = documents()
    kept = keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    got = [(r[0], r[1]) for r in kept.collect()]
    classes = {}
    for r, c in zip(rows, expected_classes(rows), strict=True):
        if shingled(r[1]):
            classes.setdefault(c[1] if c[1] is not None else ("none", r[1]), set()).add((r[0], r[1]))
    worded = [g for g in got if shingled(g[1])]
    assert len(worded) == len(classes) and all(len(set(worded) & c) == 1 for c in classes.values())
    assert sorted(repr(g) for g in got if not shingled(g[1])) == sorted(repr((r[0], r[1])) for r in rows if not shingled(r[1]))


def test_whole_texts_at_hand_are_gathered_once(spark, monkeypatch):
    """The comparison of whole texts reads a stored table three times, so texts are not shuffled for each."""
    import llm.neardup as neardup

    made, own = [], neardup.stored
    monkeypatch.setattr(neardup, "stored", lambda df, name: made.append(name) or own(df, name))
    whole = spark.createDataFrame([(i, passage(random.Random(i % 4), 30)) for i in range(8)], "doc_id long, text string")
    left = whole.filter("doc_id <> 1").withColumn("text", F.lit("what is left"))
    assert sorted(r.doc_id for r in neardup.keep_one_of_whole(left, whole).collect()) == [0, 2, 3, 5]
    assert made.count("whole") == 1


def test_empty_tables(spark):
    empty = frame(spark, []).limit(0)
    assert jaccard_classes(empty).collect() == [] and keep_one(empty).collect() == []
    assert dedup_lines(empty).collect() == [] and fingerprints(empty).collect() == []


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000, 1000 + i) for i in range(1, 200)] + [(i, i + 1) for i in range(2000, 2060)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    up = {x: x for p in pairs for x in p}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_line_dedup(spark):
    rows = documents()
    got = dedup_lines(frame(spark, rows))
    assert got.columns == [*frame(spark, rows).columns, "lines_dropped"]
    fold = lambda line: re.sub(r"[ \t\v\f\r]+", " ", re.sub("[A-Z]", lambda m: m[0].lower(), line)).strip(" ").encode()
    places = []  # every line that is not blank, first ones first
    for r in sorted({(r[0], r[1]) for r in rows if r[1]}, key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).digest())):
        places += [(r, n, fold(line)) for n, line in enumerate(r[1].split("\n")) if fold(line)]
    lines = list(dict.fromkeys(p[2] for p in places))
    root, _ = groups([{c[i : i + CHARS] for i in range(max(1, len(c) - CHARS + 1))} for c in lines])
    seen, gone = set(), collections.defaultdict(set)
    for r, n, c in places:
        if (g := root[lines.index(c)]) in seen:
            gone[r].add(n)
        seen.add(g)
    want = []
    for r in rows:
        drop = gone[r[0], r[1]]
        want.append((r[0], r[1] and "\n".join(x for n, x in enumerate(r[1].split("\n")) if n not in drop), len(drop)))
    assert any(w[2] for w in want)
    assert ordered(got.select("doc_id", "text", "lines_dropped").collect()) == ordered(want)


def test_line_dedup_measures_characters(spark):
    rng = random.Random(31)
    lines = []  # pairs that differ in one character: far apart by characters, near by bytes where these are several
    for alphabet in (range(0x430, 0x450), range(0x4E00, 0x5E00), range(97, 123)):
        for size in (40, 60, 120):
            line = [chr(rng.choice(alphabet)) for _ in range(size)]
            lines += ["".join(line), "".join([*line[: size // 2], "§", *line[size // 2 + 1 :]])]
    sets = lambda of: [{c[i : i + CHARS] for i in range(len(c) - CHARS + 1)} for c in map(of, lines)]
    root, by_bytes = groups(sets(str))[0], groups(sets(str.encode))[0]
    assert len(set(by_bytes)) < len(set(root)) < len(lines)
    got = {r.doc_id: r.lines_dropped for r in dedup_lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert got == {i: int(g in root[:i]) for i, g in enumerate(root)}


def test_char_shingles_are_of_code_points():
    hashes, count = char_shingles([t.encode() for t in ("дом", "", "漢字漢字", "abcd", "é\U0001f600xé\U0001f600")], 3)
    assert count.tolist() == [1, 0, 2, 2, 3]
    assert hashes[0] == char_shingles(["дом".encode()], 3)[0][0] and len(set(hashes.tolist())) == 8


def pieces(text):
    return set(re.findall(rf"[^\n]{{1,{PIECE}}}", text or ""))


def likeness(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("packed, group", [(1 << 20, 1 << 19), (30, 8)])
def test_shared_bands_are_those_of_different_items(spark, packed, group, monkeypatch):
    """Copies of one item share no band, however often they are signed; many items of one band count as two."""
    monkeypatch.setattr(minhash, "PACKED_HASHES", packed)
    monkeypatch.setattr(minhash, "GROUP_HASHES", group)
    rng, bands = random.Random(4), 3
    items = [(hashlib.md5(b"%d" % i).digest(), [rng.randrange(-(1 << 63), 1 << 63), rng.choice([5, -5, 7 + i]), rng.randrange(-40, 40) << 55]) for i in range(60)]
    rows = [i for i in items for _ in range(rng.choice([1, 1, 2, 5]))]
    rng.shuffle(rows)
    signed = spark.createDataFrame([(bytearray(k), bytearray(np.array(b, dtype=np.int64).tobytes())) for k, b in rows] + [(bytearray(16), None)], "k binary, bands binary")
    owners = collections.defaultdict(set)
    for k, b in items:
        for h in b:
            owners[h].add(k)
    got = [r.h for r in minhash.shared_bands(signed.repartition(3), bands).collect()]
    assert sorted(got) == sorted(h for h, k in owners.items() if len(k) > 1)
    assert minhash.shared_bands(signed.filter("bands IS NULL"), bands).collect() == []


def test_distinct_hashes_of_each_item():
    rng = np.random.default_rng(5)
    for _ in range(200):
        count = rng.integers(0, 6, rng.integers(1, 8))
        hashes = rng.integers(0, 5, count.sum()).astype(np.uint64)
        want = [np.unique(p).tolist() for p in np.split(hashes, np.cumsum(count)[:-1])]
        assert [p.tolist() for p in minhash.distinct(hashes.copy(), count)] == want


def test_lines_that_stand_alone_go_no_further(spark, monkeypatch):
    """What is stored for the choice of first lines are repeated and linked lines only."""
    import llm.linededup as linededup

    kept, own = {}, linededup.stored
    monkeypatch.setattr(linededup, "stored", lambda df, name: kept.setdefault(name, own(df, name)))
    rows = [(i, f"line number {i} of its own, {passage(random.Random(i), 12)}\nthe same line everywhere") for i in range(20)]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.lines_dropped for r in got) == 19 and kept["each"].count() == 1


def test_fingerprints(spark):
    rng = random.Random(9)
    long = [(200 + i, "\n".join(passage(rng, 6) for _ in range(n)), "en", "s", 0, "", "", 0, 0.0, "") for i, n in enumerate((300, 310, 40, 1))]
    rows = documents() + long
    # the order by id, then by the key of the text
    key = lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).digest())
    line = sorted(rows, key=key)
    want = []
    for i, r in enumerate(line):
        text, after = r[1] or "", line[(i + 1) % len(line)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        want.append((r[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(pieces(text), pieces(edited)), 9), round(likeness(pieces(text), pieces(after)), 9)))
    out = fingerprints(frame(spark, rows)).collect()
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in out]
    assert ordered(got) == ordered(want)
    prints = {r["fingerprint"] for r in out if r["n_chars"] == len(line[-1][1])}
    assert prints and np.isfinite([r["near_next"] for r in out]).all()
    one = fingerprints(frame(spark, rows[:1])).collect()
    assert one[0]["near_next"] == 1.0 and one[0]["fingerprint"] in {r["fingerprint"] for r in out}


def test_fingerprints_run_no_python(spark):
    from helpers import plan

    assert not re.search("Python|Arrow|Pandas", plan(fingerprints(frame(spark).select("doc_id", "text"))).replace("ArrowEvalPython", "Python"))
