"""WARC archives, assembled transactions and the top-k search."""

import base64
import collections
import hashlib
import random

import numpy as np
import pytest
from fixtures import ordered
from pyspark.sql import functions as F

from llm import topk
from llm.topk import quantised, top_k
from llm.warc import assemble, base32, captures_of, read_archives, records, write_archives
from meterline.session import scratch_path

PAGES = "page_id long, url string, html string, kind string, record_id string"


def pages():
    rows = [(1, "u1", "same"), (5, "u5", "same"), (3, "u3", "same"), (7, "u7", None), (8, None, ""), (9, "u\r\n9", "x\r\n\r\nWARC/1.1\r\ny"), (10, "u", "é漢"), (11, "u", "z" * 70000)]
    rows += [(12, "a", "twice"), (12, "a", "twice"), (12, "b", "twice"), (None, "n", "same"), (None, None, "alone"), (4, "s", "x"), (6, "s", "x")]
    return [(*r, "k", "r") for r in rows]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 2])
def test_round_trip(spark, least):
    path = scratch_path(spark, "warc")
    write_archives(spark.createDataFrame(pages(), PAGES).repartition(3), path, least_revisit=least)
    found = read_archives(spark, path)
    got = captures_of(found).collect()
    top = {}
    for i, url, html, *_ in pages():
        key = html or ""
        top[key] = max(top.get(key, (-1, "")), (-1 if i is None else i, url or ""))
    want = []
    for i, url, html, *_ in pages():
        first = top[html or ""]
        is_top = (-1 if i is None else i, url or "") == first or len((html or "").encode()) < least
        want.append((i, len((html or "").encode()), digest(html), "response" if is_top else "revisit", None if is_top else first[0]))
    assert ordered(got) == ordered(want)
    whole = assemble(found).collect()
    assert len(whole) == len(set(pages())) and all(r.n_requests == r.n_metadata == 1 for r in whole)
    bodies = {bytes(r.body).decode() for r in whole if r.kind == "response"}
    assert bodies == {h or "" for _, _, h, *_ in pages()}


def test_digest_is_taken_from_one_hash(spark):
    """Each of the 32 characters reads the hash from a column; none of them hashes the payload."""
    rows = spark.createDataFrame([(hashlib.sha1(str(i).encode()).hexdigest(),) for i in range(50)], "h string")
    assert "sha1" not in str(base32(F.col("h")))
    got = rows.select(base32(F.col("h"))).collect()
    assert sorted(r[0] for r in got) == sorted(digest(str(i)) for i in range(50))


def test_no_pages(spark):
    path = scratch_path(spark, "warc")
    write_archives(spark.createDataFrame([], PAGES), path)
    assert captures_of(read_archives(spark, path)).collect() == []


def test_assembly_follows_links_both_ways(spark):
    kind = "record_id string, kind string, concurrent_to array<string>, refers_to string, uri string, date string, digest string, size long, fields map<string,string>, body binary"
    rows = [
        ("q1", "request", ["r1"]), ("r1", "response", []), ("m1", "metadata", ["q1"]),  # over the request
        ("q2", "request", []), ("r2", "response", ["q2"]), ("m2", "metadata", ["r2"]), ("m3", "metadata", ["r2"]),
        ("r3", "resource", ["gone"]), ("q4", "request", ["nowhere"]), (None, "response", []), (None, "request", ["r3"]), ("q5", "request", ["r1", "r2"]),
    ]
    df = spark.createDataFrame([(i, k, c, None, None, None, None, 0, None, None) for i, k, c in rows], kind)
    got = {r.record_id: r for r in assemble(df).collect()}
    name = lambda x: x and x.record_id
    assert {i: (name(r.request), r.n_requests, name(r.metadata), r.n_metadata) for i, r in got.items()} == {
        "r1": ("q1", 2, "m1", 1), "r2": ("q2", 1, "m2", 2), "r3": (None, 0, None, 0), None: (None, 0, None, 0),
    }


def test_cut_archives_are_reported():
    good = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in records(good * 2)] == [b"abc"] * 2
    for bad in (good[:-6], b"x" + good):
        with pytest.raises(ValueError):
            list(records(bad))


def brute(rows, queries, k):
    out = []
    for q, v in queries:
        best = sorted((-min(max(sum(a * b for a, b in zip(v, w, strict=True)), -(2**63)), 2**63 - 1), i) for i, w in rows if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best[:k])]
    return out


@pytest.mark.parametrize("block, group, asked", [(4, 16, 3), (256, 16384, 1024), (3, 1, 1)])
def test_top_k(spark, block, group, asked):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(120, 6)).round(1)
    vectors[40:70] = vectors[0]  # ties
    rows = [(i, [float(x) for x in v], 0, "x") for i, v in enumerate(vectors)]
    rows += [(200, None, 0, ""), (201, [1.0, None, 0.0], 0, ""), (202, [float("nan")] + [0.0] * 5, 0, ""), (203, [float("inf")] + [0.0] * 5, 0, ""),
             (220, [1e9, -1e9, 3.0, 0.0, 0.0, 0.0], 0, ""), (240, [1.0, 2.0], 0, ""), (241, [3.0, -2.0], 0, ""), (260, [], 0, ""), (None, [1.0] * 6, 0, "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, v string").repartition(3)
    usable = quantised(df, "vec_id", "embedding")
    queries = usable.filter("id % 20 = 0")
    got = [tuple(r) for r in top_k(usable, queries, 5, block, group, asked).collect()]
    plain = [(r.id, r.v) for r in usable.collect() if r.id is not None]
    assert {r[0] for r in plain} == set(range(120)) | {220, 240, 241, 260}
    assert ordered(got) == ordered(brute(plain, [p for p in plain if p[0] % 20 == 0], 5))


def test_rows_sent_do_not_grow_with_the_groups(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(2000)]
    usable = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").cache()
    queries, sent = usable.filter("id % 100 = 0"), []
    real = topk._score_cells

    def counted(batches, k, block_rows):
        for batch in real(batches, k, block_rows):
            total.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(topk, "_score_cells", counted)
    for group in (2000, 25):  # one group; some eighty
        total = spark.sparkContext.accumulator(0)
        got = [tuple(r) for r in top_k(usable, queries, 5, 10, group, 1024).collect()]
        assert ordered(got) == ordered(brute([(r.id, r.v) for r in usable.collect()], [(r.id, r.v) for r in queries.collect()], 5))
        sent.append(total.value)
    assert sent[0] == 20 * 5 and sent[1] < 20 * 5 * 30  # not 80 times as many


def test_top_k_of_nothing(spark):
    empty = quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert top_k(empty, empty).collect() == []


def test_one_repeated_vector(spark):
    rows = [(i // 2, [1.0, 2.0]) for i in range(300)]
    random.Random(1).shuffle(rows)
    usable = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding", 1)
    got = collections.Counter((r.query_id, r.vec_id) for r in top_k(usable, usable.filter("id = 0"), 4, 8, 16, 1).collect())
    assert got == {(0, 1): 4, (0, 2): 4}
