"""Interval analytics against brute force that follows the stated rules literally."""

import math
import random

import pytest
from pyspark.sql import functions as F

from meterline.operators.intervals import (
    concurrency,
    concurrency_summary,
    critical_path,
    flag_stragglers,
    group_percentiles,
    scheduling_delay,
    wait_time,
)
from meterline.operators.slices import ROWS_PER_SLICE

from helpers import plan, rows


def merged(pairs, min_rows):
    if len(pairs) < min_rows or any(not s or not e or s <= 0 or e <= 0 for s, e in pairs):
        return []
    out = []
    for s, e in sorted(pairs):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(p) for p in out]


@pytest.mark.parametrize("min_rows", [1, 2])
def test_path_equals_brute_force(spark, min_rows):
    rng = random.Random(3)
    data = []
    for g in range(60):
        for _ in range(rng.randrange(1, 12)):
            s = rng.randrange(1, 80)
            e = s + rng.randrange(0, 12)
            bad = rng.random() < 0.02
            data.append((g, s, None if bad else e))
    df = spark.createDataFrame(data, "g int, s bigint, e bigint")
    want = sorted(
        (g, s, e) for g in range(60) for s, e in merged([(a, b) for k, a, b in data if k == g], min_rows)
    )
    assert rows(critical_path(df, ["g"], "s", "e", min_rows)) == want


def test_path_edge_rows(spark):
    data = [("touch", 10, 20), ("touch", 20, 30), ("gap", 10, 20), ("gap", 21, 30), ("open", 10, None), ("open", 12, 30),
            ("one", 5, 9), ("zero", 0, 9), ("zero", 5, 9)]
    df = spark.createDataFrame(data, "g string, s bigint, e bigint")
    assert rows(critical_path(df, ["g"], "s", "e")) == [("gap", 10, 20), ("gap", 21, 30), ("one", 5, 9), ("touch", 10, 30)]
    assert ("one", 5, 9) not in rows(critical_path(df, ["g"], "s", "e", 2))


def test_scheduling_delay_rules(spark):
    parents = spark.createDataFrame([("a", 0, 100), ("b", 0, 100), ("c", 50, 50), ("d", 0, 100)], "g string, s bigint, e bigint")
    kids = spark.createDataFrame([("a", 10, 30), ("a", 20, 50), ("b", 10, None), ("b", 20, 50), ("c", 1, 5)], "g string, cs bigint, ce bigint")
    skip = scheduling_delay(parents, kids, ["g"], "s", "e", "cs", "ce", min_rows=1)
    assert rows(skip, "g", "scheduling_delay") == [("a", 60), ("b", 70), ("c", 0), ("d", 0)]
    strict = scheduling_delay(parents, kids, ["g"], "s", "e", "cs", "ce", min_rows=1, skip_open=False)
    assert rows(strict, "g", "scheduling_delay") == [("a", 60), ("b", 0), ("c", 0), ("d", 0)]


def quantile(xs, p):
    k = (len(xs) - 1) * p
    f, c = math.floor(k), math.ceil(k)
    return float(xs[int(k)]) if f == c else xs[f] * (c - k) + xs[c] * (k - f)


@pytest.mark.parametrize("size", [15, ROWS_PER_SLICE])
def test_percentiles_and_stragglers(spark, size):
    rng = random.Random(5)
    data = [(i, "hot" if rng.random() < 0.6 else f"g{rng.randrange(6)}", rng.choice([rng.randrange(40), rng.randrange(1000)])) for i in range(900)]
    df = spark.createDataFrame(data, "id int, g string, v bigint")
    groups = {}
    for _, g, v in data:
        groups.setdefault(g, []).append(v)
    got = {r.g: (r.a, r.b) for r in group_percentiles(df, ["g"], "v", {"a": 0.25, "b": 0.9}, size).collect()}
    for g, xs in groups.items():
        xs.sort()
        assert got[g] == pytest.approx((quantile(xs, 0.25), quantile(xs, 0.9)))
    fence = {g: quantile(xs, 0.75) + 1.5 * (quantile(xs, 0.75) - quantile(xs, 0.25)) for g, xs in groups.items()}
    flags = {r.id: r.isStraggler for r in flag_stragglers(df, ["g"], "v", rows_per_slice=size).collect()}
    assert flags == {i: int(v > fence[g]) for i, g, v in data}


def test_value_on_the_fence_is_no_straggler(spark):
    # quartiles 10 and 20, fence 35; rows in no order
    df = spark.createDataFrame([(35,), (10,), (20,), (10,), (20,), (15,), (36,)], "v int").withColumn("g", F.lit(1))
    got = {r.v: r.isStraggler for r in flag_stragglers(df.filter("v < 36"), ["g"], "v").collect()}
    assert got[35] == int(35 > quantile([10, 10, 15, 20, 20, 35], 0.75) * 2.5 - 1.5 * quantile([10, 10, 15, 20, 20, 35], 0.25))


def wait_brute(job, maps, reduces, pct=70):
    ok = lambda t: t[0] > 0 and t[1] > 0 and t[2] > 0
    maps, reduces = [t for t in maps if ok(t)], [t for t in reduces if ok(t)]
    m = max(t[1] for t in maps) - job[0] - max(t[2] for t in maps) if maps else 0
    r = 0
    if reduces:
        last, longest = max(t[1] for t in reduces), max(t[2] for t in reduces)
        if maps:
            k = math.ceil(len(maps) * pct / 100)
            if k < len(maps):
                r = last - sorted(t[1] for t in maps)[k - 1] - longest
        elif job[1] == 0:
            r = last - job[0] - longest
    return m + r


def test_wait_time_equals_brute_force(spark):
    rng = random.Random(11)
    jobs, attempts = {}, {}
    for j in range(60):
        jobs[j] = (rng.randrange(1, 50), rng.choice([0, 3]))
        make = lambda: (rng.randrange(0, 90), rng.randrange(0, 150), rng.randrange(0, 20))
        attempts[j] = ([make() for _ in range(rng.choice([0, 1, 2, 9]))], [make() for _ in range(rng.choice([0, 1, 4]))])
    job_df = spark.createDataFrame([(j, s, m) for j, (s, m) in jobs.items()], "jobId int, submitTime bigint, mapsTotal int")
    flat = [(j, kind, *t) for j, pair in attempts.items() for kind, ts in zip(("MAP", "REDUCE"), pair) for t in ts]
    att_df = spark.createDataFrame(flat, "jobId int, type string, startTime bigint, finishTime bigint, elapsedTime bigint")
    got = {r.jobId: r.waitTime for r in wait_time(job_df, att_df).collect()}
    assert got == {j: wait_brute(jobs[j], *attempts[j]) for j in jobs}


def buckets_brute(tasks, lo, hi, step):
    out, end = [], hi + 1
    for x in range(lo, end, step):
        b = min(x + step, end)
        n = 0
        for s, e in tasks:
            if s and e and ((x <= s < b) or (x < e <= b) or (s < x and e > b)):
                n += 1
        out.append((x, b, n))
    return out


@pytest.mark.parametrize("step", [5, 7, "even"])
def test_concurrency_equals_brute_force(spark, step):
    rng = random.Random(13)
    data, want = [], []
    for g in range(40):
        lo = rng.randrange(100, 120)
        hi = lo + rng.randrange(0, 400)
        ts = []
        for _ in range(rng.randrange(1, 15)):
            s = rng.randrange(max(lo - 10, 1), hi + 15)
            e = s + rng.choice([0, 0, 1, rng.randrange(0, 60)])
            ts.append((s, e))
        if rng.random() < 0.3:
            ts.append((lo + 5 * rng.randrange(3), 0))
        ts.append((lo + 10, lo + 10))
        data += [(g, s, e, lo, hi) for s, e in ts]
        width = max((hi + 1 - lo) // 25, 5) if step == "even" else step
        want += [(g, *b) for b in buckets_brute(ts, lo, hi, width)]
    df = spark.createDataFrame(data, "g int, s bigint, e bigint, lo bigint, hi bigint")
    assert rows(concurrency(df, ["g"], "s", "e", step, "lo", "hi")) == sorted(want)


def test_concurrency_summary_truncates_mean(spark):
    df = spark.createDataFrame([(1, 0), (1, 3), (1, 2)], "g int, task_count bigint")
    assert rows(concurrency_summary(df, ["g"])) == [(1, 0, 3, 1)]


def test_concurrency_has_no_pairwise_join(spark):
    df = spark.createDataFrame([(1, 5, 9)], "g int, s bigint, e bigint")
    text = plan(concurrency(df, ["g"], "s", "e"))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
