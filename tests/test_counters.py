"""Counter rules on the edge rows: first sample, restart, equal times, gaps, late entities."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from meterline.functions import hit_ratio, mean_latency
from meterline.operators.counters import counter_delta, counter_rate, cpu_percent, drop_first_sample, last_value_per_series
from meterline.operators.slices import carry_forward, row_number_within, running_total, slice_groups

from helpers import at, plan, rows

SERIES = [
    # host, entity, seconds, c1, gate
    ("h1", "sda", 0, 100, 1.0),
    ("h1", "sda", 10, 150, 2.0),
    ("h1", "sda", 20, 20, 2.0),  # restart, gate stands still
    ("h1", "sda", 30, 50, 3.0),
    ("h1", "sda", 100, 90, 4.0),  # gap
    ("h1", "sdb", 20, 7, 1.0),  # appears later
    ("h1", "sdb", 30, 9, 0.5),
]


@pytest.fixture
def series(spark):
    data = [(h, e, at(s), s, c, g) for h, e, s, c, g in SERIES]
    return spark.createDataFrame(data, "host string, entity string, time timestamp, s int, c1 bigint, gate double")


def delta(df, **policy):
    out = counter_delta(df, ["host", "entity"], "time", ["c1"], **policy)
    return {(r.entity, r.s): r.c1_delta for r in out.collect()}


def test_raw_keeps_negative_and_first_is_null(series):
    got = delta(series)
    assert got[("sda", 0)] is None and got[("sda", 10)] == 50
    assert got[("sda", 20)] == -130 and got[("sdb", 20)] is None and got[("sdb", 30)] == 2


def test_zero_current_null(series):
    assert delta(series, reset="zero", first="zero")[("sda", 20)] == 0
    assert delta(series, reset="zero", first="zero")[("sda", 0)] == 0
    assert delta(series, reset="current")[("sda", 20)] == 20
    assert delta(series, reset="null")[("sda", 20)] is None
    assert delta(series, first="passthrough")[("sda", 0)] == 100


def test_first_drop(series):
    got = delta(series, first="drop")
    assert ("sda", 0) not in got and ("sdb", 20) not in got and len(got) == 5


def test_gate_and_gap(series):
    got = delta(series, gate="gate", first="zero")
    assert got[("sda", 10)] == 50 and got[("sda", 20)] == 0 and got[("sdb", 30)] == 0
    got = delta(series, max_gap_s=30)
    assert got[("sda", 100)] == 0 and got[("sda", 30)] == 30


def test_drop_batch_removes_the_whole_poll(series):
    got = delta(series, reset="drop_batch", poll=["host", "time"])
    assert ("sda", 20) not in got and ("sdb", 20) not in got
    assert got[("sda", 30)] == 30 and len(got) == 5


def test_drop_batch_needs_poll(series):
    with pytest.raises(ValueError):
        delta(series, reset="drop_batch")
    with pytest.raises(ValueError):
        delta(series, reset="other")


def test_rates(series):
    out = counter_rate(series, ["host", "entity"], "time", ["c1"])
    got = {(r.entity, r.s): r.c1_rate for r in out.collect()}
    assert got[("sda", 0)] is None and got[("sda", 10)] == 5.0 and got[("sda", 100)] == pytest.approx(40 / 70)
    out = counter_rate(series, ["host", "entity"], "time", ["c1"], per="interval", interval_s=10, reset="zero", first="zero", digits=2)
    got = {(r.entity, r.s): r.c1_rate for r in out.collect()}
    assert got[("sda", 0)] == 0.0 and got[("sda", 20)] == 0.0 and got[("sda", 30)] == 3.0


def test_rate_is_null_when_time_stands_still(spark):
    data = [("a", at(0), 1, 5), ("a", at(0.4), 2, 9), ("a", at(1.2), 3, 10)]
    df = spark.createDataFrame(data, "k string, time timestamp, n int, c bigint")
    got = {r.n: r.c_rate for r in counter_rate(df, ["k"], "time", ["c"]).collect()}
    assert got == {1: None, 2: None, 3: 1.0}


def test_null_keys_form_one_series(spark):
    data = [(None, at(0), 1), (None, at(1), 4), ("a", at(0), 2)]
    df = spark.createDataFrame(data, "k string, time timestamp, c bigint")
    assert rows(counter_delta(df, ["k"], "time", ["c"], first="zero"), "k", "c_delta") == [(None, 0), (None, 3), ("a", 0)]


def test_first_sample_suppressed(series):
    assert len(drop_first_sample(series, ["host", "entity"], "time").collect()) == 5


def test_cpu_percent(spark):
    data = [("v", at(0), 0, 2), ("v", at(10), 10 * 10**9, 2), ("v", at(20), 5, 2)]
    df = spark.createDataFrame(data, "vm string, time timestamp, ns bigint, n int")
    assert [r.cpu_percent for r in cpu_percent(df, ["vm"], "time", "ns", "n").orderBy("time").collect()] == [None, 50.0, None]


def test_last_value_ignores_null_and_zero(spark):
    data = [("a", at(0), 5), ("a", at(1), 0), ("a", at(2), None), ("b", at(0), 0)]
    df = spark.createDataFrame(data, "k string, time timestamp, v bigint")
    assert rows(last_value_per_series(df, ["k"], "time", "v"), "k", "v") == [("a", 5), ("b", None)]


def test_ratio_and_latency_guards(spark):
    df = spark.createDataFrame([(0, 0), (1, 2), (3, 0)], "h bigint, m bigint")
    assert [r[0] for r in df.select(hit_ratio("h", "m")).collect()] == [0.0, 33.33, 100.0]
    assert [r[0] for r in df.select(hit_ratio("h", "m", whole=True)).collect()] == [0, 33, 100]
    assert [r[0] for r in df.select(mean_latency("h", "m")).collect()] == [0.0, 0.5, 0.0]


# ---- slicing: one key with most of the rows, bursts, ties and NULL order values

@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    data = []
    for i in range(3000):
        key = "hot" if rng.random() < 0.5 else f"k{rng.randrange(40)}"
        when = at(rng.randrange(100)) if rng.random() < 0.3 else at(rng.randrange(100_000))
        data.append((i, key, when, rng.randrange(1000), rng.randrange(50) if rng.random() < 0.2 else None))
    data.append((3000, "hot", None, 5, 1))
    return spark.createDataFrame(data, "id int, k string, time timestamp, c bigint, v int").cache()


def brute(skewed, descending=False):
    by_key = {}
    for r in skewed.collect():
        by_key.setdefault(r.k, []).append(r)
    for rs in by_key.values():
        rs.sort(key=lambda r: (r.time is not None, r.time or at(0), r.id))
    return by_key


@pytest.mark.parametrize("size", [10, 100, 10**6])
def test_sliced_delta_equals_brute_force(skewed, size):
    want = {}
    for rs in brute(skewed).values():
        for a, b in zip([None, *rs], rs):
            want[b.id] = None if a is None else b.c - a.c
    got = counter_delta(skewed, ["k"], "time", ["c"], tiebreak=["id"], rows_per_slice=size)
    assert {r.id: r.c_delta for r in got.collect()} == want


@pytest.mark.parametrize("size", [10, 100, 10**6])
def test_sliced_carry_and_numbers_equal_brute_force(skewed, size):
    carry, number, total = {}, {}, {}
    for rs in brute(skewed).values():
        last, run = None, 0
        for i, r in enumerate(rs):
            last = r.v if r.v is not None else last
            run += r.c
            carry[r.id], number[r.id], total[r.id] = last, i + 1, run
    got = carry_forward(skewed, ["k"], "time", "v", ["id"], rows_per_slice=size)
    assert {r.id: r.v for r in got.collect()} == carry
    got = row_number_within(skewed, ["k"], "time", ["id"], rows_per_slice=size)
    assert {r.id: r["index"] for r in got.collect()} == number
    got = running_total(skewed, ["k"], "time", F.col("c"), ["id"], rows_per_slice=size)
    assert {r.id: r.running for r in got.collect()} == total


def test_descending_numbers(skewed):
    want = {}
    by_key = {}
    for r in skewed.collect():
        by_key.setdefault(r.k, []).append(r)
    for rs in by_key.values():
        for i, r in enumerate(sorted(rs, key=lambda r: (-r.c, r.id))):
            want[r.id] = i + 1
    got = row_number_within(skewed, ["k"], "c", ["id"], descending=True, rows_per_slice=20)
    assert {r.id: r["index"] for r in got.collect()} == want


def test_hot_key_is_cut_and_others_are_not(skewed):
    sliced = slice_groups(skewed, ["k"], "time", rows_per_slice=200)
    counts = {(r.k, r._slice): r["count"] for r in sliced.groupBy("k", "_slice").count().collect()}
    assert len([1 for k, _ in counts if k == "hot"]) > 10
    assert all(s == 0 for k, s in counts if k != "hot")


def test_no_hot_key_means_one_shuffle(skewed):
    out = counter_delta(skewed, ["k"], "time", ["c"], tiebreak=["id"]).select("id", "c_delta")
    out.collect()
    final = plan(out).split("== Initial Plan ==")[0]
    assert final.count("ShuffleQueryStage") <= 1 and "BroadcastHashJoin" not in final


def test_bursts_and_ties_are_cut_again(spark):
    """Rows crowded into a thousandth of the time; whole-number values of which one holds a third of the rows."""
    i = F.col("id")
    when = F.when(i % 6 < 4, 800_000 + (i % 997) / 10).otherwise(i * 170.0)
    value = F.when(i % 6 < 2, F.lit(7)).otherwise(i * 37 % 101)
    df = spark.range(6000).select("id", F.when(i % 2 == 0, "hot").otherwise("hot2").alias("k"), when.alias("t"), value.alias("c"))
    for order in ("t", "c"):
        sliced = slice_groups(df, ["k"], order, rows_per_slice=100, tiebreak=["id"])
        assert sliced.groupBy("k", "_slice").count().agg(F.max("count")).first()[0] <= 100
        for down in (False, True):
            want = rows(row_number_within(df, ["k"], order, ["id"], descending=down), "id", "index")
            for size in (20, 100):
                got = row_number_within(df, ["k"], order, ["id"], descending=down, rows_per_slice=size)
                assert rows(got, "id", "index") == want
    one = df.withColumn("t", F.lit(1.0))
    assert rows(row_number_within(one, ["k"], "t", ["id"], rows_per_slice=100), "id", "index") == rows(row_number_within(one, ["k"], "t", ["id"]), "id", "index")


@pytest.mark.parametrize("descending", [False, True])
def test_slices_hold_against_infinities_and_nan(spark, descending):
    odd = [float("inf"), float("-inf"), float("nan"), None]
    values = [float(i % 400) for i in range(2000)] + odd * 3
    df = spark.createDataFrame([("k", i, v) for i, v in enumerate(values)], "k string, i long, v double")
    for keys in (["k"], []):
        cut = slice_groups(df, keys, "v", rows_per_slice=100, descending=descending, tiebreak=["i"])
        largest = cut.groupBy("_slice").count().agg(F.max("count")).first()[0]
        assert largest <= 200
        got = row_number_within(df, keys, "v", ["i"], descending, 100, "n")
        order = F.desc("v") if descending else F.asc("v")
        want = df.withColumn("n", F.row_number().over(Window.orderBy(order, "i")))
        assert {(r.i, r.n) for r in got.collect()} == {(r.i, r.n) for r in want.collect()}
        assert "NestedLoop" not in plan(cut)
