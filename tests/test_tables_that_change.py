"""Followed files, ordered streams, bucketed tables, batches with a ledger, marks, and stored forms that spare reading."""

import os
import random
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from meterline.operators.counters import counter_delta
from meterline.operators.joins import membership_change
from meterline.plans.log_counts import count_logs_stored, refresh_counts
from meterline.plans.log_search import search_logs
from meterline.sinks import BatchFailed, BucketedTable, compact_day, read_ledger, send_batches, stage_batches, to_files, upsert
from meterline.sinks.clustered import files_for, search_clustered, write_clustered
from meterline.sinks.files import pack, packed_rows
from meterline.sinks.snapshots import StoredSnapshot, changed_parts, store_snapshot, stored_difference, stored_membership_change
from meterline.sinks.versions import Versions
from meterline.streaming.ingest import start
from meterline.streaming.marks import advance_mark_set, read_after
from meterline.streaming.ordered import stream_ordered_delta
from meterline.streaming.tail import LINE, TASKS, Part, TailReader, _lines, follow_appended

from helpers import at, plan, rows

# ---- followed files


def run_tail(spark, tmp_path):
    lines = follow_appended(spark, str(tmp_path / "logs"), r".*\.log", part_bytes=64)
    writer = lines.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
    start(writer, "available_now").awaitTermination()
    back = spark.read.schema("path string, at bigint, value string").parquet(str(tmp_path / "out"))
    return sorted((os.path.basename(r.path), r.value) for r in back.collect())


def test_small_parts_share_tasks_and_read_little(tmp_path):
    """Each part is read to its own end and not a block beyond, and thousands of parts are no thousands of tasks."""
    text = "".join(f"{i}\n" for i in range(40_000)).encode()
    (tmp_path / "a.log").write_bytes(text)
    reader = TailReader({"path": str(tmp_path), "part_bytes": "64"})
    tasks = reader.partitions({}, reader.latestOffset())
    assert len(tasks) <= TASKS + 1
    got = [v for t in tasks for b in reader.read(t) for v in b.column("value").to_pylist()]
    assert got == [str(i) for i in range(40_000)]
    with open(tmp_path / "a.log", "rb") as raw:
        asked = []
        file = SimpleNamespace(read_at=lambda n, at: (asked.append(n), raw.seek(at), raw.read(n))[2])
        assert len([b for b in _lines(file, Part("a.log", 0, 0, 64))]) == 1
        assert sum(asked) <= 64 + LINE


def test_each_appended_line_is_read_once(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    want = []

    def put(name, text, mode="ab"):
        with open(logs / name, mode) as f:
            f.write(text.encode())

    def seen(name, *lines):
        want.extend((name, line) for line in lines)
        assert run_tail(spark, tmp_path) == sorted(want)

    put("a.log", "one\ntwo\nthr")
    put("b.log", "".join(f"line {i}\n" for i in range(50)))
    put("_hidden.log", "no\n")
    put("c.txt", "no\n")
    want.extend(("b.log", f"line {i}") for i in range(50))
    seen("a.log", "one", "two")
    put("a.log", "ee\r\n\nfour é\n")  # the rest of a line, an empty one, a line feed with a return before it
    seen("a.log", "three", "", "four é")
    seen("a.log")  # nothing new
    put("a.log", "short\n", "wb")  # truncated
    put("sub.log", "")
    seen("a.log", "short")
    put("a.log", "longer than everything the file has ever held before, in one go\nand more\n", "wb")  # replaced, larger
    put("b.log", "line 0\n" + "".join(f"other {i}\n" for i in range(80)), "wb")  # the same first line
    want.extend(("b.log", line) for line in ["line 0", *(f"other {i}" for i in range(80))])
    seen("a.log", "longer than everything the file has ever held before, in one go", "and more")
    os.remove(logs / "a.log")
    put("sub.log", "late\n")
    seen("sub.log", "late")
    put("a.log", "back\n")
    seen("a.log", "back")


def test_parts_of_a_file_hold_each_line_once(tmp_path):
    path = tmp_path / "x.log"
    rng = random.Random(1)
    lines = ["y" * rng.choice([0, 1, 7, 200]) + str(i) for i in range(300)]
    path.write_text("".join(f"{v}\n" for v in lines))
    for size in (1, 3, 64, 1000, 10**6):
        reader = TailReader({"path": str(tmp_path), "part_bytes": str(size)})
        parts = reader.partitions({}, reader.latestOffset())
        got = [v for p in parts for batch in reader.read(p) for v in batch.column("value").to_pylist()]
        assert got == lines
    assert list(reader.read(Part("", 0, 0, 0))) == []


# ---- samples put in order

SCHEMA = "id int, k string, time timestamp, c bigint, gate double"


@pytest.fixture(scope="module")
def shuffled(spark):
    """Samples a second or more apart, and the batch in which each arrives: up to a minute late."""
    rng = random.Random(2)
    data, t = [], 0
    for i in range(240):
        t += rng.randrange(1, 12)
        data.append((i, f"k{rng.randrange(4)}", at(t), rng.randrange(100), float(rng.randrange(5)), t + rng.randrange(60)))
    ends = sorted(r[5] for r in data)
    held = [(r[:5], sum(r[5] >= ends[q] for q in (80, 160))) for r in data]
    # a series that is silent after the first run, at whose end it is still held
    silent = [(900 + i, "silent", at(ends[80] - 70 + i * 5), 7 * i, 1.0) for i in (2, 0, 1)]
    return held + [(r, 0) for r in silent], t


@pytest.mark.parametrize(
    "policy",
    [{}, {"reset": "zero", "first": "zero", "max_gap_s": 20}, {"reset": "current", "first": "passthrough", "gate": "gate"}, {"reset": "null", "first": "drop"}],
    ids=str,
)
def test_ordered_delta_equals_batch(spark, shuffled, tmp_path, policy):
    data, newest = shuffled
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for part in range(3):  # each part is a run of its own, from the checkpoint of the last
        spark.createDataFrame([r for r, p in data if p == part], SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        deltas = stream_ordered_delta(stream, ["k"], "time", ["c"], "90 seconds", tiebreak=["id"], **policy)
        writer = deltas.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
        start(writer, "available_now").awaitTermination()
    want = counter_delta(spark.createDataFrame([r for r, _ in data], SCHEMA), ["k"], "time", ["c"], tiebreak=["id"], **policy)
    want = want.filter(F.col("time") <= F.lit(at(newest - 90)))
    got = spark.read.schema(deltas.schema).parquet(out)
    assert rows(got, "id", "c_delta") == rows(want, "id", "c_delta") and got.filter("k = 'silent'").count() >= 2


def test_a_series_that_is_gone_leaves_no_state(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    for batch in ([(1, "a", at(0), 10, 0.0), (2, "b", at(1), 5, 0.0)], [(3, "b", at(500), 9, 0.0)], [(4, "a", at(600), 15, 0.0), (5, "b", at(700), 12, 0.0)]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        deltas = stream_ordered_delta(spark.readStream.schema(SCHEMA).parquet(src), ["k"], "time", ["c"], "10 seconds", expire_after_s=100)
        writer = deltas.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
        start(writer, "available_now").awaitTermination()
    # after 100 silent seconds both begin anew
    assert rows(spark.read.schema(deltas.schema).parquet(out), "id", "c_delta") == [(1, None), (2, None), (3, None), (4, None)]


def test_state_is_a_few_values_a_group_whatever_the_number_of_series(spark, tmp_path):
    """Series of a group share their state; counters beyond 2^53, NULLs and instants come back as they were."""
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    data = [(n * 10 + i, f"s{n}" if n else None, at(i * 7 + n % 5), None if i == n % 7 else (1 << 60) + 3 * i * n, 0.5) for n in range(300) for i in range(5)]
    for part in (data[::2], data[1::2], [(9999, "last", at(10_000), 1, 0.0)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        deltas = stream_ordered_delta(spark.readStream.schema(SCHEMA).parquet(src), ["k"], "time", ["c"], "100 seconds", tiebreak=["id"], groups=3)
        query = start(deltas.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", cp), "available_now")
        query.awaitTermination()
        # two states, a timer and its index for each group
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 3 * 8
    want = counter_delta(spark.createDataFrame(data, SCHEMA), ["k"], "time", ["c"], tiebreak=["id"])
    got = spark.read.schema(deltas.schema).parquet(out)
    assert rows(got, "id", "k", "time", "c", "gate", "c_delta") == rows(want, "id", "k", "time", "c", "gate", "c_delta")


# ---- bucketed table

DOC = "id int, a string, b bigint, v bigint"


def bucket_files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_upsert_rewrites_only_the_buckets_it_hits(spark, tmp_path):
    path = str(tmp_path / "t")
    docs = BucketedTable.create(spark, path, DOC, "id", "v", buckets=8)
    docs.upsert(spark.createDataFrame([(i, "x", i, 1) for i in range(200)], DOC))
    _, before = docs.versions.latest()
    files = bucket_files(path)
    docs.upsert(spark.createDataFrame([(7, None, 70, 2), (7, "y", None, 3), (500, "new", None, 1)], DOC))
    _, after = docs.versions.latest()
    moved = {b for b in after["folders"] if after["folders"][b] != before["folders"].get(b)}
    assert 1 <= len(moved) <= 2
    assert {p: t for p, t in bucket_files(path).items() if p in files} == files  # what is there is never touched
    assert rows(docs.read().filter("id in (6, 7, 500)")) == [(6, "x", 6, 1), (7, "y", 70, 3), (500, "new", None, 1)]
    read = docs.lookup(spark.createDataFrame([(7,)], "id int"))
    assert rows(read) == [(7, "y", 70, 3)] and len({f.split("/data-")[1].split("/part")[0] for f in read.inputFiles()}) == 1
    gone = docs.vacuum()
    assert len(gone) == len([b for b in moved if b in before["folders"]]) and docs.read().count() == 201


def test_upserts_in_any_order_equal_one(spark, tmp_path):
    rng = random.Random(4)
    updates = [(rng.randrange(40), rng.choice([None, "p", "q", "r"]), rng.choice([None, rng.randrange(99)]), v) for v in range(300)]
    whole = spark.createDataFrame(updates, DOC)
    want = rows(upsert(whole.limit(0), whole, "id", "v"))
    rng.shuffle(updates)
    docs = BucketedTable.create(spark, str(tmp_path / "t"), DOC, "id", "v", buckets=4)
    for i in range(3):
        part = spark.createDataFrame(updates[i * 100 : (i + 1) * 100], DOC)
        assert docs.upsert(part, "s", i)
        assert not docs.upsert(part, "s", i) and not docs.upsert(part.withColumn("v", F.col("v") + 1000), "s", i)
    assert rows(docs.read()) == want
    assert docs.upsert(whole.limit(0)) and rows(docs.read()) == want


def test_two_writers_cannot_commit_one_number(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "v"))
    assert versions.latest() == (0, {})
    versions.commit(0, {"x": 1})
    with pytest.raises(Exception, match="(?i)exist"):
        versions.commit(0, {"x": 2})
    assert versions.latest() == (1, {"x": 1})


# ---- batches with a ledger


def refuses(deliver, *batches):
    def one(batch, documents):
        if batch in batches:
            raise ConnectionError(f"refused {batch}")
        deliver(batch, documents)

    return one


def test_rerun_goes_on_at_the_failed_batch(spark, tmp_path):
    path, folder = str(tmp_path / "batches"), str(tmp_path / "out")
    df = spark.createDataFrame([(i, f"d{i}") for i in range(95)], "id int, name string").repartition(5)
    assert stage_batches(df, path, ["id"], 10) == 10
    with pytest.raises(ValueError, match="staged"):
        stage_batches(df, path, ["id"], 10)
    with pytest.raises(BatchFailed, match="refused 4") as failed:
        send_batches(spark, path, refuses(to_files(folder), 4, 5), wave=3)
    assert failed.value.batch == 4
    assert sorted(os.listdir(folder))[-1].startswith("batch-000000000003")  # no wave after that of the failure
    with pytest.raises(BatchFailed, match="refused 8"):
        send_batches(spark, path, refuses(to_files(folder), 8), wave=4)
    assert send_batches(spark, path, to_files(folder), wave=100) == 10
    assert send_batches(spark, path, refuses(to_files(folder), 1), wave=100) == 10  # nothing is left to send
    got = spark.read.schema("id int, name string").json(folder).withColumn("file", F.input_file_name())
    assert rows(got, "id", "name") == [(i, f"d{i}") for i in range(95)]
    sizes = got.groupBy("file").agg(F.count(F.lit(1)).alias("n"), (F.max("id") - F.min("id")).alias("span"))
    assert rows(sizes, "n", "span") == [(5, 4), *[(10, 9)] * 9]
    tried = read_ledger(spark, path)
    assert rows(tried.filter("error is not null"), "batch") == [(4,), (5,), (8,)]
    assert rows(tried.filter("error is null"), "batch") == [(i,) for i in range(10)]


# ---- marks with ties


def test_ties_at_the_mark_are_read_once(spark, tmp_path):
    path = str(tmp_path / "marks")
    df = lambda *r: spark.createDataFrame(list(r), "id string, created bigint")
    first = df(("a", 10), ("b", 20), ("c", 20))
    assert read_after(first, "created", "id", path, "j").count() == 3
    assert rows(read_after(first, "created", "id", path, "j", default=15), "id") == [("b",), ("c",)]
    advance_mark_set(first, "created", "id", path, "j")
    second = df(("a", 10), ("b", 20), ("c", 20), ("d", 20), ("e", 20), ("late", 15))
    assert rows(read_after(second, "created", "id", path, "j"), "id") == [("d",), ("e",)]
    advance_mark_set(read_after(second, "created", "id", path, "j"), "created", "id", path, "j")
    assert read_after(second, "created", "id", path, "j").count() == 0
    advance_mark_set(second.limit(0), "created", "id", path, "j")
    advance_mark_set(df(("old", 1)), "created", "id", path, "j")  # neither moves it
    third = df(("e", 20), ("f", 20), ("g", 30), (None, 20))
    assert rows(read_after(third, "created", "id", path, "j"), "id") == [(None,), ("f",), ("g",)]
    assert read_after(third, "created", "id", path, "other").count() == 4
    for i in range(5):
        advance_mark_set(df((f"x{i}", 40 + i)), "created", "id", path, "j")
    assert len([d for d in os.listdir(f"{path}/j") if d.startswith("ids-")]) == 2  # old marks are removed


# ---- compaction in place


def test_packing_fills_bins():
    rng = random.Random(3)
    sizes = {f"f{i:03d}": rng.randrange(1, 1000) for i in range(200)}
    bins = pack(sizes, 10, 1 << 40)
    assert len(bins) <= 10 and sorted(f for b in bins for f in b) == sorted(sizes)
    loads = [sum(sizes[f] for f in b) for b in bins]
    assert max(loads) <= 1.2 * sum(loads) / 10
    tight = pack(sizes, 10, 2000)
    assert len(tight) > 10 and max(sum(sizes[f] for f in b) for b in tight) <= 2000
    assert pack({"big": 5000, "a": 1, "b": 1}, 10, 2000)[0] == ["big"]
    assert pack({}, 10, 100) == [] and pack({"e": 0}, 10, 100) == [["e"]]


def test_compaction_shuffles_nothing(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.range(500).select(F.struct(F.col("id").alias("x")).alias("data"), F.lit(2024).alias("year"), F.lit(1).alias("month"), (F.col("id") % 2 + 1).cast("int").alias("day"))
    df.repartition(25).write.partitionBy("year", "month", "day").orc(src)
    files = [f for f in spark.read.orc(src).inputFiles() if "day=2" in f]
    assert "Exchange" not in plan(packed_rows(spark, src, [files[:3], files[3:]], ["data"]))
    target = compact_day(spark, src, out, 2024, 1, 2, files=4)
    back = spark.read.orc(target)
    assert 1 <= len(back.inputFiles()) <= 4
    assert rows(back, "data.x", "year", "day") == [(i, 2024, 2) for i in range(1, 500, 2)]
    with pytest.raises(Exception, match="(?i)exists"):
        compact_day(spark, src, out, 2024, 1, 2, files=4)


# ---- search that skips files

LOG = "time timestamp, _documentType string, message string, _tag_appName string, _plugin string, level string"


def test_search_opens_few_files(spark, tmp_path):
    rng = random.Random(6)
    data = [(at(rng.randrange(86_400 * 10)), "t", f"m{i}", f"app{rng.randrange(20)}", "p", rng.choice(["info", "error"])) for i in range(4000)]
    data += [(at(5), None, "untagged", None, None, None)]
    logs = spark.createDataFrame(data, LOG)
    path = str(tmp_path / "c")
    write_clustered(logs, path, files=40)
    t0 = int(at(0).timestamp())
    for tag, hours in (("app3", 1), ("app17", 24), (None, 1)):
        low, high = t0 + 86_400 * 4, t0 + 86_400 * 4 + 3600 * hours
        found = search_clustered(spark, path, low, high, tag, level="error")
        assert rows(found, "message") == rows(search_logs(logs, low, high, tag, level="error"), "message")
        opened = files_for(spark, path, low, high, tag)
        assert set(found.inputFiles()) == set(opened)
        assert len(opened) <= (4 if tag else 20)
    assert search_clustered(spark, path, t0 - 900, t0 - 600, "app3").count() == 0
    assert search_clustered(spark, path, t0 - 1, t0 + 10, None).filter("message = 'untagged'").count() == 1
    # the writer put Bloom filters on the searched columns
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    orc = jvm.org.apache.orc.OrcFile
    reader = orc.createReader(jvm.org.apache.hadoop.fs.Path(opened[0]), orc.readerOptions(conf))
    footer = reader.rows().readStripeFooter(reader.getStripes().get(0))
    assert "BLOOM_FILTER_UTF8" in footer.toString()


# ---- snapshots with digests


def test_equal_ranges_are_not_read(spark, tmp_path):
    cols = "k int, name string, n bigint"
    data = [(i, f"n{i}", i * 10) for i in range(3000)]
    changed = [r for r in data if r[0] not in (5, 77)] + [(9001, "new", 1)]
    changed = [(k, name, n + 3) if k == 1234 else (k, name, n) for k, name, n in changed]
    prev, cur = str(tmp_path / "prev"), str(tmp_path / "cur")
    a, b = spark.createDataFrame(data, cols), spark.createDataFrame(changed, cols).repartition(3)
    store_snapshot(a, prev, ["k"], 64)
    store_snapshot(b, cur, ["k"], 64)
    assert rows(stored_membership_change(spark, cur, prev)) == rows(membership_change(b, a, ["k"])) == [(5, "removed"), (77, "removed"), (9001, "added")]
    assert rows(stored_difference(spark, cur, prev, ["n"]), "k", "n") == [(1234, 3), (9001, 1)]
    now, before = changed_parts(StoredSnapshot(spark, cur), StoredSnapshot(spark, prev))
    assert now.count() < 20 and before.count() < 20
    folders = re.search(r"PartitionFilters: \[[^\]]*_range#\d+ IN \(([\d,]+)\)", plan(now))
    assert 1 <= len(folders[1].split(",")) <= 4  # of 64
    same = str(tmp_path / "same")
    store_snapshot(a.repartition(7), same, ["k"], 64)
    assert stored_membership_change(spark, same, prev).count() == 0
    assert changed_parts(StoredSnapshot(spark, same), StoredSnapshot(spark, prev))[0].count() == 0


# ---- stored window counts


def plain_counts(logs, low, high, **terms):
    start = F.floor(F.unix_timestamp("time") / 300) * 300
    return rows(search_logs(logs, low, high, **terms).groupBy(start.alias("start_s")).agg(F.count(F.lit(1)).alias("count")))


def test_stored_counts_equal_a_full_scan(spark, tmp_path):
    rng = random.Random(8)
    span = 3 * 86_400
    data = [(at(rng.randrange(span)), rng.choice(["t", None]), f"m{i}", f"app{rng.randrange(3)}", "p", rng.choice(["info", "error"])) for i in range(3000)]
    data += [(at(s), "t", f"edge{s}", "app1", "p", "error") for s in (0, 299, 300, 301, 86_399, 86_400, span - 1)]
    logs = spark.createDataFrame(data, LOG).cache()
    path, t0 = str(tmp_path / "counts"), int(at(0).timestamp())
    late = F.to_date("time") == "2024-01-02"
    refresh_counts(logs.filter(~(late & (F.col("level") == "error"))), path)
    files = bucket_files(path)
    refresh_counts(logs, path, ["2024-01-02"])
    left = bucket_files(path)
    assert {f for f in files if f not in left} == {f for f in files if "2024-01-02" in f}
    ranges = [(0, span), (-1, 300), (299, 301), (299, 300), (17, 18), (5, 86_400), (86_399, 86_401), (150, 450), (10, 250), (1234, 98_765), (-500, span + 500)]
    for low, high in ranges:
        for terms in ({}, {"tag": "app1", "level": "error"}, {"doc_type": "t"}):
            got = rows(count_logs_stored(spark, path, logs, t0 + low, t0 + high, **terms))
            assert got == plain_counts(logs, t0 + low, t0 + high, **terms), (low, high, terms)
