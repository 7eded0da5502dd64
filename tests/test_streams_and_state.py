"""Streams equal their batch forms over several micro-batches; marks, lifecycle, followed files."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from meterline.operators.aggregates import count_windows
from meterline.operators.counters import counter_delta
from meterline.sources.logs import read_partitioned
from meterline.streaming.counters import drop_restarted_polls, stream_counter_delta
from meterline.streaming.ingest import complete_files, follow_files, ingest_pipeline, start, stream_count_windows
from meterline.streaming.marks import advance_lifecycle, advance_mark, empty_marks, read_marks, read_since

from helpers import at, rows

SCHEMA = "id int, k string, time timestamp, c bigint, gate double"


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(2)
    data, t = [], 0
    for i in range(240):
        t += rng.randrange(1, 30)
        data.append((i, f"k{rng.randrange(4)}", at(t), rng.randrange(100), float(rng.randrange(5))))
    return spark.createDataFrame(data, SCHEMA).cache()


def staged(samples, tmp_path, parts=4):
    """The samples in time-ordered files, each its own micro-batch."""
    path = str(tmp_path / "src")
    for i in range(parts):
        lo, hi = i * 240 // parts, (i + 1) * 240 // parts
        samples.filter((F.col("id") >= lo) & (F.col("id") < hi)).coalesce(1).write.mode("append").parquet(path)
    return samples.sparkSession.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def drain(df, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    writer = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", str(tmp_path / "cp"))
    job = start(writer, "available_now")
    job.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out), job


@pytest.mark.parametrize(
    "policy",
    [
        {}, {"reset": "zero", "first": "zero"}, {"reset": "current", "first": "passthrough"}, {"reset": "null", "first": "drop"},
        {"gate": "gate", "first": "zero"}, {"max_gap_s": 40},
    ],
    ids=str,
)
def test_streamed_delta_equals_batch(samples, tmp_path, policy):
    got, _ = drain(stream_counter_delta(staged(samples, tmp_path), ["k"], "time", ["c"], tiebreak=["id"], **policy), tmp_path)
    want = counter_delta(samples, ["k"], "time", ["c"], tiebreak=["id"], **policy)
    assert rows(got, "id", "c_delta") == rows(want, "id", "c_delta")


def test_streamed_drop_batch_equals_batch(samples, tmp_path):
    polled = samples.withColumn("poll", F.date_trunc("minute", "time"))
    got, _ = drain(stream_counter_delta(staged(samples, tmp_path, 1), ["k"], "time", ["c"], reset="drop_batch"), tmp_path)
    got = drop_restarted_polls(got.withColumn("poll", F.date_trunc("minute", "time")), ["poll"])
    want = counter_delta(polled, ["k"], "time", ["c"], reset="drop_batch", poll=["poll"])
    assert rows(got, "id", "c_delta") == rows(want, "id", "c_delta")


def test_late_sample_is_null_and_forgotten(spark, tmp_path):
    path = str(tmp_path / "src")
    for batch in ([(1, "a", at(0), 10, 0.0), (2, "a", at(20), 30, 0.0)], [(3, "a", at(10), 15, 0.0)], [(4, "a", at(30), 45, 0.0)]):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    got, _ = drain(stream_counter_delta(stream, ["k"], "time", ["c"]), tmp_path)
    assert rows(got, "id", "c_delta") == [(1, None), (2, 20), (3, None), (4, 15)]


def test_streamed_windows_equal_batch(samples, tmp_path):
    got, job = drain(stream_count_windows(staged(samples, tmp_path), "time", "1 minute", "0 seconds"), tmp_path)
    newest = samples.agg(F.max("time")).first()[0]
    want = count_windows(samples, "time", "1 minute").filter(F.col("end") <= F.lit(newest))
    assert rows(got, "timestamp", "count") == rows(want, "timestamp", "count") and len(got.collect()) > 5


def test_ingest_puts_late_rows_in_their_date(spark, tmp_path):
    src = str(tmp_path / "src")
    for text in ('{"time": "2024-01-02T10:00:00Z", "level": "info"}', '{"time": "2024-01-01T10:00:00Z", "level": "late"}', "no json"):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("append").text(src)
    stream = follow_files(spark, src, "value STRING", per_trigger=1)
    job = ingest_pipeline(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "available_now")
    job.awaitTermination()
    got = read_partitioned(spark, str(tmp_path / "out"))
    assert rows(got, "day", "data.level") == [(None, None), (1, "late"), (2, "info")]
    # a restart with the same checkpoint adds nothing
    ingest_pipeline(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "available_now").awaitTermination()
    assert got.count() == 3


def test_marks(spark, tmp_path):
    path = str(tmp_path / "marks")
    df = spark.createDataFrame([("w1", 10), ("w2", 20), ("w3", 20), ("w4", 30)], "id string, created bigint")
    assert read_since(df, "created", empty_marks(spark), "wf").count() == 4
    assert rows(read_since(df, "created", empty_marks(spark), "wf", default=25), "id") == [("w4",)]
    advance_mark(df.filter("created <= 20"), "created", path, "wf", "id")
    advance_mark(df.filter("created > 99"), "created", path, "wf", "id")  # nothing processed: mark stays
    marks = read_marks(spark, path)
    # the row the mark came from is left out, its twin in time is not
    assert rows(read_since(df, "created", marks, "wf", "id"), "id") == [("w2",), ("w4",)]
    assert read_since(df, "created", marks, "other").count() == 4


def test_lifecycle(spark):
    cur = spark.createDataFrame(
        [("done", "RUNNING", 0, "init"), ("run", "RUNNING", 0, "init"), ("new", "PREP", 99_000, "init"), ("old", "PREP", 0, "init"), ("kept", "FAILED", 0, "processed"), ("unseen", "PREP", 0, "init")],
        "wfId string, status string, time bigint, workflowMonitorStatus string",
    )
    upd = spark.createDataFrame([("done", "SUCCEEDED"), ("run", "RUNNING"), ("new", "SUSPENDED"), ("old", "SUSPENDED"), ("kept", "SUSPENDED")], "wfId string, status string")
    got = {r.wfId: (r.status, r.workflowMonitorStatus) for r in advance_lifecycle(cur, upd, 100_000).collect()}
    assert got == {
        "done": ("SUCCEEDED", "processed"), "run": ("RUNNING", "init"), "new": ("SUSPENDED", "init"), "old": ("SUSPENDED", "processed"),
        "kept": ("FAILED", "processed"), "unseen": ("PREP", "init"),
    }


def test_end_marker(spark):
    df = spark.createDataFrame([("a", "<x>"), ("a", "</testResults>"), ("b", "<x>")], "path string, value string")
    assert rows(complete_files(df), "path") == [("a",)]


SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from meterline.session import build_session
from meterline.streaming.counters import stream_counter_delta
from meterline.streaming.ingest import start
spark = build_session("outside", "local[2]", **{{"spark.sql.shuffle.partitions": "2"}})
stream = spark.readStream.schema({schema!r}).parquet({src!r})
out = stream_counter_delta(stream, ["k"], "time", ["c"])
start(out.writeStream.format("parquet").option("path", {out!r}).option("checkpointLocation", {cp!r}), "available_now").awaitTermination()
print("rows", spark.read.parquet({out!r}).count())
"""


def test_workers_need_no_package(samples, tmp_path):
    """Started from another folder, Python workers cannot import the library."""
    src = str(tmp_path / "src")
    samples.write.parquet(src)
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = SCRIPT.format(repo=repo, schema=SCHEMA, src=src, out=str(tmp_path / "o"), cp=str(tmp_path / "c"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 240" in done.stdout, done.stderr[-2000:]
