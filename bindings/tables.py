"""Tables that change: followed files, ordered streams, bucketed upserts, batches with a ledger, marks."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Window
from pyspark.sql import functions as F

from meterline.operators.ordering import generate_records, global_sort
from meterline.session import scratch_path
from meterline.sinks import BatchFailed, BucketedTable, read_ledger, send_batches, stage_batches, to_files
from meterline.sources.history import find_history, history_day
from meterline.streaming.ingest import start
from meterline.streaming.marks import advance_mark_set, read_after
from meterline.streaming.ordered import stream_ordered_delta
from meterline.streaming.tail import follow_appended

from .common import SAMPLES, query, table


def _log_writer(folder: str):
    """Writes the lines of the files, which come file by file and in order, from task to shared folder;
    a repeated task writes the same."""

    def write(batches):
        fs, path = pafs.FileSystem.from_uri(folder) if ":" in folder.split("/", 1)[0] else (pafs.LocalFileSystem(), folder)
        made, name, out, n = set(), None, None, 0
        for batch in batches:
            files, values = batch.column("file").to_pylist(), batch.column("value").to_pylist()
            n += len(files)
            at = 0
            while at < len(files):
                if files[at] != name:
                    if out is not None:
                        out.close()
                    name = files[at]
                    into = f"{path}/{name}".rpartition("/")[0]
                    if into not in made:
                        fs.create_dir(into, recursive=True)
                        made.add(into)
                    out = fs.open_output_stream(f"{path}/{name}")
                end = bisect_right(files, name, at)
                out.write("".join(f"{v}\n" for v in values[at:end]).encode())
                at = end
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return write


def _write_logs(lines, folder: str) -> None:
    """A file (``file``, ``at``, ``value``) is written by one task, as the sort lets its lines pass."""
    lines.repartition("file").sortWithinPartitions("file", "at").mapInArrow(_log_writer(folder), "n bigint").agg(F.sum("n")).collect()


@query(
    "appended_files",
    """
SELECT 'log' || CAST(o_custkey % 7 AS VARCHAR) AS file, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS total
FROM orders WHERE NOT (o_custkey % 7 = 3 AND o_orderkey % 4 = 3) GROUP BY 1""",
)
def appended(spark, sf_dir):
    """Seven log files that grow: the stream runs after each of three looks. File 2 was truncated before the
    second look and refilled with the lines that come next, file 3 loses its last quarter unseen."""
    landing, out, state = (scratch_path(spark, n) for n in ("tailed", "tailed-out", "tailed-state"))
    part = F.col("o_orderkey") % 4
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("log"), (F.col("o_custkey") % 7).cast("string")).alias("file"), F.col("o_orderkey").alias("at"),
        F.col("o_orderkey").cast("string").alias("value"), part.alias("part"),
    )
    lost = (F.col("file") == "log3") & (F.col("part") == 3)
    looks = [F.col("part") == 0, F.when(F.col("file") == "log2", F.col("part").isin(1, 2)).otherwise(F.col("part") <= 2), F.when(F.col("file") == "log2", F.col("part") == 3).otherwise(~lost)]
    for look in looks:
        # what was there stays as it is: a file's lines are in the order in which its parts came
        now = rows.filter(look).withColumn("at", F.col("part") * (1 << 40) + F.col("at")).select("file", "at", "value")
        _write_logs(now, landing)
        lines = follow_appended(spark, landing, "log.*", part_bytes=4096)
        writer = lines.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        start(writer, "available_now").awaitTermination()
    back = spark.read.schema("path string, at bigint, value string").parquet(out)
    file = F.regexp_extract("path", r"([^/]+)$", 1).alias("file")
    return back.groupBy(file).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("bigint")).alias("total"))


@query(
    "streamed_ordered_delta",
    f"""
WITH {SAMPLES}, l AS (SELECT *, lag(c) OVER w AS pc, lag(event_id) OVER w IS NULL AS head FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN head THEN 0 WHEN c < pc THEN c ELSE c - pc END AS c_delta FROM l
WHERE epoch_us(ts) <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events) - 8 * 86400000000::BIGINT""",
)
def ordered_deltas(spark, sf_dir):
    """Samples arrive in an order that is off by up to a week, in three runs of a stream that goes on from its
    checkpoint; the deltas are those of the sorted table, up to the watermark."""
    rows = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.round(F.col("value") * 100).cast("bigint").alias("c")
    )
    landed, out, state = (scratch_path(spark, n) for n in ("late", "late-out", "late-state"))
    # arrival: the time plus up to seven days
    came = F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(7 * 86_400 * 1_000_000))
    cuts = rows.select(came.alias("t")).approxQuantile("t", [1 / 3, 2 / 3], 0.01)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows if low is None else rows.filter(came >= int(low))
        (part if high is None else part.filter(came < int(high))).write.mode("append").parquet(landed)
        stream = spark.readStream.schema(rows.schema).parquet(landed)
        deltas = stream_ordered_delta(stream, ["user_id"], "ts", ["c"], "8 days", reset="current", first="zero", tiebreak=["event_id"])
        writer = deltas.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state)
        start(writer, "available_now").awaitTermination()
    return spark.read.schema(deltas.schema).parquet(out).select("event_id", "c_delta")


UPSERTED = """
WITH u AS (SELECT c_custkey * 2 AS id, c_mktsegment AS segment, CAST(round(c_acctbal * 100) AS BIGINT) AS cents, CAST(-1 AS BIGINT) AS version FROM customer
           UNION ALL SELECT o_custkey, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END, CASE WHEN o_orderstatus <> 'F' THEN CAST(round(o_totalprice * 100) AS BIGINT) END, o_orderkey FROM orders)
SELECT id, arg_max(segment, version) FILTER (WHERE segment IS NOT NULL) AS segment, arg_max(cents, version) FILTER (WHERE cents IS NOT NULL) AS cents, max(version) AS version FROM u GROUP BY 1"""
DOCUMENT = "id BIGINT, segment STRING, cents BIGINT, version BIGINT"


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") * 2).cast("bigint").alias("id"), F.col("c_mktsegment").alias("segment"), F.round(F.col("c_acctbal") * 100).cast("bigint").alias("cents"),
        F.lit(-1).cast("bigint").alias("version"),
    )


def _order_updates(spark, sf_dir):
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("bigint").alias("id"), F.when(status == "O", F.col("o_orderpriority")).alias("segment"),
        F.when(status != "F", F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"), F.col("o_orderkey").cast("bigint").alias("version"),
    )


@query("bucketed_upsert", UPSERTED)
def bucketed_upsert(spark, sf_dir):
    """Updates in three batches, the newest first: the table ends as if they had come together."""
    docs = BucketedTable.create(spark, scratch_path(spark, "bucketed"), DOCUMENT, "id", "version", buckets=16)
    updates = _order_updates(spark, sf_dir)
    for part in (2, 1, 0):
        docs.upsert(updates.filter(F.col("version") % 3 == part), "orders", 2 - part)
    docs.upsert(updates.filter(F.col("version") % 3 == 2), "orders", 0)  # repeated: changes nothing
    docs.upsert(_customers(spark, sf_dir))
    return docs.read()


@query("bucketed_upsert_stream", UPSERTED)
def bucketed_upsert_stream(spark, sf_dir):
    """The same through foreachBatch, a file of updates to a micro-batch."""
    landed, state = scratch_path(spark, "updates"), scratch_path(spark, "updates-state")
    _order_updates(spark, sf_dir).unionByName(_customers(spark, sf_dir)).repartition(3).write.parquet(landed)
    docs = BucketedTable.create(spark, scratch_path(spark, "bucketed"), DOCUMENT, "id", "version", buckets=16)
    stream = spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", 1).parquet(landed)
    writer = stream.writeStream.foreachBatch(docs.batch_writer("stream")).option("checkpointLocation", state)
    start(writer, "available_now").awaitTermination()
    docs.vacuum()
    return docs.read()


def _failing(deliver, at: int):
    """A delivery that fails for one batch."""

    def one(batch, documents):
        if batch == at:
            raise ConnectionError("refused")
        deliver(batch, documents)

    return one


@query(
    "batches_after_failure",
    """
SELECT CAST((n - 1) // 300 AS BIGINT) AS batch, count(*) AS documents, CAST(sum(o_orderkey) AS BIGINT) AS total, (n - 1) // 300 = 2 AS failed_once
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS n FROM orders) GROUP BY 1, 4""",
)
def batches_after_failure(spark, sf_dir):
    """Batches of 300 orders, four to a wave; the third is refused at first, the rerun goes on there."""
    path, folder = scratch_path(spark, "sent"), scratch_path(spark, "received")
    stage_batches(table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), path, ["o_orderdate", "o_orderkey"], 300)
    try:
        send_batches(spark, path, _failing(to_files(folder), 2), wave=4)
        raise AssertionError("the planted failure was not met")
    except BatchFailed as failed:
        assert failed.batch == 2
    send_batches(spark, path, to_files(folder), wave=1000)
    got = spark.read.schema("o_orderkey BIGINT").json(folder).select("o_orderkey", F.regexp_extract(F.input_file_name(), r"batch-(\d+)", 1).cast("bigint").alias("batch"))
    tried = read_ledger(spark, path).groupBy("batch").agg((F.count("error") > 0).alias("failed_once"), F.count_if(F.col("error").isNull()).alias("ok"))
    sums = got.groupBy("batch").agg(F.count(F.lit(1)).alias("documents"), F.sum("o_orderkey").alias("total"))
    return sums.join(tried.filter("ok = 1"), "batch").select("batch", "documents", "total", "failed_once")


@query("marks_with_ties", "SELECT o_orderkey, CAST(1 AS BIGINT) AS times FROM orders")
def marks_with_ties(spark, sf_dir):
    """Orders of a year share one mark. They come in four parts, two of them in the middle of
    a year; each run reads on from the mark, and every order is read once."""
    marks, out = scratch_path(spark, "tied"), scratch_path(spark, "tied-out")
    rows = table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate").cast("bigint"))
    half = F.pmod(F.xxhash64("o_orderkey"), F.lit(2)) == 0
    parts = [F.col("year") < 1995, (F.col("year") < 1996) | ((F.col("year") == 1996) & half), F.col("year") <= 1996, F.lit(True)]
    for seen in parts:
        fresh = read_after(rows.filter(seen), "year", "o_orderkey", marks, "orders")
        fresh.select("o_orderkey", "year").write.mode("append").parquet(out)
        advance_mark_set(fresh, "year", "o_orderkey", marks, "orders")
    return spark.read.parquet(out).groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("times"))


@query(
    "history_files_of_jobs",
    """
SELECT c_custkey, count(*) AS files FROM customer CROSS JOIN (SELECT 0 AS d UNION ALL SELECT 1) GROUP BY 1""",
)
def history_files(spark, sf_dir):
    """A history file per customer in the folder of each of two days, found by the first job's finish."""
    base = scratch_path(spark, "history")
    day = history_day(1704067200)
    # the history server begins a folder every 1000 jobs
    serial = F.lpad(F.floor(F.col("c_custkey") / 1000).cast("string"), 9, "0")
    rows = table(spark, sf_dir, "customer").select(serial.alias("serial"), F.concat(F.lit("job_"), F.lpad(F.col("c_custkey").cast("string"), 12, "0")).alias("job"))
    for d in (0, 1, 2):  # the third day's files are not the job's
        folder = f"{base}/done/{day.year:04d}/{day.month:02d}/{day.day + d:02d}"
        lines = rows.select(F.concat("serial", F.lit("/"), "job", F.lit(".jhist")).alias("file"), F.lit(0).cast("bigint").alias("at"), F.lit("Avro-Json").alias("value"))
        _write_logs(lines, folder)
    found = find_history(spark, base, day, finished_after="2024-01-01T00:00:00")
    job = F.regexp_extract("path", r"job_(\d+)\.jhist", 1).cast("bigint")
    return found.groupBy(job.alias("c_custkey")).agg(F.count(F.lit(1)).alias("files"))


@query(
    "generated_record_sort",
    """
SELECT CAST(count(*) AS BIGINT) AS n, true AS sorted, true AS sized FROM lineitem""",
)
def generated_sort(spark, sf_dir):
    """As many generated records as there are line items, sorted; neighbours within partitions and the
    partitions' ends are in order."""
    n = table(spark, sf_dir, "lineitem").count()
    path = scratch_path(spark, "generated")
    global_sort(generate_records(spark, n, 7), "key").withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    done = spark.read.parquet(path).withColumn("part", F.shiftright("row", 33))
    # one row for each partition of the sort
    ends = done.groupBy("part").agg(F.min_by("key", "row").alias("first"), F.max_by("key", "row").alias("last"), F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n"), F.min(F.length("key") + F.length("payload")).alias("size"))
    before = F.lag("high").over(Window.orderBy("part"))
    ok = (F.col("first") == F.col("low")) & (F.col("last") == F.col("high")) & F.coalesce(before <= F.col("low"), F.lit(True))
    return ends.withColumn("ok", ok).agg(F.sum("n").alias("n"), F.every("ok").alias("sorted"), (F.min("size") == 100).alias("sized"))
