"""Streaming operators, run to the end of the data, and incremental state."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.session import scratch_path
from meterline.sources.logs import read_partitioned
from meterline.streaming.counters import drop_restarted_polls, stream_counter_delta, stream_counter_rate
from meterline.streaming.ingest import follow_files, ingest_pipeline, start, stream_count_windows
from meterline.streaming.marks import advance_lifecycle, advance_mark, read_marks, read_since

from .common import SAMPLES, query, table


def _event_stream(spark, sf_dir):
    """The event table as a file stream; the glob matches it as a file and as a folder of files."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")


@query(
    "ingest_stream",
    """
SELECT CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, event_type AS level, count(*) AS n
FROM events GROUP BY 1, 2, 3, 4""",
)
def ingest(spark, sf_dir):
    """Events as JSON messages, ingested to partitioned ORC and read back."""
    payload = F.to_json(
        F.struct(
            F.col("user_id").cast("string").alias("_plugin"), F.col("event_type").alias("level"),
            F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("time"), F.col("props").alias("message"),
        )
    )
    out, state = scratch_path(spark, "ingest"), scratch_path(spark, "ingest-state")
    job = ingest_pipeline(_event_stream(spark, sf_dir).select(payload.cast("binary").alias("value")), out, state, "available_now")
    job.awaitTermination()
    rows = read_partitioned(spark, out)
    return rows.groupBy("year", "month", "day", F.col("data.level").alias("level")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "streamed_window_counts",
    """
SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, time_bucket(INTERVAL '5 minutes', ts) + INTERVAL '5 minutes' AS "end", count(*) AS count,
       CAST(epoch(time_bucket(INTERVAL '5 minutes', ts)) AS BIGINT) AS timestamp
FROM events GROUP BY 1, 2, 4 HAVING start + INTERVAL '5 minutes' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'""",
)
def streamed_windows(spark, sf_dir):
    """Append mode: windows the watermark has closed."""
    out, state = scratch_path(spark, "windows"), scratch_path(spark, "windows-state")
    counted = stream_count_windows(_event_stream(spark, sf_dir), "ts", "5 minutes", "10 minutes")
    writer = counted.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state)
    start(writer, "available_now").awaitTermination()
    back = spark.read.parquet(out)
    return back.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz")})


RUNS = 3


def _streamed_deltas(spark, sf_dir, counter="c", rate=False, **policy):
    """The events land in order of time, a part at a time, and each part is taken by a run of the
    stream that goes on from the state the last one left."""
    c = F.round(F.col("value") * 100).cast("bigint")
    rows = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), c.alias("c"), (c + F.lit(1 << 60)).alias("big")
    )
    cuts = rows.select(F.unix_micros("ts").alias("t")).approxQuantile("t", [i / RUNS for i in range(1, RUNS)], 0.01)
    landed, out, state = (scratch_path(spark, n) for n in ("landed", "deltas", "deltas-state"))
    operator = stream_counter_rate if rate else stream_counter_delta
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows
        if low is not None:
            part = part.filter(F.unix_micros("ts") >= int(low))
        if high is not None:
            part = part.filter(F.unix_micros("ts") < int(high))
        part.write.mode("append").parquet(landed)
        stream = spark.readStream.schema(rows.schema).parquet(landed)
        deltas = operator(stream, ["user_id"], "ts", [counter], tiebreak=["event_id"], **policy)
        writer = deltas.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", state)
        start(writer, "available_now").awaitTermination()
    return spark.read.parquet(out)


@query(
    "streamed_counter_delta",
    f"""
WITH {SAMPLES}, l AS (SELECT *, lag(c) OVER w AS pc, lag(event_id) OVER w IS NULL AS head FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN head THEN 0 WHEN c < pc THEN c ELSE c - pc END AS c_delta FROM l""",
)
def streamed_deltas(spark, sf_dir):
    return _streamed_deltas(spark, sf_dir, reset="current", first="zero").select("event_id", "c_delta")


@query(
    "streamed_large_counters",
    f"""
WITH {SAMPLES}, l AS (SELECT *, lag(c) OVER w AS pc FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, c - pc AS big_delta FROM l""",
)
def streamed_large(spark, sf_dir):
    """Counters beyond 2^53, which doubles cannot tell apart."""
    return _streamed_deltas(spark, sf_dir, "big", reset="raw").select("event_id", "big_delta")


@query(
    "streamed_counter_rate",
    f"""
WITH {SAMPLES}, l AS (SELECT *, lag(c) OVER w AS pc, lag(ts) OVER w AS pts FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN floor(epoch(ts)) > floor(epoch(pts)) THEN CAST(c - pc AS DOUBLE) / (floor(epoch(ts)) - floor(epoch(pts))) END AS c_rate FROM l""",
)
def streamed_rates(spark, sf_dir):
    """Rates over several micro-batches."""
    return _streamed_deltas(spark, sf_dir, rate=True).select("event_id", "c_rate")


@query(
    "streamed_restart_polls",
    f"""
WITH {SAMPLES}, l AS (SELECT *, lag(c) OVER w AS pc FROM samples WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, c - pc AS c_delta FROM l WHERE date_trunc('minute', ts) NOT IN (SELECT date_trunc('minute', ts) FROM l WHERE c < pc)""",
)
def streamed_restarts(spark, sf_dir):
    rows = _streamed_deltas(spark, sf_dir, reset="drop_batch").withColumn("poll", F.date_trunc("minute", "ts"))
    return drop_restarted_polls(rows, ["poll"]).select("event_id", "c_delta")


@query(
    "incremental_mark",
    """
SELECT o_orderkey FROM orders WHERE CAST(epoch(o_orderdate) AS BIGINT) >= (SELECT max(CAST(epoch(o_orderdate) AS BIGINT)) FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01')
  AND o_orderkey <> (SELECT arg_max(o_orderkey, (CAST(epoch(o_orderdate) AS BIGINT), CAST(o_orderkey AS VARCHAR))) FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01')""",
)
def incremental(spark, sf_dir):
    """A first run takes the orders before 2000 and leaves a mark with the row it came from; the second
    reads on from it, without that row."""
    marks = scratch_path(spark, "marks")
    rows = table(spark, sf_dir, "orders").withColumn("created", F.unix_timestamp("o_orderdate"))
    first = rows.filter(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    advance_mark(first, "created", marks, "orders", "o_orderkey")
    done = read_marks(spark, marks)
    return read_since(rows, "created", done, "orders", "o_orderkey").select("o_orderkey")


@query(
    "lifecycle_states",
    """
SELECT o_orderkey, CASE WHEN seen THEN CASE WHEN o_orderstatus = 'O' THEN 'SUCCEEDED' WHEN o_orderstatus = 'F' THEN 'SUSPENDED' ELSE 'PREP' END ELSE 'PREP' END AS status,
       CASE WHEN seen AND (o_orderstatus = 'O' OR (o_orderstatus = 'F' AND 1000000000 - CAST(epoch(o_orderdate) AS BIGINT) > 86400)) THEN 'processed' ELSE 'init' END AS "workflowMonitorStatus"
FROM (SELECT *, o_custkey IN (SELECT c_custkey * 2 FROM customer) AS seen FROM orders)""",
)
def lifecycle(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    current = o.select(
        F.col("o_orderkey").alias("wfId"), F.lit("PREP").alias("status"), F.unix_timestamp("o_orderdate").alias("time"), F.lit("init").alias("workflowMonitorStatus")
    )
    seen = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 2).alias("o_custkey"))
    state = F.when(F.col("o_orderstatus") == "O", "SUCCEEDED").when(F.col("o_orderstatus") == "F", "SUSPENDED").otherwise("RUNNING")
    updates = o.join(seen, "o_custkey", "left_semi").select(F.col("o_orderkey").alias("wfId"), state.alias("status"))
    out = advance_lifecycle(current, updates, 1000000000)
    return out.select(F.col("wfId").alias("o_orderkey"), "status", "workflowMonitorStatus")


@query("followed_files", "SELECT count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders")
def followed(spark, sf_dir):
    """A landing folder followed file by file."""
    landing, out, state = (scratch_path(spark, n) for n in ("landing", "followed", "followed-state"))
    table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("value")).repartition(4).write.text(landing)
    lines = follow_files(spark, landing, "value STRING", "text", 2)
    writer = lines.select(F.col("value").cast("bigint").alias("v")).writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
    start(writer, "available_now").awaitTermination()
    return spark.read.parquet(out).agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
