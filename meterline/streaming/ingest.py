"""Streaming ingest of log events, windowed counts and followed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.projections import add_date_parts
from ..sources.logs import decode_logs

DEFAULT_TRIGGER = "30 minutes"


def start(writer, trigger: str) -> StreamingQuery:
    """Start with a processing-time trigger, or drain what is there (``available_now``)."""
    if trigger == "available_now":
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=trigger).start()


def write_log_stream(
    df: DataFrame, out: str, checkpoint: str, trigger: str = DEFAULT_TRIGGER
) -> StreamingQuery:
    """Append decoded events to ORC, partitioned by event date. No watermark: late rows land in their date."""
    writer = (
        df.writeStream.format("orc")
        .outputMode("append")
        .partitionBy("year", "month", "day")
        .option("checkpointLocation", checkpoint)
        .option("path", out)
    )
    return start(writer, trigger)


def ingest_pipeline(
    stream: DataFrame, out: str, checkpoint: str, trigger: str = DEFAULT_TRIGGER, value: str = "value"
) -> StreamingQuery:
    """Message stream to partitioned ORC."""
    return write_log_stream(add_date_parts(decode_logs(stream, value), "data.time"), out, checkpoint, trigger)


def stream_count_windows(
    stream: DataFrame, time: str, window: str = "5 minutes", delay: str = "10 minutes"
) -> DataFrame:
    """Streaming counts per tumbling window; the watermark bounds the state."""
    timed = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    counted = timed.groupBy(F.window(time, window).alias("w")).agg(F.count(F.lit(1)).alias("count"))
    out = counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count")
    return out.withColumn("timestamp", F.unix_timestamp("start"))


def follow_files(
    spark: SparkSession, path: str, schema: str, fmt: str = "text", per_trigger: int | None = None, **options
) -> DataFrame:
    """Stream of the files that appear in a landing folder, each read once and whole."""
    reader = spark.readStream.format(fmt).schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.options(**options).load(path)


def complete_files(lines: DataFrame, marker: str = "</testResults>") -> DataFrame:
    """Files (``path``) whose text has reached its end marker, for jobs that must not read half a result."""
    return lines.groupBy("path").agg(F.max(F.col("value").contains(marker)).alias("complete")).filter("complete")
