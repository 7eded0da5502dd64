"""Log events: stream, payload decoding, and the two ORC layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import LOG_EVENT


def read_log_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Message stream with a binary ``value`` column; lost offsets do not stop it."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("failOnDataLoss", "false")
        .load()
    )


def decode_logs(df: DataFrame, value: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    """JSON payload to the struct ``data``; a payload that is no JSON keeps its row with NULL fields."""
    return df.select(*keep, F.from_json(F.col(value).cast("string"), LOG_EVENT).alias("data"))


def read_logs(spark: SparkSession, base: str, year, month, days) -> DataFrame:
    """Compacted layout ``base/Y/M/D``; each part may be a glob such as ``{26,27}`` or ``*``."""
    return spark.read.orc(f"{base.rstrip('/')}/{year}/{month}/{days}/")


def read_partitioned(spark: SparkSession, base: str) -> DataFrame:
    """Layout ``year=/month=/day=`` as the ingest stream writes it."""
    return spark.read.orc(base)
