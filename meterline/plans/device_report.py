"""Device statistics of a fleet: snapshots to rates, latencies and one aggregate row per host."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mean_latency
from ..operators.aggregates import with_aggregate_row
from ..operators.counters import counter_delta
from ..operators.joins import enrich

DISK_COUNTERS = ["read_bytes", "write_bytes", "read_count", "write_count", "read_time", "write_time"]
NIC_COUNTERS = ["rx_bytes", "tx_bytes", "rx_packets", "tx_packets", "rx_errors", "tx_errors"]


def disk_report(
    devices: DataFrame, counters: DataFrame, keys: Sequence[str] = ("host", "time")
) -> DataFrame:
    """Per disk and poll: IOPS, MB/s and latency, plus an ``aggregate`` row over whole disks.

    ``devices`` (host, name, type, ...) is joined with ``counters`` (host, time, name and the
    disk counters); partitions keep their rows but stay out of the aggregate.
    """
    host, time = keys
    known = enrich(counters, devices, [host, "name"])
    rows = with_aggregate_row(known, list(keys), "name", DISK_COUNTERS, F.col("type") == "disk")
    moved = counter_delta(rows, [host, "name"], time, DISK_COUNTERS, keep_elapsed=True)
    seconds = F.when(F.col("elapsed_s") > 0, F.col("elapsed_s"))

    def d(c: str):
        return F.col(f"{c}_delta")

    return moved.withColumns(
        {
            "readIOPS": F.round(d("read_count") / seconds, 2),
            "writeIOPS": F.round(d("write_count") / seconds, 2),
            "readThroughput": F.round(d("read_bytes") / seconds / 1048576.0, 2),
            "writeThroughput": F.round(d("write_bytes") / seconds / 1048576.0, 2),
            "readLatency": mean_latency(d("read_time"), d("read_count"), 2),
            "writeLatency": mean_latency(d("write_time"), d("write_count"), 2),
        }
    )


def nic_report(
    nics: DataFrame, counters: DataFrame, keys: Sequence[str] = ("host", "time")
) -> DataFrame:
    """Per interface and poll: Mbit/s and error deltas, plus an ``aggregate`` row over physical ones."""
    host, time = keys
    known = enrich(counters, nics, [host, "name"])
    rows = with_aggregate_row(known, list(keys), "name", NIC_COUNTERS, F.col("type") == "physical")
    moved = counter_delta(rows, [host, "name"], time, NIC_COUNTERS, keep_elapsed=True)
    seconds = F.when(F.col("elapsed_s") > 0, F.col("elapsed_s"))
    return moved.withColumns(
        {
            "rxMbps": F.round(F.col("rx_bytes_delta") / seconds / 125000.0, 2),
            "txMbps": F.round(F.col("tx_bytes_delta") / seconds / 125000.0, 2),
        }
    )
