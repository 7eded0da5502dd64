"""Delta and rate rules of the monitored services, and one plan that applies them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mean_latency
from ..operators.counters import counter_delta
from ..operators.slices import ROWS_PER_SLICE


@dataclass(frozen=True)
class Rule:
    """Which fields of a document type are counters, and how their deltas behave."""

    counters: tuple[str, ...]
    reset: str = "raw"
    first: str = "zero"
    gate: str | None = None
    max_gap_intervals: int | None = None
    rates: dict[str, str] = field(default_factory=dict)  # delta field -> per-second field
    latencies: dict[str, tuple[str, str]] = field(default_factory=dict)  # field -> (time, count)
    drop: tuple[str, ...] = ()


# Counters and rules by service document type.
RULES = {
    "apache": Rule(("accessCount", "accessSize"), first="null"),
    "nginx": Rule(("accepts", "handled", "requests"), reset="current", rates={"requests": "requestsPerSecond"}),
    "haproxy_frontend": Rule(("ereq", "dreq", "hrsp_4xx", "hrsp_5xx", "bin", "bout")),
    "haproxy_backend": Rule(("econ", "dresp", "eresp", "wredis", "wretr", "hrsp_4xx", "hrsp_5xx")),
    "haproxy_process": Rule(("sslCacheMisses", "sslCacheLookups")),
    "kafka_broker": Rule(
        ("messagesInPerSec", "bytesInPerSec", "bytesOutPerSec"),
        reset="zero",
        rates={"messagesInPerSec": "messagesIn", "bytesInPerSec": "bytesIn", "bytesOutPerSec": "bytesOut"},
    ),
    "zookeeper": Rule(
        ("packetsReceived", "packetsSent"),
        reset="zero",
        rates={"packetsReceived": "packetsReceivedRate", "packetsSent": "packetsSentRate"},
    ),
    "redis": Rule(
        (
            "syncFull", "syncPartialOk", "syncPartialErr", "rejectedConn", "expiredKeys", "evictedKeys",
            "totalConnReceived", "totalCommandsProcessed", "totalNetInputBytes", "totalNetOutputBytes",
            "keyspaceHits", "keyspaceMisses",
        ),
        rates={"totalNetInputBytes": "readThroughput", "totalNetOutputBytes": "writeThroughput"},
    ),
    "tomcat_context": Rule(("hitCount", "lookupCount")),
    "tomcat_requests": Rule(("bReceived", "bSent", "requestCount", "errorCount", "processingTime")),
    "jvm_gc": Rule(("ygc", "ygct", "fgc", "fgct", "gct"), gate="gct"),
    "mysql_server": Rule(
        (
            "bytesReceived", "bytesSent", "numConnections", "numAbortedConnects", "threadsCreated",
            "numCreatedTempFiles", "numCreatedTempTables", "numQueries", "numSelect", "numInsert", "numUpdate",
            "numDelete", "slowQueries", "qcacheHits", "qcacheInserts",
        ),
        rates={"bytesReceived": "bytesReceivedPerSecond", "bytesSent": "bytesSentPerSecond"},
    ),
    "postgres_database": Rule(
        (
            "numTransactions", "blocksRead", "blocksHit", "numReturn", "numInsert", "numDelete", "numFetch",
            "numUpdate", "numTempFile", "tempFileSize", "blkReadTime", "blkWriteTime",
        ),
        first="drop",
        rates={"numTransactions": "transPerSec"},
    ),
    "mongod_server": Rule(
        (
            "bytesReceived", "bytesSent", "numdelete", "numqueries", "numinsert", "numselect", "numupdate",
            "numAbortedclients", "msgasserts", "warningasserts", "regularasserts", "userasserts",
        ),
    ),
    "cassandra": Rule(
        (
            "cacheHitCount", "cacheRequestCount", "compactionCompletedTasks", "exceptions", "readTimeouts",
            "writeTimeouts", "readUnavailables", "writeUnavailables", "totalReadLatency", "totalWriteLatency",
            "readCount", "writeCount",
        ),
        latencies={
            "readLatency": ("totalReadLatency", "readCount"),
            "writeLatency": ("totalWriteLatency", "writeCount"),
        },
        drop=("totalReadLatency", "totalWriteLatency", "readCount", "writeCount"),
    ),
    "search_index": Rule(
        (
            "docsDeleted", "queryCacheHits", "queryCacheMisses", "requestCacheHits", "requestCacheMisses",
            "searchQueryCount", "searchQueryTime", "searchFetchCount", "searchFetchTime",
        ),
        reset="zero",
        latencies={
            "searchQueryLatency": ("searchQueryTime", "searchQueryCount"),
            "searchFetchLatency": ("searchFetchTime", "searchFetchCount"),
        },
    ),
    "yarn_jvm": Rule(
        ("GcCount", "GcTimeMillis", "LogFatal", "LogError", "LogWarn", "LogInfo"), max_gap_intervals=3
    ),
}


def service_report(
    df: DataFrame,
    service: str,
    keys: Sequence[str],
    time: str = "time",
    interval_s: int = 10,
    tiebreak: Sequence[str] = (),
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Replace the counters of a service's documents by their deltas and add rates and latencies.

    Counters the table lacks are skipped.
    """
    rule = RULES[service]
    cols = [c for c in rule.counters if c in df.columns]
    out = counter_delta(
        df, keys, time, cols,
        reset=rule.reset, first=rule.first, gate=rule.gate if rule.gate in df.columns else None,
        max_gap_s=rule.max_gap_intervals * interval_s if rule.max_gap_intervals else None,
        tiebreak=tiebreak, suffix="", rows_per_slice=rows_per_slice,
    )
    extra = {n: F.round(F.col(c) / F.lit(interval_s), 2) for c, n in rule.rates.items() if c in cols}
    extra |= {
        n: F.greatest(mean_latency(t, c, 2), F.lit(0.0)) for n, (t, c) in rule.latencies.items() if t in cols and c in cols
    }
    return out.withColumns(extra).drop(*rule.drop) if extra else out.drop(*rule.drop)


def api_report(
    df: DataFrame,
    keys: Sequence[str] = ("host", "path", "method"),
    time: str = "time",
    cols: Sequence[str] = (
        "requests", "responses", "redirect", "total_time", "success", "errors", "total_req_clength", "total_res_clength",
    ),
    rows_per_slice: int = ROWS_PER_SLICE,
    tiebreak: Sequence[str] = (),
    poll: Sequence[str] | None = None,
) -> DataFrame:
    """API call statistics: nothing for a server's first poll, the totals of a path that is new in a
    later one, deltas else; idle paths are left out, and a poll in which any counter fell (the server
    restarted) is dropped as a whole. ``keys`` begin with the server. Counters the table lacks are
    skipped. ``poll`` names the columns that identify a poll, by default the server and the time;
    where paths are polled one by one and times may coincide, it must name more.
    """
    cols = [c for c in cols if c in df.columns]
    server = keys[0]
    begin = df.groupBy(F.col(server).alias("_server")).agg(F.min(time).alias("_begin"))
    out = counter_delta(
        df, keys, time, cols, reset="drop_batch", first="passthrough", poll=poll or [server, time], tiebreak=tiebreak,
        suffix="", rows_per_slice=rows_per_slice,
    )
    later = out.join(begin, F.col(server).eqNullSafe(F.col("_server"))).filter(F.col(time) > F.col("_begin"))
    return later.filter(F.col(cols[0]) != 0).drop("_server", "_begin")
