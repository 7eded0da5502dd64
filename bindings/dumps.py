"""Status dumps and run logs, written out from the driver tables and parsed back."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.operators.ordering import number_groups
from meterline.sources.dumps import (
    parse_access_log,
    parse_bench_log,
    parse_block_devices,
    parse_columns,
    parse_consumer_groups,
    parse_cpuinfo,
    parse_disk_counters,
    parse_exposition,
    parse_gc_table,
    parse_io_table,
    parse_kv,
    parse_process_table,
    parse_proxy_stats,
    parse_stub_status,
    parse_tcp_counters,
    parse_throughput,
    proxy_backends,
    proxy_frontends,
    read_lines,
    read_load_samples,
)
from meterline.session import scratch_path

from .common import SAMPLES, TASKS, query, samples, table, tasks


@query(
    "access_log",
    """
SELECT event_id, '10.0.0.' || CAST(user_id AS VARCHAR) AS "remoteIP", CAST(event_id AS DOUBLE) AS "respBytes", CAST(user_id % 7 AS DOUBLE) AS "respTime",
       CASE WHEN event_type = 'error' THEN 500.0::DOUBLE ELSE 200.0::DOUBLE END AS status, date_trunc('second', ts) AS "reqTime",
       'GET /' || event_type || ' HTTP/1.1' AS "firstLineReq", '/' || event_type AS "urlPath", NULL AS _corrupt FROM events WHERE event_type <> 'view'
UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'broken ' || CAST(event_id AS VARCHAR) FROM events WHERE event_type = 'view'""",
)
def access_log(spark, sf_dir):
    good = F.format_string(
        '10.0.0.%d 10.1.1.1 %d %d host HTTP/1.1 443 %s [%s +0000] "GET /%s HTTP/1.1" "/%s"',
        "user_id", "event_id", F.col("user_id") % 7, F.when(F.col("event_type") == "error", "500").otherwise("200"),
        F.date_format(F.col("ts").cast("timestamp"), "dd/MMM/yyyy:HH:mm:ss"), "event_type", "event_type",
    )
    bad = F.concat(F.lit("broken "), F.col("event_id").cast("string"))
    lines = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") == "view", bad).otherwise(good).alias("value"))
    out = parse_access_log(lines).withColumn("reqTime", F.col("reqTime").cast("timestamp_ntz"))
    return out.select("event_id", "remoteIP", "respBytes", "respTime", "status", "reqTime", "firstLineReq", "urlPath", "_corrupt")


@query(
    "load_samples",
    """
SELECT event_id AS time_stamp, user_id AS "bytesRec", CASE WHEN event_type = 'view' THEN 0 ELSE user_id * 2 END AS "elapsedTime",
       event_type = 'click' AS success, 'GET' AS method, '' AS "queryString",
       CASE WHEN event_type = 'signup' THEN 'http://10.0.0.1:80/opportunity/[id]' ELSE 'http://host/x' END AS api FROM events""",
)
def load_samples(spark, sf_dir):
    """Load-test result files in XML."""
    path = scratch_path(spark, "load-samples")
    ident = F.col("event_id").cast("string")
    url = F.when(F.col("event_type") == "signup", F.concat(F.lit("http://10.0.0.1:80/opportunity/"), ident)).otherwise("http://host/x")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("_by"), F.when(F.col("event_type") != "view", F.col("user_id") * 2).alias("_t"),
        F.col("event_id").alias("_ts"), (F.col("event_type") == "click").cast("string").alias("_s"),
        F.lit("GET").alias("method"), url.alias("java.net.URL"),
    )
    rows.write.format("xml").option("rowTag", "httpSample").option("rootTag", "testResults").save(path)
    out = read_load_samples(spark, path)
    return out.select("time_stamp", "bytesRec", "elapsedTime", "success", "method", "queryString", "api")


@query(
    "exposition_samples",
    """
SELECT user_id AS host, event_type AS document, 'about ' || event_type AS help, CASE WHEN event_type <> 'view' THEN 'gauge' END AS type,
       event_type || '_total' AS metric, CAST(event_id AS VARCHAR) AS id, 'a b' AS label,
       CASE WHEN event_type = 'click' THEN CAST(user_id AS DOUBLE) ELSE value END AS value,
       CASE WHEN event_type = 'click' THEN user_id END AS value_int FROM events""",
)
def exposition(spark, sf_dir):
    """One scrape per user; each event type is a metric with HELP and (but for one) TYPE lines. A HELP
    and a TYPE line before them are cut short, and a label is repeated."""
    ev = table(spark, sf_dir, "events")
    base = F.ascii("event_type").cast("bigint") * 10**12
    heads = ev.select("user_id", "event_type").distinct().select(
        F.col("user_id").alias("host"),
        F.explode(
            F.array(
                F.struct((base - 2).alias("line_no"), F.lit("# HELP").alias("value")),
                F.struct((base - 1).alias("line_no"), F.lit("# TYPE x").alias("value")),
                F.struct(base.alias("line_no"), F.format_string("# HELP %s about %s", "event_type", "event_type").alias("value")),
                F.struct(
                    (base + 1).alias("line_no"),
                    F.when(F.col("event_type") != "view", F.format_string("# TYPE %s gauge", "event_type")).otherwise("").alias("value"),
                ),
            )
        ).alias("l"),
    ).select("host", "l.*")
    number = F.when(F.col("event_type") == "click", F.col("user_id").cast("string")).otherwise(F.col("value").cast("string"))
    body = ev.select(
        F.col("user_id").alias("host"), (base + 2 + F.col("event_id")).alias("line_no"),
        F.format_string('%s_total{id="0",id="%d",label="a b"} %s', "event_type", "event_id", number).alias("value"),
    )
    out = parse_exposition(heads.unionByName(body), ["host"])
    return out.select(
        "host", "document", "help", "type", "metric", F.col("labels")["id"].alias("id"), F.col("labels")["label"].alias("label"), "value", "value_int"
    )


@query(
    "proxy_frontends",
    """
SELECT o_orderkey, 'px' || o_custkey AS pxname, CAST(o_custkey AS DOUBLE) AS rate, CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE o_custkey END AS ereq,
       CAST(o_orderkey AS DOUBLE) / 1024 AS bin, CASE WHEN o_custkey % 10 <> 0 THEN CAST(o_orderkey % 10 AS DOUBLE) / (o_custkey % 10) * 100 END AS sutil
FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 97 <> 0""",
)
def proxy_front(spark, sf_dir):
    return proxy_frontends(_proxy(spark, sf_dir)).select("o_orderkey", "pxname", "rate", "ereq", "bin", "sutil")


@query(
    "proxy_backends",
    """
SELECT o_orderkey, 'px' || o_custkey AS pxname, CASE WHEN o_custkey % 5 = 0 THEN 0 ELSE o_custkey END AS econ, o_orderkey AS rtime
FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 97 <> 0""",
)
def proxy_back(spark, sf_dir):
    return proxy_backends(_proxy(spark, sf_dir)).select("o_orderkey", "pxname", "econ", "rtime")


PROXY_HEADERS = (
    "# pxname,svname,scur,slim,bin,bout,rate,req_rate,ereq,dreq,econ,rtime,",
    "# pxname,svname,slim,scur,rate,bin,bout,req_rate,econ,ereq,dreq,rtime,",
)


def _proxy(spark, sf_dir):
    """One dump per fiftieth of the orders; odd ones name their fields in another order. Some lines
    are an error text instead of fields."""
    cust, order = F.col("o_custkey"), F.col("o_orderkey")
    side = F.when(F.col("o_orderstatus") == "O", "FRONTEND").when(F.col("o_orderstatus") == "F", "BACKEND").otherwise("srv1")
    maybe = F.when(cust % 5 == 0, "").otherwise(cust.cast("string"))
    even = F.format_string(
        "px%d,%s,%d,%d,%d,%d,%d,%d,%s,%d,%s,%d,", cust, side, order % 10, cust % 10, order, order, cust, cust, maybe, cust, maybe, order
    )
    odd = F.format_string(
        "px%d,%s,%d,%d,%d,%d,%d,%d,%s,%s,%d,%d,", cust, side, cust % 10, order % 10, cust, order, order, cust, maybe, maybe, cust, order
    )
    line = F.when(order % 97 == 0, "503 Service Unavailable").when(order % 2 == 0, even).otherwise(odd)
    rows = table(spark, sf_dir, "orders").select((order % 50).alias("dump"), order.alias("line_no"), "o_orderkey", line.alias("value"))
    heads = rows.select("dump").distinct().select(
        "dump", F.lit(-1).cast("bigint").alias("line_no"), F.lit(None).cast("bigint").alias("o_orderkey"),
        F.when(F.col("dump") % 2 == 0, PROXY_HEADERS[0]).otherwise(PROXY_HEADERS[1]).alias("value"),
    )
    return parse_proxy_stats(heads.unionByName(rows), part=["dump"], order="line_no")


@query(
    "key_value_status",
    """SELECT c_custkey, c_name AS version, CAST(c_nationkey AS BIGINT) AS "currConns", c_acctbal AS load, CAST(NULL AS BIGINT) AS missing FROM customer""",
)
def key_values(spark, sf_dir):
    lines = F.array(
        F.concat(F.lit("Version: "), F.col("c_name")), F.concat(F.lit("CurrConns:  "), F.col("c_nationkey").cast("string")),
        F.concat(F.lit("Load : "), F.col("c_acctbal").cast("string")), F.lit("Other: 1:2"),
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.explode(lines).alias("value"))
    keymap = {
        "Version": ("version", "string"), "CurrConns": ("currConns", "bigint"), "Load": ("load", "double"), "Absent": ("missing", "bigint")
    }
    return parse_kv(rows, ["c_custkey"], keymap)


@query(
    "process_table",
    """
SELECT p_partkey AS pid, 'u' || p_size AS user, CAST(p_size AS DOUBLE) * 1024 AS virtual_memory, (p_size + 0.5::DOUBLE) * 1048576 AS resident_memory,
       CAST(p_size AS DOUBLE) AS shared_memory, CAST(p_retailprice AS DOUBLE) AS cpu, 'cmd' || p_partkey AS processname FROM part""",
)
def processes(spark, sf_dir):
    line = F.format_string(
        " %d u%d %dm %d.5g %d %s 1.5 cmd%d", "p_partkey", "p_size", "p_size", "p_size", "p_size", F.col("p_retailprice").cast("string"), "p_partkey"
    )
    rows = table(spark, sf_dir, "part").select(line.alias("value"))
    return parse_process_table(rows.unionByName(rows.limit(1).select(F.lit("PID USER VIRT RES SHR %CPU %MEM COMMAND").alias("value")))).drop("memory")


@query(
    "block_devices",
    """
SELECT s_suppkey AS host, 'sd' || l AS name, 'sda' AS disk, CASE WHEN l = 'a' THEN 'disk' ELSE 'part' END AS type, 2.0::DOUBLE AS capacity, CASE WHEN l = 'a' THEN '' ELSE '/m' END AS mountpoint
FROM supplier, (VALUES ('a'), ('a1')) v(l)
UNION ALL SELECT s_suppkey, 'sdb', 'sdb', 'disk', 2.0::DOUBLE, '' FROM supplier UNION ALL SELECT s_suppkey, 'sdb1', 'sdb', 'part', 2.0::DOUBLE, '/m' FROM supplier""",
)
def devices(spark, sf_dir):
    texts = ["sda disk 2147483648", "sda1 part 2147483648 /m", "sda2 part 2147483648 [SWAP]", "sdb disk 2147483648", "sdb1 part 2147483648 /m"]
    rows = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("host"), F.posexplode(F.array(*[F.lit(t) for t in texts])).alias("line_no", "value")
    )
    return parse_block_devices(rows, ["host"]).select("host", "name", "disk", "type", "capacity", "mountpoint")


@query(
    "disk_counters",
    """
SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'hda' WHEN 'F' THEN 'sda' ELSE 'sda1' END AS name, o_custkey AS read_count,
       CASE WHEN o_orderstatus = 'P' THEN o_custkey + 2 ELSE o_custkey + 4 END AS write_count,
       512 * CASE WHEN o_orderstatus = 'P' THEN o_custkey + 1 ELSE o_custkey + 2 END AS read_bytes,
       512 * CASE WHEN o_orderstatus = 'P' THEN o_custkey + 3 ELSE o_custkey + 6 END AS write_bytes,
       CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_custkey + 3 END AS read_time, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_custkey + 7 END AS write_time
FROM orders""",
)
def disk_lines(spark, sf_dir):
    """Old (15 fields), disk (14) and partition (7) lines."""
    c = F.col("o_custkey")

    def nums(*offsets):
        return [(c + o).cast("string") for o in offsets]

    disk = F.concat_ws(" ", F.lit("8 0 sda"), *nums(0, 1, 2, 3, 4, 5, 6, 7), F.lit("0 0 0"))
    # old form: reads in field 3, then name, merged, sectors, time, writes, ...
    old = F.concat_ws(" ", F.lit("3 0"), *nums(0), F.lit("hda"), *nums(1, 2, 3, 4, 5, 6, 7), F.lit("0 0 0 0"))
    part = F.concat_ws(" ", F.lit("  8 1 sda1"), *nums(0, 1, 2, 3))
    line = F.when(F.col("o_orderstatus") == "O", old).when(F.col("o_orderstatus") == "F", disk).otherwise(part)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", line.alias("value"))
    return parse_disk_counters(rows)


@query("io_table", "SELECT p_partkey, 'sd' || p_size AS name, p_retailprice AS avg_queue_size FROM part")
def io_lines(spark, sf_dir):
    line = F.format_string("sd%d 1 2 3 4 5 6 7 %s 9", "p_size", F.col("p_retailprice").cast("string"))
    both = F.array(F.lit("Device: rrqm/s wrqm/s r/s w/s rkB/s wkB/s avgrq-sz avgqu-sz await"), line)
    return parse_io_table(table(spark, sf_dir, "part").select("p_partkey", F.explode(both).alias("value")))


@query("tcp_counters", "SELECT p_partkey, CAST(p_size AS BIGINT) AS resets_received, p_partkey + 1 AS retransmits, p_partkey + 2 AS resets_sent FROM part")
def tcp_lines(spark, sf_dir):
    key = F.col("p_partkey")
    line = F.format_string("Tcp: 1 200 120000 -1 5 6 7 %d 9 10 11 %d 13 %d", "p_size", key + 1, key + 2)
    both = F.array(F.lit("Tcp: RtoAlgorithm RtoMin RtoMax MaxConn ActiveOpens PassiveOpens AttemptFails EstabResets"), line)
    return parse_tcp_counters(table(spark, sf_dir, "part").select("p_partkey", F.explode(both).alias("value")))


@query(
    "stub_status",
    """
SELECT o_orderkey, o_custkey AS "activeConnections", o_orderkey AS accepts, o_orderkey + 1 AS handled, o_orderkey + 2 AS requests,
       o_custkey % 3 AS "activeReading", o_custkey % 5 AS "activeWriting", o_custkey % 7 AS "activeWaiting" FROM orders""",
)
def stub(spark, sf_dir):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    lines = F.array(
        F.format_string("Active connections: %d ", c), F.lit("server accepts handled requests"),
        F.format_string(" %d %d %d ", o, o + 1, o + 2), F.format_string("Reading: %d Writing: %d Waiting: %d ", c % 3, c % 5, c % 7),
    )
    return parse_stub_status(table(spark, sf_dir, "orders").select("o_orderkey", F.explode(lines).alias("value")), ["o_orderkey"])


@query(
    "consumer_groups",
    """
SELECT o_orderkey, 'topic' || o_custkey AS topic, CAST(o_custkey % 9 AS INTEGER) AS partition, o_orderkey AS "currentOffset", o_orderkey + 5 AS "logEndOffset", CAST(5 AS BIGINT) AS lag,
       'c-' || o_custkey AS "consumerId", 'client' AS "clientId" FROM orders WHERE o_orderstatus <> 'P'""",
)
def consumers(spark, sf_dir):
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    line = F.format_string("topic%d  %d  %d %d 5 c-%d %s", c, c % 9, o, o + 5, c, F.when(F.col("o_orderstatus") == "P", "-").otherwise("client"))
    lines = F.array(F.lit("TOPIC PARTITION CURRENT-OFFSET LOG-END-OFFSET LAG CONSUMER-ID CLIENT-ID"), F.lit(""), line)
    return parse_consumer_groups(table(spark, sf_dir, "orders").select("o_orderkey", F.explode(lines).alias("value")))


@query(
    "gc_table",
    """
SELECT p_partkey, CAST(p_size * 4 + 3 AS DOUBLE) AS "heapUsage", CAST(p_size AS DOUBLE) AS ygc, 0.5::DOUBLE AS ygct, CAST(2 AS BIGINT) AS fgc, 0.25::DOUBLE AS fgct, CAST(p_size AS DOUBLE) + 0.75 AS gct FROM part""",
)
def gc_lines(spark, sf_dir):
    s = F.col("p_size")
    line = F.format_string("0 0 %d %d 0 %d 0 %d 0 9 0 - %d 0.5 2 0.25 %d.75", s, s + 1, s + 1, s + 1, s, s)
    both = F.array(F.lit(" S0C S1C S0U S1U EC EU OC OU MC MU CCSC CCSU YGC YGCT FGC FGCT GCT"), line)
    return parse_gc_table(table(spark, sf_dir, "part").select("p_partkey", F.explode(both).alias("value")))


@query("cpu_listing", "SELECT p_partkey, 'model name' AS key, p_name || ' : x' AS value FROM part UNION ALL SELECT p_partkey, 'core id', CAST(p_size AS VARCHAR) FROM part")
def cpu_lines(spark, sf_dir):
    lines = F.array(
        F.concat(F.lit("model name\t: "), F.col("p_name"), F.lit(" : x")), F.concat(F.lit("core id\t\t: "), F.col("p_size").cast("string")), F.lit("")
    )
    return parse_cpuinfo(table(spark, sf_dir, "part").select("p_partkey", F.explode(lines).alias("value")))


@query(
    "positional_columns",
    "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity AS q, l_returnflag AS f FROM lineitem",
)
def positional(spark, sf_dir):
    """Line items as fixed-order text files, written and read back line by line."""
    path = scratch_path(spark, "positional")
    line = F.concat_ws(
        "   ", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag")]
    )
    table(spark, sf_dir, "lineitem").select(line.alias("value")).write.text(path)
    spec = {"l_orderkey": (0, "bigint"), "l_partkey": (1, "bigint"), "l_linenumber": (2, "int"), "q": (3, "double"), "f": (4, "string")}
    return parse_columns(read_lines(spark, path), spec).select(*spec)


TXN = "CASE l_returnflag WHEN 'A' THEN 'Trade-Order' WHEN 'N' THEN 'Trade-Result' ELSE 'Broker-Volume' END"


@query(
    "bench_log_counts",
    f"""
WITH g AS (SELECT l_suppkey AS runId, {TXN} AS t, l_linenumber % 4 + 1 AS g, count(*) FILTER (WHERE l_linestatus = 'O') AS o, count(*) FILTER (WHERE l_linestatus = 'F') AS f
           FROM lineitem GROUP BY 1, 2, 3)
SELECT runId AS "runId", t AS "transactionName", CAST(g AS INTEGER) AS "group", CAST(1 AS INTEGER) AS phase, o AS "transactionCount", 'G' || g || 'P1' AS "uniqueId" FROM g
UNION ALL SELECT runId, t, CAST(g AS INTEGER), 2, f, 'G' || g || 'P2' FROM g""",
)
def bench_log(spark, sf_dir):
    """A run log per supplier: section header, transaction headers, group lines, end marker, noise after it."""
    flag = F.col("l_returnflag")
    txn = F.when(flag == "A", "Trade-Order").when(flag == "N", "Trade-Result").otherwise("Broker-Volume")
    counts = table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("runId"), txn.alias("t"), (F.col("l_linenumber") % 4 + 1).alias("g")
    ).agg(F.count_if(F.col("l_linestatus") == "O").alias("o"), F.count_if(F.col("l_linestatus") == "F").alias("f"))
    base = (F.ascii("t") * 100 + F.length("t")).cast("bigint") * 10
    body = counts.select("runId", (base + F.col("g")).alias("line_no"), F.format_string("Group %d: [%d][%d]", "g", "o", "f").alias("value"))
    heads = counts.select("runId", base.alias("line_no"), F.col("t").alias("value")).distinct()
    frame = F.array(
        F.struct(F.lit(-2).alias("n"), F.lit("Trade-Order").alias("v")), F.struct(F.lit(-1).alias("n"), F.lit("Group 1: [7][7]").alias("v")),
        F.struct(F.lit(0).alias("n"), F.lit("Measurement Interval Data").alias("v")),
        F.struct(F.lit(900000).alias("n"), F.lit("=====================").alias("v")), F.struct(F.lit(900001).alias("n"), F.lit("Group 1: [999]").alias("v")),
    )
    edges = counts.select("runId").distinct().select("runId", F.explode(frame).alias("x"))
    edges = edges.select("runId", F.col("x.n").cast("bigint").alias("line_no"), F.col("x.v").alias("value"))
    return parse_bench_log(body.unionByName(heads).unionByName(edges))


@query(
    "throughput_numbering",
    f"""
WITH {TASKS},
p AS (SELECT *, row_number() OVER (PARTITION BY jobId ORDER BY hdfsBytesRead, orderId, line) - 1 AS n FROM tasks)
SELECT jobId AS "runId", 'passed' AS status, CAST(hdfsBytesRead AS DOUBLE) + 0.5 AS actual, CAST(orderId AS DOUBLE) AS min, CAST(line AS DOUBLE) AS max,
       CAST(line + 1 AS VARCHAR) AS tile, CAST(n % 4 + 1 AS VARCHAR) AS "group", CAST(n // 8 + 1 AS VARCHAR) AS phase,
       'T' || (line + 1) || 'G' || (n % 4 + 1) || 'P' || (n // 8 + 1) AS "uniqueId" FROM p
UNION ALL SELECT s_suppkey, 'passed', 1.5::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE, 'combined', 'combined', 'combined', CAST(s_suppkey AS VARCHAR) || '_Over All' FROM supplier""",
)
def throughput(spark, sf_dir):
    """Throughput lines of a run per supplier in two tiles, thousands separated by commas."""
    text = F.format_string(
        "passed: x[%d] = %s, min = %d, max = %d", F.col("line"),
        F.format_number(F.col("hdfsBytesRead").cast("double") + 0.5, 1), F.col("orderId"), F.col("line"),
    )
    lines = tasks(spark, sf_dir).select(
        F.col("jobId").alias("runId"), F.col("hdfsBytesRead").alias("line_no"), "orderId", "line", text.alias("value")
    )
    frame = F.array(
        F.struct(F.lit(-1).cast("bigint").alias("n"), F.lit("Measured Throughput Data").alias("v")),
        F.struct(F.lit(10**15).alias("n"), F.lit("passed: combined = 1.5, min = 1, max = 2").alias("v")),
    )
    ends = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("runId"), F.explode(frame).alias("x")).select(
        "runId", F.col("x.n").alias("line_no"), F.lit(0).cast("bigint").alias("orderId"), F.lit(0).alias("line"), F.col("x.v").alias("value")
    )
    return parse_throughput(lines.unionByName(ends), tiles=2, tiebreak=["orderId", "line"])


@query(
    "positional_groups",
    f"""
WITH {SAMPLES}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM samples)
SELECT event_id, CAST(n % 4 + 1 AS INTEGER) AS "group", CAST(n // 12 + 1 AS INTEGER) AS phase FROM p""",
)
def positional_groups(spark, sf_dir):
    out = number_groups(samples(spark, sf_dir), "ts", 4, 3, ["user_id"], ["event_id"])
    return out.select("event_id", "group", "phase")
