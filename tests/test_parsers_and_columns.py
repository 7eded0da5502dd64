"""Dump parsers and column helpers on the shapes and edge rows they must accept."""

import pytest
from pyspark.sql import functions as F

from meterline import functions as fn
from meterline.operators.aggregates import (
    cpu_topology,
    map_speed,
    mean_of_ratios,
    ratio_of_sums,
    rollup_sizes,
    with_aggregate_row,
)
from meterline.operators.joins import drop_stale, enrich, membership_change, membership_changed
from meterline.operators.ordering import long_running, number_groups, top_processes
from meterline.operators.projections import (
    fill_defaults,
    flatten_struct,
    name_values_to_columns,
    or_placeholder,
    prefixed_name,
    rows_to_columns,
)
from meterline.plans.device_report import disk_report, nic_report
from meterline.sources import dumps

from helpers import at, plan, rows


def lines(spark, text, **ids):
    data = [(*ids.values(), i, v) for i, v in enumerate(text.strip("\n").split("\n"))]
    cols = ", ".join(f"{k} string" for k in ids)
    return spark.createDataFrame(data, f"{cols + ', ' if cols else ''}line_no bigint, value string")


def one(df, col):
    return df.select(col.alias("x")).collect()[0].x


def test_access_log(spark):
    good = '10.0.0.1 10.0.0.2 512 3 host HTTP/1.1 80 200 [10/Aug/2018:16:10:23 +0200] "GET /a \\"b\\" HTTP/1.1" "/a b"'
    out = dumps.parse_access_log(lines(spark, good + "\nnonsense")).orderBy("line_no").collect()
    assert out[0].respBytes == 512.0 and out[0].status == 200.0 and out[0].urlPath == "/a b" and out[0]._corrupt is None
    assert out[0].reqTime.strftime("%H:%M:%S") == "14:10:23" and out[0].firstLineReq.startswith("GET /a")
    assert out[1]._corrupt == "nonsense" and out[1].status is None
    dash = good.replace(" 512 ", " - ")
    assert dumps.parse_access_log(lines(spark, dash)).collect()[0].respBytes is None


def test_exposition(spark):
    text = """
# HELP cpu CPU use by mode
# TYPE cpu counter
cpu{mode="idle",path="/a,b"} 1.5e+03
cpu{mode="user"} 7
# HELP up Is it up
up 1
bare_metric 2.5
"""
    for size in (1_000_000, 2):
        out = dumps.parse_exposition(lines(spark, text, path="p"), rows_per_slice=size).orderBy("line_no").collect()
        assert [(r.document, r.type, r.metric, r.value, r.value_int) for r in out] == [
            ("cpu", "counter", "cpu", 1500.0, None), ("cpu", "counter", "cpu", 7.0, 7), ("up", None, "up", 1.0, 1), ("up", None, "bare_metric", 2.5, None),
        ]
        assert out[0].labels == {"mode": "idle", "path": "/a,b"} and out[0].help == "CPU use by mode" and out[2].labels == {}


def test_proxy(spark):
    text = "# pxname,svname,scur,slim,bin,bout,rate,req_rate,\nweb,FRONTEND,5,10,2048,,7,8,\nweb,BACKEND,1,,,,,,\nweb,srv,1,,,,,,"
    stats = dumps.parse_proxy_stats(lines(spark, text), text.split("\n")[0])
    front = dumps.proxy_frontends(stats).collect()
    assert len(front) == 1 and (front[0].sutil, front[0].bin, front[0].bout, front[0].reqRate) == (50.0, 2.0, 0.0, 8.0)
    assert len(dumps.proxy_backends(stats).collect()) == 1
    zero = dumps.parse_proxy_stats(lines(spark, text.split("\n")[0] + "\nweb,FRONTEND,5,,1,1,1,1,"), text.split("\n")[0])
    assert dumps.proxy_frontends(zero).collect()[0].sutil is None


def test_disk_lines_and_devices(spark):
    text = "3 0 11 hda 1 2 3 14 5 6 7 8 9 10 11\n8 0 sda 21 2 23 24 25 6 27 28 9 10 11\n8 1 sda1 31 32 33 34\nshort line"
    got = rows(dumps.parse_disk_counters(lines(spark, text)), "name", "read_count", "write_count", "read_bytes", "write_bytes", "read_time", "write_time")
    assert got == [("hda", 11, 14, 2 * 512, 6 * 512, 3, 7), ("sda", 21, 25, 23 * 512, 27 * 512, 24, 28), ("sda1", 31, 33, 32 * 512, 34 * 512, 0, 0)]
    text = "sda disk 1073741824\nsda1 part 536870912 /\nsda2 part 536870912 [SWAP]\nsdb disk 1073741824\nsdb1 part 1073741824 /b"
    got = rows(dumps.parse_block_devices(lines(spark, text, host="h"), ["host"], rows_per_slice=2), "name", "disk", "capacity", "mountpoint")
    assert got == [("sda", "sda", 1.0, ""), ("sda1", "sda", 0.5, "/"), ("sdb", "sdb", 1.0, ""), ("sdb1", "sdb", 1.0, "/b")]


def test_small_dumps(spark):
    text = "Active connections: 3 \nserver accepts handled requests\n 10 11 12 \nReading: 1 Writing: 2 Waiting: 4 "
    assert rows(dumps.parse_stub_status(lines(spark, text, host="h"), ["host"])) == [("h", 3, 10, 11, 12, 1, 2, 4)]
    text = "TOPIC PARTITION ...\n\nt 0 5 9 4 c1 client\nt 1 5 9 4 - -"
    assert rows(dumps.parse_consumer_groups(lines(spark, text)), "topic", "partition", "lag") == [("t", 0, 4)]
    text = "Tcp: RtoAlgorithm a b\nTcp: 1 2 3 -1 5 6 7 8 9 10 11 12 13 14\nUdp: 1"
    assert rows(dumps.parse_tcp_counters(lines(spark, text)), "resets_received", "retransmits", "resets_sent") == [(8, 12, 14)]
    text = "  PID USER ...\n 12 root 1.2g 512 3m 9.5 0.1 java\n"
    got = dumps.parse_process_table(lines(spark, text)).collect()
    assert [(r.pid, round(r.virtual_memory, 1), r.resident_memory, r.shared_memory, r.processname) for r in got] == [(12, 1258291.2, 512.0, 3072.0, "java")]
    text = "S0C S1C S0U\n 1 2 0.5 0.25 5 1 7 2 9 10 - 0.25 3 0.1 4 0.2 0.3"
    got = dumps.parse_gc_table(lines(spark, text)).collect()[0]
    assert (got.heapUsage, got.ygc, got.fgc, got.gct) == (4.0, 3.0, 4, 0.3)
    text = "Version: 1.8\nUptime: 0d 0h: x\njunk\nCurrConns: 7 "
    keys = {"Version": ("version", "string"), "CurrConns": ("conns", "bigint"), "Uptime": ("up", "string")}
    assert rows(dumps.parse_kv(lines(spark, text, host="h"), ["host"], keys)) == [("h", "1.8", 7, "0d 0h: x")]


BENCH = """
Trade-Order
Group 1: [9][9]
Measurement Interval Data
Trade-Order
Group 1: [1][2]
Group 2: [3][4]
Trade-Result
Group 4: [5][ 6 ]
==================
Group 1: [7][7]
"""


def test_bench_log(spark):
    for size in (1_000_000, 3):
        out = dumps.parse_bench_log(lines(spark, BENCH, runId="r"), rows_per_slice=size)
        assert rows(out, "transactionName", "group", "phase", "transactionCount", "uniqueId") == [
            ("Trade-Order", 1, 1, 1, "G1P1"), ("Trade-Order", 1, 2, 2, "G1P2"), ("Trade-Order", 2, 1, 3, "G2P1"), ("Trade-Order", 2, 2, 4, "G2P2"),
            ("Trade-Result", 4, 1, 5, "G4P1"), ("Trade-Result", 4, 2, 6, "G4P2"),
        ]


def test_throughput(spark):
    body = "\n".join(f"passed: x[{i % 2}] = 1,23{i % 10}.5, min = 1,000, max = 2,000.25" for i in range(10))
    text = f"Measured Throughput Data\n{body}\npassed: combined = 9,000, min = 1, max = 2\n=================\nother: x[1] = 1, min = 1, max = 1"
    for size in (1_000_000, 4):
        out = dumps.parse_throughput(lines(spark, text, runId="7"), tiles=2, rows_per_slice=size).collect()
        assert len(out) == 11
        whole = [r for r in out if r.tile == "combined"]
        assert [(r.actual, r.uniqueId) for r in whole] == [(9000.0, "7_Over All")]
        first = [r for r in out if r.actual == 1230.5][0]
        assert (first.group, first.phase, first.tile, first.min, first.max, first.uniqueId) == ("1", "1", "1", 1000.0, 2000.25, "T1G1P1")
        last = [r for r in out if r.actual == 1239.5][0]
        assert (last.group, last.phase, last.tile) == ("2", "2", "2")


def test_lines_keep_their_order_across_splits(spark, tmp_path):
    path = tmp_path / "host=h1"
    path.mkdir()
    (path / "big.txt").write_text("\n".join(f"line {i} " + "x" * (i % 40) for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = dumps.read_lines(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() > 3
        numbers = [int(r.value.split()[1]) for r in got.orderBy("path", "line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert numbers == list(range(5000)) and "host" in got.columns


def test_load_samples(spark, tmp_path):
    (tmp_path / "r.xml").write_text(
        '<testResults><httpSample t="12" lt="3" ec="0" s="true" ts="1" tn="t"><method>GET</method><java.net.URL>http://1.2.3.4:80/opportunity/55</java.net.URL></httpSample>'
        '<httpSample s="false"><java.net.URL>http://host/opportunity/55</java.net.URL></httpSample></testResults>'
    )
    got = rows(dumps.read_load_samples(spark, str(tmp_path)), "elapsedTime", "bytesRec", "success", "method", "api")
    assert got == [(0, 0, False, "", "http://host/opportunity/55"), (12, 0, True, "GET", "http://1.2.3.4:80/opportunity/[id]")]


def test_column_helpers(spark):
    df = spark.range(1)
    lit = F.lit
    assert one(df, fn.elapsed_to_seconds(lit("05:10"))) == 310 and one(df, fn.elapsed_to_seconds(lit("01:05:10"))) == 3910
    assert one(df, fn.elapsed_to_minutes(lit("2-01:05:10"))) == pytest.approx(2880 + 65 + 0.1667)
    assert one(df, fn.elapsed_to_minutes(lit("05:30"))) == 5.5
    assert [one(df, fn.size_to_kb(lit(x))) for x in ("7", "2k", "1m", "1.5g", "1t", "3x")] == [7.0, 2.0, 1024.0, 1572864.0, 1073741824.0, None]
    assert [one(df, fn.band(lit(x))) for x in (0.0, 10.0, 10.1, 40.0, 100.0, 101.0, -1.0)] == ["low", "low", "med", "med", "high", None, None]
    assert one(df, fn.camel_case(lit("HDFS_BYTES_READ"))) == "hdfsBytesRead" and fn.dotted_to_underscored("tag.Host") == "_tag_host"
    assert one(df, fn.memory_pool_name(lit("G1 Old Gen"))) == "OldGen" and one(df, fn.memory_pool_name(lit("My Pool"))) == "MyPool"
    assert one(df, fn.pct(lit(1), lit(0))) is None and one(df, fn.pct(lit(1), lit(3))) == 33.33
    assert one(df, fn.to_unit(lit(1572864), "MB")) == 1.5 and one(df, fn.guard_negative(lit(-1))) is None
    assert one(df, fn.decode(lit(9), {1: "a"}, "NotAvailable")) == "NotAvailable"
    assert one(df, fn.string_to_array(lit('["a"]'))) == ["a"] and one(df, fn.string_to_array(lit("plain"))) is None
    # one clock time twice in autumn: the letter tells them apart
    edt, est = (one(df, fn.zoned_text_to_epoch(lit(f"Sun, 04 Nov 2018 01:30:00 {z}"))) for z in ("EDT", "EST"))
    assert est - edt == 3600 and edt == 1541309400
    assert one(df, fn.zoned_text_to_epoch(lit("junk"))) is None
    assert one(df, fn.iso_gmt_to_epoch(lit("2018-08-10T16:10:23.123GMT"))) == 1533917423
    assert one(df, fn.now_iso_gmt()).endswith("GMT")
    assert one(df, fn.within_lookback(lit(10), lit(20), 10)) and not one(df, fn.within_lookback(lit(9), lit(20), 10))
    assert one(df, fn.ratio(lit(1), lit(0))) == 0.0


def test_projections(spark):
    df = spark.createDataFrame([(1, " ", None), (2, "x", 5)], "id int, s string, n int")
    assert rows(fill_defaults(df, {"s": "-", "n": 0, "gone": 1})) == [(1, "-", 0, 1), (2, "x", 5, 1)]
    df = spark.createDataFrame([(1, {"stdout": "u"})], "id int, executorLogs map<string,string>")
    assert flatten_struct(df, "executorLogs", prefixed_name, ["stdout"]).collect()[0].executorLogsStdout == "u"
    df = spark.createDataFrame([(1, [("internal.metrics.a.b", "1"), ("internal.metrics.a.b", "2"), ("plain", "9")])], "id int, u array<struct<name:string,value:string>>")
    assert rows(name_values_to_columns(df, "u", {"aB": "bigint", "zz": "double"})) == [(1, 2, None)]
    df = spark.createDataFrame([("s", "a", "1"), ("s", "B", "2")], "id string, k string, v string")
    assert rows(rows_to_columns(df, ["id"], "k", "v", ["a", "b", "c"])) == [("s", "1", "2", None)]
    empty = spark.createDataFrame([], "a int")
    assert or_placeholder(empty).count() == 1 and or_placeholder(empty, spark.range(1)).count() == 0
    assert or_placeholder(spark.range(2)).count() == 2


def test_joins_and_sets(spark):
    left = spark.createDataFrame([(1, "old"), (2, "old")], "k int, v string")
    right = spark.createDataFrame([(1, "new", 5)], "k int, v string, w int")
    assert rows(enrich(left, right, ["k"]), "k", "v", "w") == [(1, "new", 5), (2, "old", None)]
    a, b = spark.createDataFrame([(1,), (2,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert rows(membership_change(a, b, ["k"])) == [(1, "added"), (3, "removed")]
    assert rows(membership_changed(a, a, ["k"])) == [(False,)]
    assert rows(drop_stale(a, b, ["k"])) == [(2,), (2,)]


def test_aggregates(spark):
    df = spark.createDataFrame([("h", "sda", "disk", 5), ("h", "sda1", "part", 9), ("h", "sdb", "disk", 2)], "host string, name string, type string, n int")
    out = with_aggregate_row(df, ["host"], "name", ["n"], F.col("type") == "disk")
    assert ("h", "aggregate", 7) in rows(out) and len(rows(out)) == 4
    df = spark.createDataFrame([("s", "d1", 1, 1), ("s", "d2", 0, 0), ("t", "d3", 0, 0)], "s string, d string, h int, m int")
    assert rows(mean_of_ratios(df, ["s"], "h", "m")) == [("s", 50.0), ("t", 0.0)]
    df = spark.createDataFrame([("s", "a", None, 1), ("s", "a", "t", 2)], "s string, d string, t string, b int")
    out = {(r.level, r.s, r.d, r.t): r.b for r in rollup_sizes(df, ["s", "d", "t"], ["b"]).collect()}
    assert out[(3, "s", "a", None)] == 1 and out[(2, "s", "a", None)] == 3 and out[(0, None, None, None)] == 3
    df = spark.createDataFrame([("j", 10, 5, 5)], "jobId string, hdfsBytesRead int, finishTime int, startTime int")
    assert rows(map_speed(df)) == [("j", 0.0)]
    assert rows(ratio_of_sums(df, ["jobId"], F.col("finishTime"), F.col("hdfsBytesRead"))) == [("j", 0.5)]
    text = "processor\t: 0\nphysical id\t: 0\ncore id\t\t: 0\nmodel name\t: X 3: y\ncpu MHz\t\t: 100.0\nprocessor\t: 1\nphysical id\t: 0\ncore id\t\t: 0\nmodel name\t: X 3: y\ncpu MHz\t\t: 200.0"
    (r,) = cpu_topology(dumps.parse_cpuinfo(lines(spark, text, host="h"))).collect()
    assert (r.cpuType, r.clock, r.totalCores, r.sockets, r.logicalCpus, r.hyperThreading) == ("X 3: y", 150.0, 1, 1, 2, "On")


def test_top_and_numbering(spark):
    df = spark.createDataFrame([(i, float(i), "active" if i % 2 else "idle") for i in range(100)], "id int, runtime double, state string")
    got = [r.id for r in long_running(df, F.lit(61.0)).collect()]
    assert got == list(range(99, 61, -2)) and 61 not in got
    assert len(long_running(df, F.lit(1.0)).collect()) == 20
    procs = spark.createDataFrame([("h", 1, i, float(i % 7), f"p{i}") for i in range(30)], "host string, time int, pid int, cpu double, processname string")
    assert [(r.pid, r.order) for r in top_processes(procs, n=3).orderBy("order").collect()] == [(6, 1), (13, 2), (20, 3)]
    assert "WindowGroupLimit" in plan(top_processes(procs, n=3))
    assert {r.processname for r in top_processes(procs, pattern="^p1?5$").collect()} == {"p5", "p15"}
    got = number_groups(spark.range(20), "id", 4, 2, rows_per_slice=3).orderBy("id").collect()
    assert [(r.group, r.phase) for r in got] == [(i % 4 + 1, i // 8 + 1) for i in range(20)]


def test_device_reports(spark):
    dev = spark.createDataFrame([("h", "sda", "disk"), ("h", "sda1", "part")], "host string, name string, type string")
    ctr = spark.createDataFrame(
        [("h", at(t), n, 1048576 * k, 0, 10 * k, 0, 50 * k, 7) for t, k in ((0, 1), (10, 3)) for n in ("sda", "sda1")],
        "host string, time timestamp, name string, read_bytes bigint, write_bytes bigint, read_count bigint, write_count bigint, read_time bigint, write_time bigint",
    )
    out = {(r.name, r.time): r for r in disk_report(dev, ctr).collect()}
    last = max(t for _, t in out)
    assert {n for n, _ in out} == {"sda", "sda1", "aggregate"}
    agg = out["aggregate", last]
    assert (agg.readIOPS, agg.readThroughput, agg.readLatency, agg.writeLatency) == (2.0, 0.2, 5.0, 0.0)
    nic = spark.createDataFrame([("h", "eth0", "physical"), ("h", "veth", "virtual")], "host string, name string, type string")
    ctr = spark.createDataFrame(
        [("h", at(t), n, 1250000 * t, 0, 1, 1, 0, 0) for t in (0, 10) for n in ("eth0", "veth")],
        "host string, time timestamp, name string, rx_bytes bigint, tx_bytes bigint, rx_packets bigint, tx_packets bigint, rx_errors bigint, tx_errors bigint",
    )
    got = {(r.name, r.rxMbps) for r in nic_report(nic, ctr).filter("elapsed_s is not null").collect()}
    assert got == {("eth0", 10.0), ("veth", 10.0), ("aggregate", 10.0)}
