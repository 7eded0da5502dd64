"""One unusual record must not end a job, and must not change the others."""

from datetime import date
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from meterline import session
from meterline.functions import elapsed_to_minutes, elapsed_to_seconds, local_to_utc, size_to_kb, utc_to_local, zoned_text_to_epoch
from meterline.operators.projections import counters_to_map, rename_map_keys
from meterline.sources.dumps import parse_exposition, parse_proxy_stats
from meterline.sources.history import find_history, parse_job_history


def lines(spark, *texts, path="p"):
    return spark.createDataFrame([(path, i, t) for i, t in enumerate(texts)], "path string, line_no long, value string")


def test_repeated_counters_last_one_wins(spark):
    kind = "array<struct<name:string,counts:array<struct<name:string,value:bigint>>>>"
    groups = [("a", [("X_Y", 1), (None, 5)]), ("b", None), ("c", [("x_y", 2), ("Z", 3)])]
    df = spark.createDataFrame([(groups,), (None,)], f"g {kind}")
    assert [r[0] for r in df.select(counters_to_map(F.col("g"))).collect()] == [{"xY": 2, "z": 3}, None]
    maps = spark.sql("SELECT map('a_b', 1, 'A_B', 2) AS m")
    assert rename_map_keys(maps, "m").first()[0] == {"aB": 2}


def test_history_lines_without_payload(spark):
    start = '{"type":"TASK_STARTED","event":{"T":{"taskid":"t1","taskType":"MAP","startTime":5}}}'
    texts = ["Avro-Json", '{"type":"TASK_FINISHED","event":{}}', '{"type":"TASK_FINISHED"}', '{"type":"TASK_FIN', start]
    out = parse_job_history(spark.createDataFrame([("f", t) for t in texts], "job_file string, value string")).collect()
    assert [r.event is None for r in out] == [True, True, False] and out[2].event.taskid == "t1"


def test_exposition_lines_cut_short(spark):
    texts = ["# HELP", "# TYPE", "# TYPE x", 'm{a="1",a="2"} 3', "# HELP m about", "m 4"]
    out = parse_exposition(lines(spark, *texts)).orderBy("line_no").collect()
    assert [(r.metric, r.document, r.labels, r.value) for r in out] == [("m", None, {"a": "2"}, 3.0), ("m", "m", {}, 4.0)]


def test_proxy_dumps_name_their_own_fields(spark):
    one = lines(spark, "# pxname,svname,slim,scur,", "a,FRONTEND,100,7", "Service Unavailable", "", path="one")
    two = lines(spark, "no header yet,x", "# pxname,svname,scur,slim,", "b,FRONTEND,8,200,extra", "c,BACKEND", path="two")
    out = parse_proxy_stats(one.unionByName(two)).collect()
    good = {r.pxname: r.stats for r in out if r._corrupt is None}
    assert good == {"a": {"slim": "100", "scur": "7"}, "b": {"scur": "8", "slim": "200"}, "c": {"scur": "0", "slim": "0"}}
    assert sorted(r._corrupt for r in out if r._corrupt) == ["Service Unavailable", "no header yet,x"]


def test_durations_and_sizes(spark):
    df = spark.createDataFrame([("45",), ("x",), ("01:30",), (None,)], "t string")
    assert [tuple(r) for r in df.select(elapsed_to_minutes("t"), elapsed_to_seconds("t")).collect()] == [(None, 45), (None, None), (1.5, 90), (None, None)]
    sizes = spark.createDataFrame([("12",), ("1.5m",), ("2k",), (".5g",), ("3t",), ("7x",), ("k",), (None,)], "t string")
    assert [r[0] for r in sizes.select(size_to_kb("t")).collect()] == [12.0, 1536.0, 2.0, 524288.0, 3221225472.0, None, None, None]


@pytest.mark.parametrize(
    "zone, hours",
    [("EDT", 4), ("EST", 5), ("GMT", 0), ("MST", 7), ("US/Eastern", 4), ("Asia/Kolkata", -5.5), ("+05:30", -5.5), ("No/Zone", None), ("", None)],
)
def test_zones_by_name(spark, zone, hours):
    df = spark.createDataFrame([(f"Fri, 10 Aug 2018 16:10:23 {zone}",)], "t string")
    assert df.select(zoned_text_to_epoch("t")).first()[0] == (None if hours is None else 1533917423 + hours * 3600)


def test_clock_times_of_a_zone(spark):
    df = spark.createDataFrame([("2018-08-10 16:10:23",)], "t string").select(F.to_timestamp_ntz("t").cast("timestamp").alias("t"))
    there = df.select(F.date_format(utc_to_local("t", "Asia/Kolkata"), "HH:mm"), F.date_format(local_to_utc("t", "US/Eastern"), "HH:mm")).first()
    assert tuple(there) == ("21:40", "20:10")


def test_history_of_two_days(spark, tmp_path):
    for day, name in (("10", "a_job_1.jhist"), ("11", "b_job_1.jhist"), ("12", "c_job_1.jhist"), ("11", "d_job_2.jhist")):
        (tmp_path / f"done/2018/08/{day}/000").mkdir(parents=True, exist_ok=True)
        (tmp_path / f"done/2018/08/{day}/000/{name}").write_text("x")
    names = lambda *a, **k: sorted(r.path.rpartition("/")[2] for r in find_history(spark, f"file:{tmp_path}", *a, **k).collect())
    assert names(date(2018, 8, 10), "job_1") == ["a_job_1.jhist", "b_job_1.jhist"]
    assert names(date(2018, 8, 12), "job_1") == ["c_job_1.jhist"] and names(date(2018, 8, 20)) == []
    assert names(date(2018, 8, 10), finished_after="2999-01-01T00:00:00") == []


def test_scratch_needs_a_shared_folder_on_a_cluster():
    def named(master, folder=None):
        conf = SimpleNamespace(get=lambda *a: folder)
        context = SimpleNamespace(master=master, applicationId="app", getConf=lambda: conf)
        return SimpleNamespace(sparkContext=context, conf=conf)

    assert session.shared_dir(named("yarn", "hdfs:///tmp/x")) == "hdfs:///tmp/x"
    assert session.shared_dir(named("local[4]")) == session.shared_dir(named("local"))
    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError):
            session.shared_dir(named(master))
