"""Log search, payload decoding, the two ORC layouts, and the sinks."""

import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from meterline.operators.ordering import add_index
from meterline.operators.projections import add_date_parts
from meterline.plans.log_search import count_logs, find_logs, search_logs
from meterline.sinks import (
    compact_day,
    flat_documents,
    insert_overwrite_directory,
    keep_latest,
    read_result,
    upsert,
    write_batches,
    write_docs,
    write_result,
)
from meterline.sources.logs import decode_logs, read_logs, read_partitioned
from meterline.sources.tables import read_delimited

from helpers import T0, at, plan, rows

S0 = int(T0.timestamp())


@pytest.fixture
def events(spark):
    data = [
        ("a1", "x", "1", "error", at(0), "start"),  # exactly at the start: out
        ("a1", None, "1", "error", at(0.9), "same second as the start"),
        ("a1", "x", "1", "error", at(1), "in"),
        ("a1", None, "1", "error", at(5), "no type"),
        ("a2", "x", "1", "error", at(6), "other tag"),
        ("a1", "x", None, "error", at(7), "no plugin"),
        ("a1", "x", "1", "error", at(301), "second window"),
        ("a1", "x", "1", "error", at(301), "two in one second"),
        ("a1", "x", "1", "error", at(1200), "after a gap"),
        ("a1", "x", "1", "error", at(1999.5), "last second"),
        ("a1", "x", "1", "error", at(2000), "end"),  # exactly at the end: out
    ]
    return spark.createDataFrame(
        data, "_tag_appName string, _documentType string, _plugin string, level string, time timestamp, message string"
    )


def test_both_ends_are_excluded(events):
    got = [r.message for r in search_logs(events, S0, S0 + 2000).collect()]
    assert "start" not in got and "same second as the start" not in got and "end" not in got
    assert "in" in got and "last second" in got and "no plugin" in got


def test_terms(events):
    got = [r.message for r in search_logs(events, S0, S0 + 2000, tag="a1", plugin="1", level="error").collect()]
    assert "other tag" not in got and "no plugin" not in got and "no type" in got
    got = [r.message for r in search_logs(events, S0, S0 + 2000, doc_type="x").collect()]
    assert "no type" not in got


def test_windows_without_events_do_not_appear(events):
    got = count_logs(events, S0, S0 + 2000, tag="a1").orderBy("index").collect()
    assert [(r.timestamp - S0, r["count"], r["index"]) for r in got] == [(0, 3, 1), (300, 2, 2), (1200, 1, 3), (1800, 1, 4)]


def test_distributed_index_equals_plain(spark, events):
    assert rows(find_logs(events, S0, S0 + 2000), "message", "index") == rows(
        add_index(search_logs(events, S0, S0 + 2000).withColumn("timestamp", F.unix_timestamp("time")), "timestamp", ["message"]),
        "message", "index",
    )
    many = spark.range(5000).select((F.col("id") * 7919 % 50).alias("t"), "id").repartition(7)
    plain = rows(add_index(many, "t", ["id"]), "id", "index")
    assert rows(add_index(many, "t", ["id"], distributed=True), "id", "index") == plain


def test_decode_keeps_broken_rows(spark):
    good = json.dumps({"node": "n", "level": "info", "time": "2024-01-01T00:00:01.000Z", "extra": 1})
    df = spark.createDataFrame([(good,), ("{broken",)], "value string")
    got = decode_logs(df).select("data.node", "data.level", "data.time").collect()
    assert (got[0].node, got[0].level, got[0].time) == ("n", "info", datetime(2024, 1, 1, 0, 0, 1))
    assert got[1] == (None, None, None) and len(got) == 2


@pytest.fixture
def ingested(spark, events, tmp_path):
    src = str(tmp_path / "in")
    data = events.select(F.struct(F.lit("n").alias("node"), *events.columns).alias("data"))
    late = data.withColumn("data", F.col("data").withField("time", F.col("data.time") + F.expr("INTERVAL 1 DAY")))
    both = add_date_parts(data.unionByName(late), "data.time")
    both.write.partitionBy("year", "month", "day").orc(src)
    return src


def test_compaction_and_glob_read(spark, ingested, tmp_path):
    out = str(tmp_path / "out")
    for day in (1, 2):
        compact_day(spark, ingested, out, 2024, 1, day, files=3)
    assert read_logs(spark, out, 2024, 1, "{1,2}").count() == 22
    assert read_logs(spark, out, 2024, 1, "2").count() == 11
    assert len([f for f in os.listdir(f"{out}/2024/1/1") if f.endswith(".orc")]) <= 3
    with pytest.raises(Exception):
        compact_day(spark, ingested, out, 2024, 1, 1)


def test_search_prunes_folders_columns_and_rows(spark, ingested):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    found = search_logs(read_partitioned(spark, ingested), S0, S0 + 2000, level="error").select("_plugin")
    text = plan(found)
    assert "PartitionFilters: [" in text and "make_date" in text
    assert "PushedFilters: [" in text and "GreaterThanOrEqual(data.time" in text and "EqualTo(data.level" in text
    assert "message" not in text.split("ReadSchema")[1]


def test_result_overwrite_and_fetch(spark, tmp_path):
    root = str(tmp_path)
    write_result(spark.range(5), f"{root}/q")
    write_result(spark.range(3), f"{root}/q")
    assert read_result(spark, root, "q").count() == 3


def test_documents_are_routed(spark, tmp_path):
    path = str(tmp_path / "docs")
    data = [("mysql", "db", None, 1), ("disk", "stat", "i1", 2), ("elasticsearch", "node", None, 3)]
    write_docs(spark.createDataFrame(data, "_plugin string, _documentType string, plugin_instance string, n int"), path)
    got = {(r.dir_plugin, r.dir_type, r.dir_instance, r.n) for r in spark.read.json(path).collect()}
    assert got == {("mysql", "-", "-", 1), ("disk", "stat", "i1", 2), ("elasticsearchagent", "node", "-", 3)}


def test_text_arrays_are_parsed(spark):
    df = spark.createDataFrame([('[\\"a\\", \\"b\\"]', "x")], "tags_json string, actual_plugin_type string")
    assert flat_documents(df).collect()[0].asDict() == {"tags": ["a", "b"]}


def test_retention_keeps_newest(spark):
    df = spark.range(50).select((F.col("id") % 2).alias("k"), "id")
    assert rows(keep_latest(df, ["k"], "id", 3)) == [(0, 44), (0, 46), (0, 48), (1, 45), (1, 47), (1, 49)]
    assert "WindowGroupLimit" in plan(keep_latest(df, ["k"], "id", 3))


def test_batches_are_bounded(spark, tmp_path):
    path = str(tmp_path / "b")
    write_batches(spark.range(1200).coalesce(1), path)
    sizes = [sum(1 for _ in open(f"{path}/{f}")) for f in os.listdir(path) if f.endswith(".json")]
    assert sorted(sizes) == [200, 500, 500]


def test_upsert_keeps_known_values(spark):
    cur = spark.createDataFrame([(1, "a", 5, 1), (2, "b", 6, 1)], "id int, s string, n int, v int")
    new = spark.createDataFrame([(1, None, 7, 2), (3, "c", None, 2), (1, "z", None, 0)], "id int, s string, n int, v int")
    assert rows(upsert(cur, new, "id", "v")) == [(1, "a", 7, 2), (2, "b", 6, 1), (3, "c", None, 2)]


def test_overwrite_directory(spark, tmp_path):
    path = str(tmp_path / "t")
    insert_overwrite_directory(spark.range(4).select(F.col("id").cast("int").alias("a")), path)
    insert_overwrite_directory(spark.range(2).select(F.col("id").cast("int").alias("a")), path)
    assert rows(read_delimited(spark, path)) == [(0,), (1,)]


def test_shared_folder_comes_from_the_session(spark, monkeypatch):
    from meterline import session

    assert session.scratch_path(spark, "a").startswith(session.shared_dir(spark))
    monkeypatch.setattr(session, "CHECKPOINT_CONF", "spark.meterline.unset")
    made = session.shared_dir(spark)
    assert os.path.isdir(made) and session.shared_dir(spark) == made
    spark.conf.set("spark.meterline.unset", "/shared/folder")
    assert session.shared_dir(spark) == "/shared/folder"
    spark.conf.unset("spark.meterline.unset")
