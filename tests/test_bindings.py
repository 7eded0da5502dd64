"""Registered queries: contract, and a spread of them against their SQL on the smallest tables."""

import os
import re

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SPREAD = [
    "log_search_windows", "delta_hot_series", "critical_path", "stragglers", "workflow_delays", "size_rollup", "exposition_samples",
    "history_attempts", "membership_change", "incremental_mark", "spark_app_report", "throughput_numbering",
]

needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def test_every_query_has_sql():
    own = {q for q in entry.queries() if not re.match(r"op\d+_|pipeline$", q)}
    assert own <= set(entry.oracle_sql()) <= set(entry.queries())
    assert len(own) > 140


@needs_data
def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["start", "end", "count", "timestamp", "index"] and df.count() > 0


@needs_data
@pytest.mark.parametrize("name", SPREAD)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    got = sorted(repr([r[c] for c in sorted(df.columns)]) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    order = [names.index(c) for c in sorted(names)]
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(repr([r[i] for i in order]) for r in cur.fetchall())


def test_api_calls_of_one_host_at_one_time(spark, tmp_path):
    """Two series of a host share a time and one of them falls: the other's row stays, as in the SQL."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(
        "CREATE TABLE events AS SELECT * FROM (VALUES (0, 0, 0, 5.0), (1, 1, 0, 9.0), (2, 1, 10, 4.0), (3, 2, 0, 3.0), (4, 2, 10, 6.0), (5, 2, 1, 7.0)) AS t(event_id, m, user_id, value)"
    )
    con.execute(
        f"COPY (SELECT CAST(event_id AS BIGINT) AS event_id, TIMESTAMP '2024-01-01' + to_minutes(m) AS ts, CAST(user_id AS BIGINT) AS user_id, 'view' AS event_type, CAST(value AS DOUBLE) AS value, '' AS props FROM events) TO '{tmp_path}/events.parquet'"
    )
    con.execute("DROP TABLE events")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(entry.oracle_sql()["api_call_report"]).fetchall()
    got = [tuple(r) for r in entry.queries()["api_call_report"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want) == [(1, 400), (2, 400), (4, 200)]
