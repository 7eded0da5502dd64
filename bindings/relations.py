"""Joins, set operations, ordering and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.operators.joins import (
    action_documents,
    attempt_containers,
    diff_snapshots,
    drop_stale,
    enrich,
    expand_jobs,
    membership_change,
    membership_changed,
    merge_pending,
    record_failure,
    stage_tasks,
    stale,
    task_attempts,
)
from meterline.operators.ordering import (
    by_size,
    find_one,
    global_sort,
    long_running,
    rank_within,
    search_page,
    top_processes,
)
from meterline.operators.sets import distinct_keys, union_docs
from meterline.operators.slices import carry_forward

from .common import TASKS, places, query, table, tasks


@query(
    "static_with_dynamic",
    """
WITH d AS (SELECT l_partkey * 2 AS p_partkey, CAST(sum(l_quantity) AS BIGINT) AS qty, 'dynamic' AS p_type FROM lineitem GROUP BY 1)
SELECT p_partkey, p_brand, CASE WHEN qty IS NOT NULL THEN d.p_type ELSE part.p_type END AS p_type, qty FROM part LEFT JOIN d USING (p_partkey)""",
)
def static_with_dynamic(spark, sf_dir):
    dyn = table(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") * 2).alias("p_partkey"))
    dyn = dyn.agg(F.sum("l_quantity").cast("bigint").alias("qty"))
    dyn = dyn.withColumn("p_type", F.lit("dynamic"))
    static = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    return enrich(static, dyn, ["p_partkey"])


@query(
    "inner_by_two_keys",
    """
SELECT l_orderkey, l_partkey, l_suppkey, s_name, s_nationkey, n_name FROM lineitem
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
)
def inner_by_keys(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey")
    sup = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
    nat = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return enrich(enrich(li, sup, ["l_suppkey"], "inner"), nat, ["s_nationkey"], "inner")


@query(
    "health_with_literal",
    """
SELECT s_suppkey, CASE WHEN s_suppkey = 0 THEN 'green' ELSE n_name END AS health FROM supplier
LEFT JOIN nation ON s_nationkey = n_nationkey * 2""",
)
def health_with_literal(spark, sf_dir):
    health = table(spark, sf_dir, "nation").select(
        (F.col("n_nationkey") * 2).alias("s_nationkey"), F.col("n_name").alias("health")
    )
    rows = enrich(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), health, ["s_nationkey"])
    fixed = F.when(F.col("s_suppkey") == 0, F.lit("green")).otherwise(F.col("health"))
    return rows.select("s_suppkey", fixed.alias("health"))


@query(
    "stage_with_tasks",
    """
SELECT o_orderkey, count(l_orderkey) AS tasks, coalesce(CAST(sum(l_quantity) AS BIGINT), 0) AS quantity
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""",
)
def stage_with_tasks(spark, sf_dir):
    stages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("stageId"))
    parts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("stageId"), "l_quantity", F.lit(1).alias("one"))
    rows = stage_tasks(stages, parts, ["stageId"])
    return rows.groupBy(F.col("stageId").alias("o_orderkey")).agg(
        F.count("one").alias("tasks"), F.coalesce(F.sum("l_quantity").cast("bigint"), F.lit(0)).alias("quantity")
    )


@query(
    "tasks_with_attempts",
    f"""
WITH {TASKS}, t AS (SELECT o_orderkey AS orderId, CASE WHEN o_orderstatus = 'O' THEN 'MAP' ELSE 'REDUCE' END AS type FROM orders)
SELECT orderId, type, line, state FROM t JOIN tasks USING (orderId, type)""",
)
def tasks_with_attempts(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "O", "MAP").otherwise("REDUCE")
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("orderId"), kind.alias("type"))
    attempts = tasks(spark, sf_dir).select("orderId", "type", "line", "state")
    return task_attempts(parents, attempts, ["orderId", "type"])


@query(
    "attempt_with_container",
    """
WITH c AS (SELECT l_suppkey AS containerId, min(l_partkey) AS part FROM lineitem GROUP BY 1)
SELECT s_suppkey, part FROM supplier LEFT JOIN c ON s_suppkey * 2 = containerId""",
)
def attempt_with_container(spark, sf_dir):
    attempts = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 2).alias("containerId"))
    boxes = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("containerId"), F.col("l_partkey").alias("part")
    )
    return attempt_containers(attempts, boxes).select("s_suppkey", "part")


ACTIONS = """
actions AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '-' ELSE 'job_' || o_custkey END AS externalId,
         CASE WHEN o_orderstatus = 'F' THEN 'job_' || (o_custkey + 1) || ',job_' || (o_custkey + 2) END AS externalChildIDs
  FROM orders)"""


def _actions(spark, sf_dir):
    cust, status = F.col("o_custkey"), F.col("o_orderstatus")
    children = F.concat(
        F.lit("job_"), (cust + 1).cast("string"), F.lit(",job_"), (cust + 2).cast("string")
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_orderkey").alias("wfaId"),
        F.lit("wf").alias("wfId"),
        F.when(status == "P", "-").otherwise(F.concat(F.lit("job_"), cust.cast("string"))).alias("externalId"),
        F.when(status == "F", children).alias("externalChildIDs"),
    )


@query(
    "action_jobs",
    f"""
WITH {ACTIONS},
j AS (
  SELECT o_orderkey, externalId AS jobId, 0 AS position FROM actions WHERE externalId <> '-'
  UNION ALL SELECT o_orderkey, split_part(externalChildIDs, ',', 1), 1 FROM actions WHERE externalChildIDs IS NOT NULL
  UNION ALL SELECT o_orderkey, split_part(externalChildIDs, ',', 2), 2 FROM actions WHERE externalChildIDs IS NOT NULL)
SELECT o_orderkey, jobId, CAST(position AS INTEGER) AS position FROM j""",
)
def action_jobs(spark, sf_dir):
    return expand_jobs(_actions(spark, sf_dir)).select("o_orderkey", "jobId", "position")


@query(
    "action_documents",
    f"""
WITH {ACTIONS}
SELECT o_orderkey, externalId, unnest(CASE WHEN externalChildIDs IS NULL THEN [externalId] ELSE string_split(externalChildIDs, ',') END) AS "externalChildID"
FROM actions WHERE externalId <> '-'""",
)
def action_docs(spark, sf_dir):
    return action_documents(_actions(spark, sf_dir)).select("o_orderkey", "externalId", "externalChildID")


SNAPSHOTS = """
cur AS (SELECT l_suppkey AS k, CAST(sum(l_quantity) AS BIGINT) AS q, 1000 + l_suppkey AS t FROM lineitem WHERE l_shipdate >= TIMESTAMP '1999-01-01' GROUP BY 1),
prev AS (SELECT l_suppkey AS k, CAST(sum(l_quantity) AS BIGINT) AS q, 1000 AS t FROM lineitem
         WHERE l_shipdate < TIMESTAMP '1999-01-01' AND l_suppkey <> 3 GROUP BY 1)"""


def _snapshots(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    edge = F.lit("1999-01-01").cast("timestamp_ntz")

    def snap(rows):
        return rows.groupBy(F.col("l_suppkey").alias("k")).agg(F.sum("l_quantity").cast("bigint").alias("q"))

    cur = snap(li.filter(F.col("l_shipdate") >= edge)).withColumn("t", F.lit(1000) + F.col("k"))
    prev = snap(li.filter((F.col("l_shipdate") < edge) & (F.col("l_suppkey") != 3))).withColumn("t", F.lit(1000).cast("bigint"))
    return cur, prev


@query(
    "snapshot_difference",
    f"""
WITH {SNAPSHOTS}
SELECT k, CASE WHEN prev.k IS NULL THEN cur.q WHEN cur.t - prev.t > 90 THEN 0 ELSE cur.q - prev.q END AS q FROM cur LEFT JOIN prev USING (k)""",
)
def snapshot_difference(spark, sf_dir):
    cur, prev = _snapshots(spark, sf_dir)
    return diff_snapshots(cur, prev, ["k"], ["q"], "t", 30).select("k", "q")


MEMBERS = """
a AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS p FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'),
b AS (SELECT DISTINCT l_suppkey AS k, l_partkey AS p FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')"""


def _members(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    edge = F.lit("1998-01-01").cast("timestamp_ntz")
    keys = [F.col("l_suppkey").alias("k"), F.col("l_partkey").alias("p")]
    return li.filter(F.col("l_shipdate") < edge).select(*keys), li.filter(F.col("l_shipdate") >= edge).select(*keys)


@query(
    "membership_change",
    f"""
WITH {MEMBERS}
SELECT k, p, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a)
UNION ALL SELECT k, p, 'removed' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
)
def members_changed(spark, sf_dir):
    before, after = _members(spark, sf_dir)
    return membership_change(after, before, ["k", "p"])


@query(
    "membership_changed",
    f"""WITH {MEMBERS} SELECT EXISTS (SELECT * FROM a EXCEPT SELECT * FROM b) OR EXISTS (SELECT * FROM b EXCEPT SELECT * FROM a) AS changed""",
)
def membership_flag(spark, sf_dir):
    before, after = _members(spark, sf_dir)
    return membership_changed(after, before, ["k", "p"])


@query(
    "stale_removal",
    """
SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') THEN 'active' ELSE 'stale' END AS state
FROM customer""",
)
def stale_removal(spark, sf_dir):
    known = table(spark, sf_dir, "customer").select("c_custkey")
    active = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    kept = drop_stale(known, active, ["c_custkey"]).withColumn("state", F.lit("active"))
    return kept.unionByName(stale(known, active, ["c_custkey"]).withColumn("state", F.lit("stale")))


def _pending(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("app"))
    return rows.agg(F.max("o_orderkey").alias("retry_attempt_id"), F.count(F.lit(1)).cast("int").alias("number_of_failures"))


PENDING = """
pending AS (SELECT o_custkey AS app, max(o_orderkey) AS retry_attempt_id, CAST(count(*) AS INTEGER) AS number_of_failures
            FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)"""


@query(
    "pending_merge",
    f"""
WITH {PENDING}
SELECT coalesce(c_custkey * 2, app) AS app, c_mktsegment AS name, retry_attempt_id, coalesce(number_of_failures, 0) AS number_of_failures
FROM customer FULL JOIN pending ON c_custkey * 2 = app""",
)
def pending_merge(spark, sf_dir):
    new = table(spark, sf_dir, "customer")
    new = new.select((F.col("c_custkey") * 2).alias("app"), F.col("c_mktsegment").alias("name"))
    return merge_pending(new, _pending(spark, sf_dir), "app")


@query(
    "failure_recording",
    f"""
WITH {PENDING},
failed AS (SELECT c_custkey * 2 AS fk, 7 AS r FROM customer)
SELECT coalesce(app, fk) AS app, CASE WHEN fk IS NOT NULL THEN r ELSE retry_attempt_id END AS retry_attempt_id,
       coalesce(number_of_failures, 0) + CASE WHEN fk IS NOT NULL THEN 1 ELSE 0 END AS number_of_failures
FROM pending FULL JOIN failed ON app = fk
WHERE coalesce(number_of_failures, 0) + CASE WHEN fk IS NOT NULL THEN 1 ELSE 0 END <= 3""",
)
def failure_recording(spark, sf_dir):
    failed = table(spark, sf_dir, "customer")
    failed = failed.select((F.col("c_custkey") * 2).alias("app"), F.lit(7).cast("bigint").alias("retry_attempt_id"))
    return record_failure(_pending(spark, sf_dir), failed, "app")


@query(
    "longest_running",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity AS runtime FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'A'
ORDER BY l_extendedprice DESC, l_orderkey, l_partkey LIMIT 20""",
)
def longest_running(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter("l_quantity > 25").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("runtime"), "l_extendedprice",
        F.when(F.col("l_returnflag") == "A", "active").otherwise("idle").alias("state"),
    )
    out = long_running(rows, F.lit(0.0), 20, "l_extendedprice", "state", ["l_orderkey", "l_partkey"])
    return out.drop("state", "l_extendedprice")


@query(
    "objects_by_size",
    "SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS place FROM documents",
)
def objects_by_size(spark, sf_dir):
    """The sorted rows, each with the place it has."""
    return places(spark, by_size(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "n_chars", ["doc_id"]))


@query(
    "search_page",
    """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '5-LOW' ORDER BY o_orderdate, o_orderkey LIMIT 500 OFFSET 100""",
)
def search_one_page(spark, sf_dir):
    terms = {"o_orderstatus": "O", "o_orderpriority": "5-LOW"}
    return search_page(table(spark, sf_dir, "orders"), terms, ["o_orderdate", "o_orderkey"], 100, 500).select(
        "o_orderkey", "o_custkey"
    )


@query("exactly_one_lookup", "SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000007'")
def exactly_one(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    none = find_one(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), {"c_mktsegment": "MACHINERY"})
    return find_one(rows, {"c_name": "Customer#000000007"}).unionByName(none.drop("c_mktsegment"))


@query(
    "record_sort",
    """
SELECT l_orderkey, l_linenumber, CAST(100 AS INTEGER) AS size, row_number() OVER (ORDER BY substr(md5(l_orderkey || '-' || l_linenumber), 1, 10), l_orderkey, l_linenumber) - 1 AS place
FROM lineitem""",
)
def record_sort(spark, sf_dir):
    """The sorted records, each with the place it has."""
    done = places(spark, sorted_records(spark, sf_dir))
    return done.select("l_orderkey", "l_linenumber", (F.length("key") + F.length("payload")).alias("size"), "place")


def sorted_records(spark, sf_dir):
    """The line items as records of 100 bytes (a 10-byte key and a payload), totally sorted."""
    name = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.substring(F.md5(name), 1, 10).alias("key"), F.rpad(name, 90, "X").alias("payload")
    )
    return global_sort(rows, ["key", "l_orderkey", "l_linenumber"])


@query(
    "top_processes",
    """
SELECT host, time, pid, "order" FROM (
  SELECT l_suppkey AS host, l_linenumber AS time, l_orderkey AS pid, l_partkey,
         row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_extendedprice DESC, l_orderkey, l_partkey) AS "order"
  FROM lineitem WHERE l_returnflag IN ('A', 'R')) WHERE "order" <= 5""",
)
def busiest(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("host"), F.col("l_linenumber").alias("time"), F.col("l_orderkey").alias("pid"),
        "l_partkey", F.col("l_extendedprice").alias("cpu"), F.col("l_returnflag").alias("processname"),
    )
    out = top_processes(rows, "cpu", 5, "^(A|R)$", tiebreak=["pid", "l_partkey"])
    return out.select("host", "time", "pid", F.col("order").cast("bigint").alias("order"))


@query(
    "rank_within_dump",
    """
SELECT l_suppkey, l_orderkey, l_partkey, l_linenumber,
       row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber) AS "order" FROM lineitem""",
)
def ranked(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    out = rank_within(rows, ["l_suppkey"], "l_extendedprice", ["l_orderkey", "l_partkey", "l_linenumber"])
    return out.select("l_suppkey", "l_orderkey", "l_partkey", "l_linenumber", "order")


@query(
    "document_union",
    """
SELECT 'customer' AS kind, c_custkey AS id, c_mktsegment AS segment, NULL AS balance FROM customer
UNION ALL SELECT 'supplier', s_suppkey, NULL, s_acctbal FROM supplier""",
)
def document_union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(
        F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")
    )
    b = table(spark, sf_dir, "supplier").select(
        F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")
    )
    return union_docs(a, b)


@query(
    "attempt_union",
    f"WITH {TASKS} SELECT type, count(*) AS n, CAST(sum(coalesce(elapsedShuffleTime, 0)) AS BIGINT) AS shuffle FROM "
    "(SELECT type, NULL AS elapsedShuffleTime FROM tasks WHERE type = 'MAP' UNION ALL SELECT type, elapsedShuffleTime FROM tasks WHERE type = 'REDUCE') GROUP BY 1",
)
def attempt_union(spark, sf_dir):
    rows = tasks(spark, sf_dir)
    maps = rows.filter("type = 'MAP'").select("type", "jobId")
    reduces = rows.filter("type = 'REDUCE'").select("type", "jobId", "elapsedShuffleTime")
    return union_docs(maps, reduces).groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("elapsedShuffleTime", F.lit(0))).alias("shuffle")
    )


@query("distinct_keys", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_pairs(spark, sf_dir):
    return distinct_keys(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"])


@query(
    "carry_forward",
    """
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS asked
FROM conversations""",
)
def carried(spark, sf_dir):
    """The question each turn answers: the last user text so far."""
    rows = table(spark, sf_dir, "conversations").withColumn("asked", F.when(F.col("role") == "user", F.col("text")))
    return carry_forward(rows, ["conv_id"], "turn", "asked").select("conv_id", "turn", "asked")


@query(
    "carry_forward_sliced",
    """
SELECT event_id, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER (ORDER BY ts, event_id) AS last_error FROM events""",
)
def carried_sliced(spark, sf_dir):
    """One series of all events, cut by time."""
    rows = table(spark, sf_dir, "events").withColumn("last_error", F.when(F.col("event_type") == "error", F.col("event_id")))
    return carry_forward(rows, [], "ts", "last_error", ["event_id"], rows_per_slice=200).select("event_id", "last_error")
