"""Filters, renames, defaults, decoding, flattening and pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterline.functions import (
    band,
    camel_case,
    decode,
    elapsed_to_minutes,
    elapsed_to_seconds,
    exclude,
    guard_negative,
    iso_gmt_to_epoch,
    memory_pool_name,
    size_to_kb,
    string_to_array,
    template_url,
    to_double,
    to_int,
    to_unit,
    within_lookback,
    zoned_text_to_epoch,
)
from meterline.operators.aggregates import band_counts
from meterline.operators.projections import (
    counters_to_columns,
    drop_fields,
    fill_defaults,
    flatten_struct,
    keep_states,
    keep_types,
    name_values_to_columns,
    or_placeholder,
    rename_keys,
    rename_map_keys,
    rows_to_columns,
    with_tags,
)

from .common import query, table


@query(
    "keep_document_types",
    "SELECT event_id, event_type AS _documentType FROM events WHERE event_type IN ('click', 'error')",
)
def keep_document_types(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("_documentType"))
    return keep_types(rows, ["click", "error"])


@query(
    "tag_enrichment",
    "SELECT r_regionkey, 'tagged' AS r_name, 'disk' AS _plugin, 'statics' AS _documentType, 10 AS interval FROM region",
)
def tag_enrichment(spark, sf_dir):
    return with_tags(table(spark, sf_dir, "region"), r_name="tagged", _plugin="disk", _documentType="statics", interval=10)


@query(
    "defaults_for_missing",
    """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'none' WHEN o_orderstatus = 'F' THEN 'none' ELSE o_orderstatus END AS status,
       CAST(CASE WHEN o_orderstatus = 'O' THEN 0 ELSE o_custkey END AS BIGINT) AS cust, CAST(7 AS INTEGER) AS absent FROM orders""",
)
def defaults_for_missing(spark, sf_dir):
    status = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(status == "P", F.lit(None)).when(status == "F", F.lit("  ")).otherwise(status).alias("status"),
        F.when(status != "O", F.col("o_custkey")).alias("cust"),
    )
    return fill_defaults(rows, {"status": "none", "cust": 0, "absent": 7})


@query(
    "unit_conversion",
    """
SELECT doc_id, round(n_chars * 4096.0::DOUBLE / 1048576.0::DOUBLE, 2) AS mb, round(n_chars / 128.0::DOUBLE, 2) AS pages_mb,
       n_chars / 1000.0::DOUBLE AS s, CASE WHEN n_chars - 300 >= 0 THEN n_chars - 300 END AS guarded FROM documents""",
)
def unit_conversion(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        to_unit(F.col("n_chars") * 4096, "MB").alias("mb"),
        to_unit("n_chars", "pages8k_to_MB").alias("pages_mb"),
        to_unit("n_chars", "ms_to_s", None).alias("s"),
        guard_negative(F.col("n_chars") - 300).alias("guarded"),
    )


@query(
    "renamed_fields",
    """
SELECT n_nationkey AS "nationKey", n_name AS "nationName", lower(n_name) AS _tag_region FROM nation""",
)
def renamed_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").withColumn("tag.Region", F.lower("n_name"))
    rows = rename_keys(rows, {"n_nationkey": "nationKey", "n_name": "nationName"})
    rows = rename_keys(rows, lambda c: c if "." not in c else "_" + c.lower().replace(".", "_"))
    return drop_fields(rows, ["n_regionkey"])


@query(
    "camel_case_keys",
    """
SELECT p_type, p_brand, count(*) AS n,
       lower(p_type[1]) || lower(p_type[2:]) || 'BytesRead' AS name FROM part GROUP BY 1, 2, 4""",
)
def camel_case_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.withColumn("m", F.create_map(F.concat("p_type", F.lit("_BYTES_READ")), F.lit(1)))
    rows = rename_map_keys(rows, "m", camel_case)
    return rows.select("p_type", "p_brand", "n", F.map_keys("m")[0].alias("name"))


@query(
    "memory_pool_names",
    """
SELECT p_partkey, CASE WHEN p_type = 'STANDARD' THEN 'TenuredGen' WHEN p_type = 'ECONOMY' THEN 'OldGen'
  WHEN p_type = 'PROMO' THEN 'CompClass' WHEN p_type = 'SMALL' THEN 'Eden' ELSE replace(p_name, ' ', '') END AS pool FROM part""",
)
def memory_pools(spark, sf_dir):
    t = F.col("p_type")
    raw = (
        F.when(t == "STANDARD", "PS Tenured Old Gen").when(t == "ECONOMY", "PS Old Gen")
        .when(t == "PROMO", "Compressed Class Space").when(t == "SMALL", "PS Eden Space").otherwise(F.col("p_name"))
    )
    return table(spark, sf_dir, "part").select("p_partkey", memory_pool_name(raw).alias("pool"))


@query(
    "flattened_metrics",
    r"""
SELECT event_id, user_id AS "resultSize", CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS "shuffleReadRecordsRead",
       user_id * 2 AS "shuffleReadFetchWaitTime", user_id + 1 AS "inputBytesRead" FROM events""",
)
def flattened_metrics(spark, sf_dir):
    """Nested task metrics, as JSON text first and then as a struct."""
    text = F.format_string(
        '{"resultSize": %d, "shuffleReadMetrics": {"recordsRead": %s, "fetchWaitTime": %d}, "inputMetrics": {"bytesRead": %d}}',
        "user_id", F.regexp_extract("props", r"(\d+)", 1), F.col("user_id") * 2, F.col("user_id") + 1,
    )
    schema = (
        "resultSize BIGINT, shuffleReadMetrics STRUCT<recordsRead: BIGINT, fetchWaitTime: BIGINT>, "
        "inputMetrics STRUCT<bytesRead: BIGINT>"
    )
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json(text, schema).alias("taskMetrics"))
    return flatten_struct(rows, "taskMetrics")


@query(
    "accumulators_to_columns",
    """
SELECT event_id, user_id AS "shuffleReadRecordsRead", value AS "executorRunTime", event_type AS "label" FROM events""",
)
def accumulators_to_columns(spark, sf_dir):
    def entry(name, value):
        return F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))

    arr = F.array(
        entry("internal.metrics.shuffle.read.recordsRead", F.col("user_id")),
        entry("internal.metrics.executorRunTime", F.col("value")),
        entry("internal.metrics.label", F.col("event_type")),
        entry("number of output rows", F.lit(5)),
    )
    rows = table(spark, sf_dir, "events").select("event_id", arr.alias("accumulatorUpdates"))
    kinds = {"shuffleReadRecordsRead": "bigint", "executorRunTime": "double", "label": "string"}
    return name_values_to_columns(rows, "accumulatorUpdates", kinds)


@query(
    "counter_groups_to_columns",
    """SELECT o_orderkey, o_custkey AS "hdfsBytesReadTotal", o_orderkey AS "cpuMillisecondsTotal" FROM orders""",
)
def counter_groups(spark, sf_dir):
    def counter(name, col):
        return F.struct(F.lit(name).alias("name"), F.col(col).alias("value"))

    groups = F.array(
        F.struct(F.array(counter("HDFS_BYTES_READ", "o_custkey")).alias("counts")),
        F.struct(F.array(counter("CPU_MILLISECONDS", "o_orderkey")).alias("counts")),
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", groups.alias("groups"))
    return counters_to_columns(rows, "groups", ["hdfsBytesRead", "cpuMilliseconds"], "Total").drop("groups")


@query(
    "status_rows_to_columns",
    """
SELECT o_custkey, max(CASE WHEN o_orderstatus = 'O' THEN o_orderkey END) AS "O",
       max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) AS "F", max(CASE WHEN o_orderstatus = 'P' THEN o_orderkey END) AS "P"
FROM orders GROUP BY 1""",
)
def status_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("key", F.lower("o_orderstatus"))
    return rows_to_columns(rows, ["o_custkey"], "key", "o_orderkey", ["O", "F", "P"])


@query("state_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O', 'F')")
def state_filter(spark, sf_dir):
    return keep_states(table(spark, sf_dir, "orders"), ["O", "F"], "o_orderstatus").select("o_orderkey")


@query(
    "code_decode",
    """
SELECT c_custkey, CASE c_nationkey WHEN 0 THEN 'noState' WHEN 1 THEN 'Running' WHEN 3 THEN 'Paused' ELSE 'Unknown' END AS state,
       c_nationkey = 1 AS running FROM customer""",
)
def code_decode(spark, sf_dir):
    labels = {0: "noState", 1: "Running", 3: "Paused"}
    return table(spark, sf_dir, "customer").select(
        "c_custkey", decode("c_nationkey", labels).alias("state"), (F.col("c_nationkey") == 1).alias("running")
    )


@query(
    "utilisation_bands",
    """
SELECT user_id, count(*) FILTER (WHERE value >= 0 AND value <= 10) AS "numLowActive",
       count(*) FILTER (WHERE value > 10 AND value <= 40) AS "numMedActive",
       count(*) FILTER (WHERE value > 40 AND value <= 100) AS "numHighActive" FROM events GROUP BY 1""",
)
def utilisation_bands(spark, sf_dir):
    names = {"low": "numLowActive", "med": "numMedActive", "high": "numHighActive"}
    return band_counts(table(spark, sf_dir, "events"), ["user_id"], band("value"), names)


@query(
    "url_templates",
    r"""
SELECT page_id, regexp_replace(regexp_replace(url, '^(https?://[^/]+/[a-z]+)/[0-9]+', '\1/[id]'), 'x^', '') AS api FROM pages""",
)
def url_templates(spark, sf_dir):
    rules = [(r"^https?://[^/]+/[a-z]+/[0-9]+", r"^(https?://[^/]+/[a-z]+)/[0-9]+", "$1/[id]")]
    return table(spark, sf_dir, "pages").select("page_id", template_url("url", rules).alias("api"))


@query(
    "url_templates_default_rules",
    """
SELECT event_id, CASE WHEN event_type = 'click' THEN 'http://10.0.0.1:80/opportunity/[id]'
  WHEN event_type = 'view' THEN 'http://10.0.0.1:80/userDetails/[id]/x'
  ELSE 'http://host/opportunity/' || CAST(event_id AS VARCHAR) END AS api FROM events""",
)
def url_templates_default(spark, sf_dir):
    ident = F.col("event_id").cast("string")
    url = (
        F.when(F.col("event_type") == "click", F.concat(F.lit("http://10.0.0.1:80/opportunity/"), ident))
        .when(F.col("event_type") == "view", F.concat(F.lit("http://10.0.0.1:80/userDetails/"), ident, F.lit("/x")))
        .otherwise(F.concat(F.lit("http://host/opportunity/"), ident))
    )
    return table(spark, sf_dir, "events").select("event_id", template_url(url).alias("api"))


@query("system_exclusion", "SELECT n_nationkey, n_name FROM nation WHERE n_name NOT IN ('NATION_0', 'NATION_7')")
def system_exclusion(spark, sf_dir):
    rows = table(spark, sf_dir, "nation")
    return rows.filter(exclude("n_name", ["NATION_0", "NATION_7"])).select("n_nationkey", "n_name")


@query(
    "closed_lookback",
    "SELECT o_orderkey FROM orders WHERE CAST(epoch(o_orderdate) AS BIGINT) BETWEEN 900000000 - 31536000 AND 900000000",
)
def closed_lookback(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    return rows.filter(within_lookback(F.unix_timestamp("o_orderdate"), F.lit(900000000), 31536000)).select("o_orderkey")


@query(
    "elapsed_strings",
    """
SELECT event_id, user_id * 3600 + (event_id % 60) * 60 + event_id % 50 AS seconds,
       CASE WHEN event_id % 7 <> 0 THEN CAST(2 * 1440 + user_id * 60 + event_id % 60 AS DOUBLE) + round((event_id % 50) / 60.0::DOUBLE, 4) END AS minutes,
       (event_id % 60) * 60 + event_id % 50 AS short FROM events""",
)
def elapsed_strings(spark, sf_dir):
    clock = F.format_string("%02d:%02d:%02d", "user_id", F.col("event_id") % 60, F.col("event_id") % 50)
    short = F.format_string("%02d:%02d", F.col("event_id") % 60, F.col("event_id") % 50)
    return table(spark, sf_dir, "events").select(
        "event_id", elapsed_to_seconds(clock).alias("seconds"),
        elapsed_to_minutes(F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("2-"), clock)).otherwise("45")).alias("minutes"), elapsed_to_seconds(short).alias("short"),
    )


@query(
    "size_suffixes",
    """
SELECT p_partkey, CAST(p_size AS DOUBLE) AS plain, p_size * 1024.0::DOUBLE AS m, (p_size + 0.5) * 1048576.0::DOUBLE AS g,
       p_size * 1073741824.0::DOUBLE AS t FROM part""",
)
def size_suffixes(spark, sf_dir):
    size = F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select(
        "p_partkey", size_to_kb(size).alias("plain"), size_to_kb(F.concat(size, F.lit("m"))).alias("m"),
        size_to_kb(F.concat(size, F.lit(".5g"))).alias("g"), size_to_kb(F.concat(size, F.lit("t"))).alias("t"),
    )


@query(
    "json_text_to_array",
    """
SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type END AS first, CASE WHEN event_type <> 'view' THEN 2 END AS n FROM events""",
)
def json_text_to_array(spark, sf_dir):
    text = F.format_string('[\\"%s\\", \\"%d\\"]', "event_type", "user_id")
    value = F.when(F.col("event_type") != "view", text).otherwise(F.col("event_type"))
    arr = string_to_array(value)
    return table(spark, sf_dir, "events").select(
        "event_id", F.try_element_at(arr, F.lit(1)).alias("first"), F.when(arr.isNotNull(), F.size(arr)).alias("n")
    )


@query(
    "placeholder_when_empty",
    """
SELECT CAST(NULL AS BIGINT) AS o_orderkey, CAST(NULL AS VARCHAR) AS o_orderstatus WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'X')
UNION ALL SELECT n_nationkey, n_name FROM nation""",
)
def placeholder_when_empty(spark, sf_dir):
    """An empty selection yields one NULL row, a non-empty one stays as it is."""
    none = table(spark, sf_dir, "orders").filter("o_orderstatus = 'X'").select("o_orderkey", "o_orderstatus")
    some = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("o_orderkey"), F.col("n_name").alias("o_orderstatus")
    )
    return or_placeholder(none).unionByName(or_placeholder(some))


@query(
    "text_to_epoch",
    """
SELECT o_orderkey, s + 4 * 3600 AS edt, s AS gmt, s AS iso, s + 7 * 3600 AS mst, s - 19800 AS kolkata, CAST(NULL AS BIGINT) AS unknown,
       -- daylight saving lasts from the first Sunday of April to the last of October until 2006
       s + CASE WHEN d >= CAST(y || '-04-01' AS DATE) + CAST((7 - dayofweek(CAST(y || '-04-01' AS DATE))) % 7 AS INTEGER)
                 AND d <= CAST(y || '-10-31' AS DATE) - CAST(dayofweek(CAST(y || '-10-31' AS DATE)) AS INTEGER) - 1 THEN 4 ELSE 5 END * 3600 AS eastern_noon
FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS y, CAST(epoch(o_orderdate) AS BIGINT) AS s FROM orders)""",
)
def text_to_epoch(spark, sf_dir):
    day = F.col("o_orderdate").cast("timestamp")
    wall = F.date_format(day, "E, dd MMM yyyy HH:mm:ss")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        zoned_text_to_epoch(F.concat(wall, F.lit(" EDT"))).alias("edt"),
        zoned_text_to_epoch(F.concat(wall, F.lit(" GMT"))).alias("gmt"),
        iso_gmt_to_epoch(F.concat(F.date_format(day, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("GMT"))).alias("iso"),
        zoned_text_to_epoch(F.concat(wall, F.lit(" MST"))).alias("mst"),
        zoned_text_to_epoch(F.concat(wall, F.lit(" Asia/Kolkata"))).alias("kolkata"),
        zoned_text_to_epoch(F.concat(wall, F.lit(" Nowhere/Zone"))).alias("unknown"),
        (zoned_text_to_epoch(F.concat(F.date_format(day + F.expr("INTERVAL 12 HOURS"), "E, dd MMM yyyy HH:mm:ss"), F.lit(" US/Eastern"))) - 43200).alias("eastern_noon"),
    )


@query(
    "safe_casts",
    r"""
SELECT doc_id, TRY_CAST(lang AS BIGINT) AS i, TRY_CAST(CAST(n_chars AS VARCHAR) AS BIGINT) AS n,
       TRY_CAST(CAST(n_chars AS VARCHAR) || '.5' AS DOUBLE) AS d FROM documents""",
)
def safe_casts(spark, sf_dir):
    n = F.col("n_chars").cast("string")
    return table(spark, sf_dir, "documents").select(
        "doc_id", to_int("lang").alias("i"), to_int(n).alias("n"), to_double(F.concat(n, F.lit(".5"))).alias("d")
    )
