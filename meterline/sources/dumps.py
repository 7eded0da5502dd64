"""Status dumps and run logs of a whole fleet, parsed as columns.

Input is a line table: any identifying columns (host, scrape time, path), an order
column and the text in ``value``. Parsers keep the identifying columns and never
gather a file: what a line needs from earlier lines is carried forward by an ordered
window over (file, position).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import size_to_kb, template_url
from ..operators.ordering import number_groups
from ..operators.projections import last_wins_map
from ..operators.slices import carry_forward, drop_slices, slice_groups

LINE_ORDER = "line_no"


def read_lines(spark: SparkSession, path) -> DataFrame:
    """Lines of text files with ``path``, ``block`` and ``line_no``.

    A file may be split over tasks: rows of one split keep their order, and splits are
    ordered by the offset where they begin. ``line_no`` grows with the line but is not
    dense. Partition folders (``host=``, ``scrape_time=``) become columns.
    """
    lines = spark.read.text(path)
    extra = [c for c in lines.columns if c != "value"]
    seq = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return lines.select(
        *extra,
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
    ).withColumn(LINE_ORDER, F.col("block") + seq)


def ids(df: DataFrame) -> list[str]:
    """The identifying columns: all but the text."""
    return [c for c in df.columns if c != "value"]


def _words(col: Column | str = "value") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")


# ---------------------------------------------------------------- access log

# Log format directives, the column each fills and its pattern.
ACCESS_DIRECTIVES = {
    "%a": ("remoteIP", r"(\S+)"),
    "%A": ("localIP", r"(\S+)"),
    "%B": ("respBytes", r"(\S+)"),
    "%T": ("respTime", r"(\S+)"),
    "%h": ("remoteHost", r"(\S+)"),
    "%H": ("reqProtocol", r"(\S+)"),
    "%p": ("port", r"(\S+)"),
    "%>s": ("status", r"(\S+)"),
    "%t": ("reqTime", r"\[([^\]]+)\]"),
    "%r": ("firstLineReq", r"(.*?)"),
    "%U": ("urlPath", r"(.*?)"),
}
ACCESS_FORMAT = '%a %A %B %T %h %H %p %>s %t "%r" "%U"'
ACCESS_NUMBERS = ("respBytes", "respTime", "port", "status")


def parse_access_log(df: DataFrame, fmt: str = ACCESS_FORMAT) -> DataFrame:
    """Request columns of access-log lines; a line that does not match goes to ``_corrupt``."""
    names, pattern = [], "^"
    for i, token in enumerate(fmt.split(" ")):
        bare = token.strip('"')
        name, piece = ACCESS_DIRECTIVES[bare]
        names.append(name)
        quote = '"' if token.startswith('"') else ""
        pattern += ("" if i == 0 else " ") + quote + piece + quote
    pattern += "$"
    v = F.col("value")
    good = v.rlike(pattern)
    out = {}
    for i, name in enumerate(names):
        text = F.when(good, F.regexp_extract(v, pattern, i + 1))
        if name in ACCESS_NUMBERS:
            out[name] = text.try_cast("double")
        elif name == "reqTime":
            out[name] = F.try_to_timestamp(text, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
        else:
            out[name] = text
    return df.withColumns({**out, "_corrupt": F.when(~good, v)}).drop("value")


# ---------------------------------------------------------------- load-test XML

LOAD_SCHEMA = (
    "_t BIGINT, _lt BIGINT, _by BIGINT, _ec BIGINT, _ng BIGINT, _it BIGINT, _rc STRING, _s STRING, "
    "_tn STRING, _ts BIGINT, method STRING, queryString STRING, `java.net.URL` STRING"
)


def read_load_samples(spark: SparkSession, path) -> DataFrame:
    """Samples of load-test result files."""
    raw = spark.read.format("xml").option("rowTag", "httpSample").schema(LOAD_SCHEMA).load(path)
    return shape_load_samples(raw)


def shape_load_samples(raw: DataFrame) -> DataFrame:
    """Typed sample columns; missing numbers are 0, the URL is templated to its API."""
    url = F.coalesce(F.col("`java.net.URL`"), F.lit(""))

    def number(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0).cast("bigint"))

    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    return raw.select(
        number("_by").alias("bytesRec"),
        number("_t").alias("elapsedTime"),
        number("_ec").alias("errorCount"),
        number("_ng").alias("groupThreads"),
        number("_it").alias("idleTime"),
        number("_lt").alias("latencyTime"),
        text("method").alias("method"),
        text("queryString").alias("queryString"),
        text("_rc").alias("responseCode"),
        F.coalesce(F.col("_s") == "true", F.lit(False)).alias("success"),
        text("_tn").alias("threadName"),
        number("_ts").alias("time_stamp"),
        url.alias("url"),
        template_url(url).alias("api"),
    )


# ---------------------------------------------------------------- exposition format

_LABEL = r'[A-Za-z_][A-Za-z0-9_]*="(?:[^"\\]|\\.)*"'


def parse_exposition(
    df: DataFrame, part: Sequence[str] = ("path",), order: str = LINE_ORDER, rows_per_slice: int = 1_000_000
) -> DataFrame:
    """Samples of metric exposition text: name, labels, value, and the HELP and TYPE in force.

    ``value_int`` is set where the text is a whole number, ``value`` always. A comment line cut
    short names nothing; of a repeated label the last counts.
    """
    v = F.col("value")
    is_help, is_type = v.startswith("# HELP"), v.startswith("# TYPE")
    words = F.split(v, " ")
    marked = df.withColumns(
        {
            "document": F.when(is_help, F.get(words, F.lit(2))),
            "help": F.when(is_help, F.array_join(F.slice(words, 4, F.greatest(F.size(words) - 3, F.lit(0))), " ")),
            # a HELP line opens a metric whose TYPE is not known yet: blank, not the last one
            "type": F.when(is_type, F.get(words, F.lit(3))).when(is_help, F.lit("")),
        }
    )
    filled = carry_forward(marked, part, order, ["document", "help", "type"], rows_per_slice=rows_per_slice)
    samples = filled.filter(~v.startswith("#") & (F.trim(v) != ""))
    labelled = v.contains("{")
    body = F.when(labelled, F.regexp_extract(v, r"\{(.*)\}", 1)).otherwise(F.lit(""))
    # one pass over the body; a name holds no quote, so the first one ends it
    pairs = F.transform(
        F.regexp_extract_all(body, F.lit(_LABEL), F.lit(0)),
        lambda p: F.struct(
            F.substring_index(p, '="', 1).alias("k"), F.substring(p, F.instr(p, '"') + 1, F.length(p) - F.instr(p, '"') - 1).alias("v")
        ),
    )
    text = F.when(labelled, F.regexp_extract(v, r"\}\s+(\S+)", 1)).otherwise(F.regexp_extract(v, r"^\S+\s+(\S+)", 1))
    return samples.withColumns(
        {
            "metric": F.regexp_extract(v, r"^([A-Za-z_:][A-Za-z0-9_:]*)", 1),
            "labels": last_wins_map(pairs),
            "type": F.nullif(F.col("type"), F.lit("")),
            "value_int": F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")),
            "_number": text.try_cast("double"),
        }
    ).drop("value").withColumnRenamed("_number", "value")


# ---------------------------------------------------------------- proxy CSV

def parse_proxy_stats(
    df: DataFrame, header: str | None = None, part: Sequence[str] = ("path",), order: str = LINE_ORDER, rows_per_slice: int = 1_000_000
) -> DataFrame:
    """Rows of proxy statistics CSV as a map column ``stats``, with ``pxname`` and ``svname``.

    The ``# pxname,svname,...`` line of each dump names the fields of the lines that follow it:
    it is carried down within ``part`` in the order of ``order``, so dumps of different
    versions keep their own order of fields. ``header`` names them for all lines instead, and then
    neither column is needed. Empty fields are 0. A line with fewer than two fields, or without a
    header before it, goes to ``_corrupt``.
    """
    v = F.col("value")
    if header is None:
        named = carry_forward(
            df.withColumn("_header", F.when(v.startswith("#"), v)), part, order, "_header", rows_per_slice=rows_per_slice
        )
    else:
        named = df.withColumn("_header", F.lit(header))
    rows = named.filter(~v.startswith("#") & (F.trim("value") != ""))
    names = F.split(F.regexp_replace("_header", r"^#\s*|\s+$", ""), ",")
    cells = F.split(v, ",")
    entries = F.transform(
        names, lambda n, i: F.struct(F.nullif(n, F.lit("")).alias("k"), F.coalesce(F.nullif(F.get(cells, i), F.lit("")), F.lit("0")).alias("v"))
    )
    good = F.coalesce((F.size(cells) > 1) & F.col("_header").isNotNull(), F.lit(False))
    return rows.withColumns(
        {
            "pxname": F.when(good, F.get(cells, F.lit(0))),
            "svname": F.when(good, F.get(cells, F.lit(1))),
            "stats": F.when(good, last_wins_map(F.filter(F.slice(entries, 3, F.greatest(F.size(entries), F.lit(1))), lambda e: e["k"].isNotNull()))),
            "_corrupt": F.when(~good, v),
        }
    ).drop("value", "_header")


# Proxy fields shown for each side, with output name and type.
FRONTEND_FIELDS = {
    "reqRate": ("req_rate", "double"),
    "rate": ("rate", "double"),
    "ereq": ("ereq", "bigint"),
    "dreq": ("dreq", "bigint"),
    "hrsp_4xx": ("hrsp_4xx", "bigint"),
    "hrsp_5xx": ("hrsp_5xx", "bigint"),
}
BACKEND_FIELDS = {
    "rtime": ("rtime", "bigint"),
    "econ": ("econ", "bigint"),
    "dresp": ("dresp", "bigint"),
    "eresp": ("eresp", "bigint"),
    "qcur": ("qcur", "bigint"),
    "qtime": ("qtime", "bigint"),
    "wredis": ("wredis", "bigint"),
    "wretr": ("wretr", "bigint"),
    "hrsp_4xx": ("hrsp_4xx", "bigint"),
    "hrsp_5xx": ("hrsp_5xx", "bigint"),
}


def _stat(name: str, kind: str) -> Column:
    return F.try_element_at(F.col("stats"), F.lit(name)).try_cast(kind)


def proxy_frontends(stats: DataFrame) -> DataFrame:
    rows = stats.filter(F.col("svname") == "FRONTEND")
    out = {n: _stat(src, kind) for n, (src, kind) in FRONTEND_FIELDS.items()}
    out["bin"] = _stat("bin", "double") / 1024
    out["bout"] = _stat("bout", "double") / 1024
    limit = F.nullif(_stat("slim", "double"), F.lit(0.0))
    out["sutil"] = _stat("scur", "double") / limit * 100
    return rows.withColumns(out).drop("stats", "_corrupt")


def proxy_backends(stats: DataFrame) -> DataFrame:
    rows = stats.filter(F.col("svname") == "BACKEND")
    return rows.withColumns({n: _stat(src, kind) for n, (src, kind) in BACKEND_FIELDS.items()}).drop("stats", "_corrupt")


# ---------------------------------------------------------------- key: value

def parse_kv(
    df: DataFrame, group: Sequence[str], keymap: Mapping[str, tuple[str, str]], sep: str = ":"
) -> DataFrame:
    """``key: value`` lines to one row per group.

    ``keymap`` maps the key in the text to a column name and SQL type; unknown keys are dropped.
    """
    parts = F.split(F.col("value"), sep, 2)
    pairs = df.withColumns({"_k": F.trim(parts[0]), "_v": F.trim(F.try_element_at(parts, F.lit(2)))})
    known = pairs.filter(F.col("_k").isin(list(keymap)))
    return known.groupBy(*group).agg(
        *[F.max(F.when(F.col("_k") == k, F.col("_v"))).try_cast(t).alias(n) for k, (n, t) in keymap.items()]
    )


# ---------------------------------------------------------------- positional columns

def parse_columns(
    df: DataFrame,
    spec: Mapping[str, tuple[int, str]],
    keep: Column | None = None,
) -> DataFrame:
    """Whitespace-separated columns by 0-based position: ``{name: (position, SQL type)}``.

    Lines that fail ``keep`` (headers, blanks) are left out.
    """
    rows = df.filter(F.trim("value") != "")
    if keep is not None:
        rows = rows.filter(keep)
    rows = rows.withColumn("_w", _words())
    out = {n: F.try_element_at(F.col("_w"), F.lit(i + 1)).try_cast(t) for n, (i, t) in spec.items()}
    return rows.withColumns(out).drop("_w", "value")


def parse_process_table(df: DataFrame) -> DataFrame:
    """``pid user virt res shr cpu mem command`` lines; sizes in KB."""
    raw = parse_columns(
        df,
        {
            "pid": (0, "bigint"), "user": (1, "string"), "_virt": (2, "string"), "_res": (3, "string"),
            "_shr": (4, "string"), "cpu": (5, "double"), "memory": (6, "double"), "processname": (7, "string"),
        },
    )
    return raw.filter(F.col("pid").isNotNull()).withColumns(
        {
            "virtual_memory": size_to_kb("_virt"),
            "resident_memory": size_to_kb("_res"),
            "shared_memory": size_to_kb("_shr"),
        }
    ).drop("_virt", "_res", "_shr")


def parse_block_devices(
    df: DataFrame, part: Sequence[str], order: str = LINE_ORDER, rows_per_slice: int = 1_000_000
) -> DataFrame:
    """``name type size [mount]`` lines, each with the disk it belongs to; swap devices are left out.

    A partition belongs to the disk line above it.
    """
    raw = parse_columns(df, {"name": (0, "string"), "type": (1, "string"), "_size": (2, "double"), "_mount": (3, "string")})
    raw = raw.withColumn("_disk", F.when(F.col("type") == "disk", F.col("name")))
    rows = carry_forward(raw, part, order, "_disk", names={"_disk": "disk"}, rows_per_slice=rows_per_slice)
    rows = rows.withColumns(
        {"capacity": F.round(F.col("_size") / 1073741824.0, 2), "mountpoint": F.coalesce("_mount", F.lit(""))}
    )
    return rows.filter(~F.col("mountpoint").contains("SWAP")).drop("_size", "_mount", "_disk")


def parse_disk_counters(df: DataFrame, sector: int = 512) -> DataFrame:
    """Disk counter lines of 15, 14 or 7 fields (old, disk and partition form)."""
    rows = df.withColumn("_w", _words()).withColumn("_n", F.size("_w"))
    rows = rows.filter(F.col("_n").isin(15, 14, 7))
    n, w = F.col("_n"), F.col("_w")

    def pick(old: int | None, disk: int | None, part: int | None) -> Column:
        def at(i):
            return F.lit(0).cast("bigint") if i is None else w[i].try_cast("bigint")

        return F.when(n == 15, at(old)).when(n == 14, at(disk)).otherwise(at(part))

    out = {
        "name": F.when(n == 15, w[3]).otherwise(w[2]),
        "read_count": pick(2, 3, 3),
        "write_count": pick(7, 7, 5),
        "_rsector": pick(5, 5, 4),
        "_wsector": pick(9, 9, 6),
        "read_time": pick(6, 6, None),
        "write_time": pick(10, 10, None),
    }
    rows = rows.withColumns(out)
    return rows.withColumns(
        {"read_bytes": F.col("_rsector") * sector, "write_bytes": F.col("_wsector") * sector}
    ).drop("_w", "_n", "_rsector", "_wsector", "value")


def parse_io_table(df: DataFrame) -> DataFrame:
    """Extended device statistics: device and average queue size; header lines are skipped."""
    return parse_columns(
        df, {"name": (0, "string"), "avg_queue_size": (8, "double")}, ~F.col("value").rlike("^(Linux|Device)")
    ).filter(F.col("avg_queue_size").isNotNull())


def parse_tcp_counters(df: DataFrame) -> DataFrame:
    """Retransmits and resets from the value line of the ``Tcp:`` pair."""
    keep = F.col("value").rlike(r"^Tcp: -?\d")
    return parse_columns(
        df, {"resets_received": (8, "bigint"), "retransmits": (12, "bigint"), "resets_sent": (14, "bigint")}, keep
    )


def parse_stub_status(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """The four-line web server status, one row per group."""
    v = F.col("value")
    numbers = v.rlike(r"^\s*\d+\s+\d+\s+\d+\s*$")
    triple = r"^\s*(\d+)\s+(\d+)\s+(\d+)"

    def first(cond: Column, pattern: str, i: int) -> Column:
        return F.max(F.when(cond, F.regexp_extract(v, pattern, i).try_cast("bigint")))

    active, rww = v.startswith("Active"), v.startswith("Reading")
    return df.groupBy(*group).agg(
        first(active, r"(\d+)", 1).alias("activeConnections"),
        first(numbers, triple, 1).alias("accepts"),
        first(numbers, triple, 2).alias("handled"),
        first(numbers, triple, 3).alias("requests"),
        first(rww, r"Reading: (\d+)", 1).alias("activeReading"),
        first(rww, r"Writing: (\d+)", 1).alias("activeWriting"),
        first(rww, r"Waiting: (\d+)", 1).alias("activeWaiting"),
    )


def parse_consumer_groups(df: DataFrame) -> DataFrame:
    """Consumer group lines; headers and consumers without a client (``-``) are left out."""
    rows = parse_columns(
        df,
        {
            "topic": (0, "string"), "partition": (1, "int"), "currentOffset": (2, "bigint"),
            "logEndOffset": (3, "bigint"), "lag": (4, "bigint"), "consumerId": (5, "string"),
            "clientId": (6, "string"),
        },
    )
    return rows.filter(F.col("partition").isNotNull() & (F.col("clientId") != "-"))


def parse_gc_table(df: DataFrame) -> DataFrame:
    """Heap and garbage-collection table: heap use sums the used columns it can read."""
    spec = {
        "_s0u": (2, "double"), "_s1u": (3, "double"), "_eu": (5, "double"), "_ou": (7, "double"),
        "_ccsu": (11, "double"), "ygc": (12, "double"), "ygct": (13, "double"), "fgc": (14, "bigint"),
        "fgct": (15, "double"), "gct": (16, "double"),
    }
    rows = parse_columns(df, spec, F.col("value").rlike(r"^\s*[\d-]"))
    used = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in ("_s1u", "_eu", "_ou", "_ccsu")), F.coalesce(F.col("_s0u"), F.lit(0.0)))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("ygc", "ygct", "fgc", "fgct", "gct")}
    return rows.withColumns({"heapUsage": used, **zero}).drop("_s0u", "_s1u", "_eu", "_ou", "_ccsu")


def parse_cpuinfo(df: DataFrame) -> DataFrame:
    """``key : value`` lines of the CPU listing as ``key`` and ``value`` columns."""
    parts = F.split(F.col("value"), r"\s*:\s*", 2)
    rows = df.withColumns({"_k": F.trim(parts[0]), "_v": F.trim(F.try_element_at(parts, F.lit(2)))})
    return rows.filter(F.col("_v").isNotNull()).drop("value").withColumnsRenamed({"_k": "key", "_v": "value"})


# ---------------------------------------------------------------- benchmark-run logs

def parse_bench_log(
    df: DataFrame, part: Sequence[str] = ("runId",), order: str = LINE_ORDER, rows_per_slice: int = 1_000_000
) -> DataFrame:
    """Transaction counts by group and phase from the measurement section of a run log.

    Section and transaction headers are carried down to the ``Group n: [a][b]`` lines.
    """
    v = F.col("value")
    section = F.when(v.startswith("Measurement Interval Data"), F.lit("on")).when(
        v.startswith("==============="), F.lit("off")
    )
    header = F.regexp_extract(v, r"^([A-Z][a-z]+-[A-Z][a-z]+)", 1)
    marked = df.withColumns({"_section": section, "transactionName": F.when(header != "", header)})
    rows = carry_forward(marked, part, order, ["_section", "transactionName"], rows_per_slice=rows_per_slice)
    groups = rows.filter((F.col("_section") == "on") & v.rlike(r"^Group [1-4]\b"))
    counts = F.regexp_extract_all(v, F.lit(r"\[(.*?)\]"), 1)
    out = groups.withColumn("_group", F.regexp_extract(v, r"^Group (\d)", 1).cast("int"))
    keep = [c for c in df.columns if c not in ("value", order)]
    out = out.select(*keep, "transactionName", "_group", F.posexplode(counts).alias("_p", "_c"))
    return out.select(
        *keep,
        "transactionName",
        F.col("_group").alias("group"),
        (F.col("_p") + 1).alias("phase"),
        F.trim("_c").try_cast("bigint").alias("transactionCount"),
        F.concat(F.lit("G"), F.col("_group").cast("string"), F.lit("P"), (F.col("_p") + 1).cast("string")).alias(
            "uniqueId"
        ),
    )


def parse_throughput(
    df: DataFrame,
    part: Sequence[str] = ("runId",),
    order: str = LINE_ORDER,
    tiles: int | str = 1,
    tiebreak: Sequence[str] = (),
    rows_per_slice: int = 1_000_000,
) -> DataFrame:
    """Measured throughput lines ``status: x[i] = 1,234.5, min = .., max = ..`` numbered by position.

    ``combined`` lines are labelled and do not advance the numbering.
    """
    v = F.col("value")
    section = F.when(v.contains("Measured Throughput Data"), F.lit("on")).when(v.startswith("=============="), F.lit("off"))
    sliced = slice_groups(df, part, order, rows_per_slice, tiebreak=tiebreak)
    rows = carry_forward(sliced.withColumn("_section", section), part, order, "_section", tiebreak)
    number = r"([\d,]+\.?\d*)"
    combined = v.contains("combined")

    def num(label: str) -> Column:
        pattern = rf"=\s*{number}" if label == "actual" else rf"{label}\s*=\s*{number}"
        return F.translate(F.regexp_extract(v, pattern, 1), ",", "").try_cast("double")

    data = rows.filter((combined | (F.col("_section") == "on")) & v.rlike(r":.*="))
    data = data.withColumns(
        {
            "status": F.trim(F.split(v, ":")[0]),
            "_tile": F.regexp_extract(v, r"\[\s*(\d+)\s*\]", 1).try_cast("int") + 1,
            "actual": num("actual"),
            "min": num("min"),
            "max": num("max"),
            "_combined": combined,
        }
    )
    shown = [*part, "status", "actual", "min", "max"]
    counted = drop_slices(number_groups(data.filter(~F.col("_combined")), order, 4, tiles, part, tiebreak))
    counted = counted.select(
        *shown,
        F.col("_tile").cast("string").alias("tile"),
        F.col("group").cast("string").alias("group"),
        F.col("phase").cast("string").alias("phase"),
        F.concat(
            F.lit("T"), F.col("_tile").cast("string"), F.lit("G"), F.col("group").cast("string"), F.lit("P"),
            F.col("phase").cast("string"),
        ).alias("uniqueId"),
    )
    whole = data.filter("_combined").select(
        *shown,
        *[F.lit("combined").alias(c) for c in ("tile", "group", "phase")],
        F.concat(F.col(part[0]).cast("string"), F.lit("_Over All")).alias("uniqueId"),
    )
    return counted.unionByName(whole)


