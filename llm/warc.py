"""WARC archives: writing captures, reading records, assembling transactions.

Every capture is written as three records: the request, the response (or the revisit of an equal
payload) and a metadata record. Request and metadata name the capture's record in
``WARC-Concurrent-To``. Reading back gives one row per record; the assembly joins records through
these identifiers and emits one nested row per capture.

Files are written by Spark's text writer: a row is the records of a capture, and the line
separator is the empty line pair that ends a WARC record.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

END = "\r\n\r\n"
RECORDS_PER_FILE = 2000
CAPTURES = ("response", "revisit", "resource", "conversion")
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hexed: Column) -> Column:
    """Upper-case base32 of a hexadecimal SHA-1: four characters from each five digits. ``hexed`` is repeated in the
    expression, so it should be a column."""
    out = []
    for group in range(8):
        v = F.conv(F.substring(hexed, 5 * group + 1, 5), 16, 10).cast("int")
        out += [F.substr(F.lit(_BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts]), F.lit(">"))


def _record(kind: Column, record_id: Column, uri: Column, content_type: str, block: Column, date: str, *more: Column) -> Column:
    """Text of a record without its end; null header lines are left out."""
    lines = [
        F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id),
        F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), uri), *more, F.lit(f"Content-Type: {content_type}"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def write_archives(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
    least_revisit: int = 0, date: str = "2024-01-01T00:00:00Z",
) -> None:
    """Write gzip WARC files below ``path``.

    Of captures with equal payloads of at least ``least_revisit`` bytes, the one with the largest
    id (null smallest, then the largest url) is the response and the others revisit it; smaller
    payloads are always responses. A null body counts as empty. Rows that repeat id, url and body
    are one capture whose metadata says how many ``copies`` it stands for. A null url leaves
    the target out; line breaks in it are percent-encoded.
    """
    body = F.coalesce(F.col(body_col), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    # hexadecimal up to the shuffles: written out as base32, the SHA-1 would be taken of the body again for each character
    base = base.withColumns({"hexed": F.sha1(F.col("body").cast("binary")), "size": F.octet_length("body")})
    # payloads once each, copies combined before the shuffle; what is many per payload is narrow
    payloads = base.groupBy("hexed").agg(F.first("body").alias("body"), F.max(F.struct("id", "url")).alias("top"))
    captures = base.groupBy("id", "url", "hexed", "size").agg(F.count(F.lit(1)).alias("copies"))
    rows = captures.join(payloads, "hexed").withColumn("digest", base32(F.col("hexed")))
    is_top = F.struct("id", "url").eqNullSafe(F.col("top")) | (F.col("size") < least_revisit)
    kind = F.when(is_top, "response").otherwise("revisit")
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    own = _record_id(F.lit("capture"), F.col("id"), F.col("url"), F.col("digest"))
    first = _record_id(F.lit("capture"), F.col("top.id"), F.col("top.url"), F.col("digest"))
    to_own = F.concat(F.lit("WARC-Concurrent-To: "), own)
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END)
    )
    request = _record(
        F.lit("request"), _record_id(F.lit("request"), own), uri, "application/http; msgtype=request",
        F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1" + END)), date, to_own,
    )
    capture = _record(
        kind, own, uri, "application/http; msgtype=response", F.when(is_top, F.concat(head, "body")).otherwise(head), date,
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.when(~is_top, F.concat(F.lit("WARC-Refers-To: "), first)), F.when(~is_top, F.lit(f"WARC-Profile: {_PROFILE}")),
    )
    fields = F.concat_ws(
        "\r\n", F.concat(F.lit("page-id: "), F.col("id").cast("string")), F.concat(F.lit("copies: "), F.col("copies").cast("string")), F.lit("")
    )
    about = _record(F.lit("metadata"), _record_id(F.lit("metadata"), own), uri, "application/warc-fields", fields, date, to_own)
    text = rows.select(F.concat_ws(END, request, capture, about).alias("value"))
    text.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def records(content: bytes, path: str = "") -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Headers (names in lower case) and block of each record of a plain or gzip archive."""
    f = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while True:
        line = f.readline()
        while line in (b"\r\n", b"\n"):
            line = f.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one is due in {path}: {line[:60]!r}")
        headers = []
        while (line := f.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8").partition(":")
            headers.append((name.strip().lower(), value.strip()))
        length = int(dict(headers)["content-length"])
        block = f.read(length)
        if len(block) < length:
            raise ValueError(f"cut off record in {path}")
        yield headers, block


_RECORD = pa.schema([
    ("record_id", pa.string()), ("kind", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()),
    ("uri", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("size", pa.int64()),
    ("fields", pa.map_(pa.string(), pa.string())), ("body", pa.binary()),
])
_RECORD_SQL = (
    "record_id string, kind string, concurrent_to array<string>, refers_to string, uri string, date string, digest string, "
    "size long, fields map<string,string>, body binary"
)


def _parse(headers: list[tuple[str, str]], block: bytes, payload: bool) -> tuple:
    h = dict(headers)
    kind, body, fields = h.get("warc-type"), block, None
    if h.get("content-type", "").startswith("application/http"):
        _, _, body = block.partition(b"\r\n\r\n")
    if h.get("content-type", "").startswith("application/warc-fields"):
        pairs = (line.partition(":") for line in block.decode("utf-8").splitlines())
        fields = list({k.strip(): v.strip() for k, _, v in pairs if k.strip()}.items())
    if kind == "revisit":  # the payload lies with the record it refers to
        digest, size, body = h.get("warc-payload-digest", "").rpartition(":")[2] or None, None, None
    else:
        digest, size = base64.b32encode(hashlib.sha1(body).digest()).decode(), len(body)
    to = [v for k, v in headers if k == "warc-concurrent-to"]
    return (h.get("warc-record-id"), kind, to, h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), digest, size, fields,
            body if payload else None)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """One row per record of all files below ``path``; sizes and digests come from the payloads."""

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                out, held = [], 0
                for headers, block in records(content.as_py(), name):
                    out.append(_parse(headers, block, payload))
                    held += len(block) if payload else 0
                    if len(out) >= 5000 or held > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _RECORD.types, strict=True)], schema=_RECORD)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _RECORD.types, strict=True)], schema=_RECORD)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, _RECORD_SQL)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: its own record and the request and metadata records linked to it.

    A record belongs to a capture if either names the other in ``WARC-Concurrent-To``, or if it
    and a record that belongs to the capture do. Of several requests (or metadata records) the one
    with the smallest identifier is shown and ``n_requests`` (``n_metadata``) counts them; none
    gives null and 0. A record linked to several captures goes to the one with the smallest
    identifier. Records without an identifier are captures of their own.
    """
    is_capture = F.col("kind").isin(*CAPTURES)
    captures, others = found.filter(is_capture), found.filter(~is_capture & F.col("record_id").isNotNull())
    cids, oids = captures.select(F.col("record_id").alias("cid")), others.select(F.col("record_id").alias("oid"))
    from_other = others.select(F.col("record_id").alias("oid"), F.explode("concurrent_to").alias("to"))
    from_capture = captures.select(F.col("record_id").alias("cid"), F.explode("concurrent_to").alias("oid"))
    near = from_other.join(cids, F.col("to") == F.col("cid")).select("oid", "cid")
    near = near.unionByName(from_capture.join(oids, "oid").select("oid", "cid"))
    near = near.groupBy("oid").agg(F.min("cid").alias("cid"))
    ahead = from_other.join(near.select(F.col("oid").alias("to"), "cid"), "to").select("oid", "cid")
    back = from_other.join(near, "oid").select(F.col("to").alias("oid"), "cid").join(oids, "oid").select("oid", "cid")
    every = near.withColumn("hops", F.lit(1)).unionByName(ahead.unionByName(back).withColumn("hops", F.lit(2)))
    links = every.groupBy("oid").agg(F.min(F.struct("hops", "cid")).alias("best")).select("oid", F.col("best.cid").alias("cid"))
    linked = others.join(links, F.col("record_id") == F.col("oid"))
    show = F.struct("record_id", "uri", "date", "digest", "size", "fields", "body")
    # maps have no order: the smallest identifier picks the record to show
    parts = linked.groupBy("cid").agg(*[
        x for kind, name in (("request", "request"), ("metadata", "metadata")) for x in (
            F.min_by(show, F.when(F.col("kind") == kind, F.col("record_id"))).alias(f"{name}_"),
            F.count(F.when(F.col("kind") == kind, 1)).alias(f"n_{name}"),
        )
    ])
    joined = captures.join(parts, F.col("record_id") == F.col("cid"), "left")
    return joined.select(
        "record_id", "kind", "refers_to", "uri", "date", "digest", "size", "body",
        F.when(F.col("n_request") > 0, F.col("request_")).alias("request"), F.coalesce("n_request", F.lit(0)).alias("n_requests"),
        F.when(F.col("n_metadata") > 0, F.col("metadata_")).alias("metadata"), F.coalesce("n_metadata", F.lit(0)).alias("n_metadata"),
    )


def captures_of(found: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every row that was
    written: sizes of revisits come from the response they refer to."""
    whole = stored(assemble(found).select(
        "record_id", "kind", "refers_to", "digest", "size",
        F.col("metadata.fields")["page-id"].cast("long").alias("page_id"),
        F.coalesce(F.col("metadata.fields")["copies"].cast("long"), F.lit(1)).alias("copies"),
    ), "captures")
    target = whole.filter("kind <> 'revisit'").select(
        F.col("record_id").alias("refers_to"), F.col("page_id").alias("to_page"), F.col("size").alias("to_size")
    )
    rows = whole.join(target, "refers_to", "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select(
        "page_id", F.coalesce("size", "to_size").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"), F.col("to_page").alias("refers_to"),
    )
