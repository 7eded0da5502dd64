"""Query of the WARC archives."""

from __future__ import annotations

from meterline.session import scratch_path

from .common import stored, table
from .registry import query
from .warc import captures_of, read_archives, write_archives

_DIGEST = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, {5 * g + 1}, 5) AS INTEGER) >> {s}) & 31) + 1, 1)"
    for g in range(8)
    for s in (15, 10, 5, 0)
)
WARC_SQL = f"""
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), digests AS (
  SELECT page_id, payload_bytes, {_DIGEST} AS payload_digest FROM payloads
), tops AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM digests
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM tops
"""


@query("op2_warc_transactions", WARC_SQL)
def op2_warc_transactions(spark, sf_dir):
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    return captures_of(stored(read_archives(spark, path, payload=False), "records"))
