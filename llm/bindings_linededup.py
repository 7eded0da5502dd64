"""Query of the line dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .linededup import dedup_lines
from .registry import query


@query("op7_line_dedup")
def op7_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select(
        "doc_id", "lines_dropped", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), "text"
    )
