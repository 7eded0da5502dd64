"""Query of the language identification."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .langid import identify
from .registry import query


@query("op9_language_id")
def op9_language_id(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return identify(table(spark, sf_dir, "documents"), held_out)
