"""Query of the toxicity scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .registry import query
from .toxicity import score_toxicity


@query("op13_toxicity")
def op13_toxicity(spark, sf_dir):
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out)
