"""Query of the n-gram Jaccard join."""

from __future__ import annotations

from .common import table
from .neardup import jaccard_classes
from .registry import query


@query("op6_ngram_jaccard_join")
def op6_ngram_jaccard_join(spark, sf_dir):
    return jaccard_classes(table(spark, sf_dir, "documents")).drop("k")
