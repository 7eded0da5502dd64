"""Query of the mixing."""

from __future__ import annotations

from .common import table
from .mixing import mix_by_weight
from .registry import query


@query("op3_mix_sources")
def op3_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_by_weight(docs).select("doc_id", "size", "source_size", "target", "taken")
