"""Query of the document fingerprints."""

from __future__ import annotations

from .common import table
from .iblt import fingerprints
from .registry import query


@query("op5_iblt_fingerprints")
def op5_iblt_fingerprints(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))
