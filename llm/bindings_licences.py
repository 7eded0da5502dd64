"""Query of the licence scan."""

from __future__ import annotations

from .common import table
from .licences import scan_licences
from .registry import query


@query("op10_licence_scan")
def op10_licence_scan(spark, sf_dir):
    return scan_licences(table(spark, sf_dir, "documents"))
