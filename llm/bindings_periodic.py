"""Query of the periodic runs."""

from __future__ import annotations

from .common import table
from .periodic import periodic_runs
from .registry import query


@query("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    return periodic_runs(table(spark, sf_dir, "documents"), plant=True)
