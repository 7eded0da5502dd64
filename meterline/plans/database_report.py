"""Database catalog snapshots: sizes by level, table statistics, sessions, server status."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exclude, hit_ratio, to_unit
from ..operators.aggregates import rollup_sizes
from ..operators.counters import counter_delta
from ..operators.joins import enrich
from ..operators.ordering import by_size, long_running
from ..operators.projections import fill_defaults, rows_to_columns

# Schemas that belong to the database server itself.
SYSTEM_SCHEMAS = ["information_schema", "mysql", "performance_schema"]
TABLE_IO = ("heapBlksRead", "heapBlksHit", "idxBlksRead", "idxBlksHit")
TABLE_STATS = ("seqScan", "seqScanFetch", "indexScan", "indexScanFetch", "numInsert", "numDelete", "numUpdate")


def database_sizes(
    tables: DataFrame,
    levels: Sequence[str] = ("server", "_dbName", "_tableName"),
    sizes: Sequence[str] = ("tableSize", "indexSize", "dataFree"),
) -> DataFrame:
    """Sizes in MB per table, database and server; system schemas are left out.

    Bytes are summed first and rounded once.
    """
    mine = tables.filter(exclude(levels[1], SYSTEM_SCHEMAS))
    filled = fill_defaults(mine, {s: 0 for s in sizes})
    out = rollup_sizes(filled, levels, sizes)
    return out.withColumns({s: to_unit(s, "MB") for s in sizes})


def server_status(status: DataFrame, ids: Sequence[str], names: Sequence[str]) -> DataFrame:
    """``VARIABLE_NAME``/``VARIABLE_VALUE`` rows of each server and poll as one wide numeric row."""
    wide = rows_to_columns(status, ids, "VARIABLE_NAME", "VARIABLE_VALUE", names)
    return wide.withColumns({n.upper(): F.col(n.upper()).try_cast("bigint") for n in names})


def table_report(
    io: DataFrame,
    stats: DataFrame,
    keys: Sequence[str] = ("server", "_dbName", "_tableName"),
    time: str = "time",
) -> DataFrame:
    """Table I/O joined with table statistics per poll: deltas and hit ratios.

    Absent index counters are 0; tables on one side only are left out.
    """
    both = enrich(io, stats, [*keys, time], "inner")
    cols = [c for c in (*TABLE_IO, *TABLE_STATS) if c in both.columns]
    filled = fill_defaults(both, {c: 0 for c in cols})
    out = counter_delta(filled, keys, time, cols, first="drop", suffix="")
    ratios = {}
    if {"heapBlksHit", "heapBlksRead"} <= set(cols):
        ratios["cacheHitRatio"] = hit_ratio("heapBlksHit", "heapBlksRead")
    if {"idxBlksHit", "idxBlksRead"} <= set(cols):
        ratios["indexHitRatio"] = hit_ratio("idxBlksHit", "idxBlksRead")
    return out.withColumns(ratios) if ratios else out


def overall_hit_ratio(io: DataFrame, group: Sequence[str], hit: str, miss: str, name: str = "ratio") -> DataFrame:
    """Hits over all traffic of a group's cumulative counters, 0 when there was none."""
    sums = io.groupBy(*group).agg(F.sum(hit).alias("_hit"), F.sum(miss).alias("_miss"))
    return sums.withColumn(name, hit_ratio("_hit", "_miss", digits=15)).drop("_hit", "_miss")


def long_queries(sessions: DataFrame, min_runtime: Column | None = None, n: int = 20) -> DataFrame:
    """The longest-running active sessions over 250 ms; ``runtime`` is an interval."""
    limit = F.expr("INTERVAL '0 00:00:00.25' DAY TO SECOND") if min_runtime is None else min_runtime
    return long_running(sessions, limit, n)


def largest_tables(tables: DataFrame, size: str = "tableSize") -> DataFrame:
    return by_size(tables, size)
