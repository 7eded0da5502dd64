"""Filters, renames, defaults, flattening and pivots of metric documents."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import camel_case

ANY = "*"


def add_date_parts(df: DataFrame, time: str) -> DataFrame:
    """``year``, ``month`` and ``day`` of an event time (a top-level or nested column)."""
    t = F.col(time)
    return df.withColumns({"year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t)})


def keep_types(df: DataFrame, types: Sequence[str], col: str = "_documentType") -> DataFrame:
    return df.filter(F.col(col).isin(list(types)))


def keep_states(df: DataFrame, states: Sequence[str], col: str = "status") -> DataFrame:
    return df.filter(F.col(col).isin(list(states)))


def with_tags(df: DataFrame, **tags) -> DataFrame:
    """Add constant columns; an added field wins over one already there."""
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in tags.items()})


def fill_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Default for NULL, absent and (text) blank values."""
    out = {}
    for name, value in defaults.items():
        if name not in df.columns:
            out[name] = F.lit(value)
            continue
        col = F.col(name)
        if isinstance(df.schema[name].dataType, T.StringType):
            col = F.nullif(F.trim(col), F.lit(""))
        out[name] = F.coalesce(col, F.lit(value))
    return df.withColumns(out)


def rename_keys(df: DataFrame, mapping: Mapping[str, str] | Callable[[str], str]) -> DataFrame:
    """Rename columns by a map or by a rule applied to every name."""
    if callable(mapping):
        mapping = {c: mapping(c) for c in df.columns}
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def rename_map_keys(df: DataFrame, col: str, rule: Callable[[Column], Column] = camel_case) -> DataFrame:
    """Apply a naming rule to the keys of a map column."""
    entries = F.transform(F.map_entries(col), lambda e: F.struct(rule(e["key"]).alias("k"), e["value"].alias("v")))
    return df.withColumn(col, last_wins_map(entries))


def last_wins_map(entries: Column) -> Column:
    """Map of an array of ``(k, v)`` structs; of entries with one key the last counts, and entries
    without a key are left out (Spark's own constructors raise on both).

    Only where a key does repeat is the last entry of each looked up."""

    def settled(named: Column) -> Column:
        keys = F.transform(named, lambda e: e["k"])
        once = F.array_distinct(keys)
        last = F.transform(once, lambda k: F.try_element_at(F.filter(named, lambda e: e["k"] == k), F.lit(-1))["v"])
        plain = F.map_from_arrays(keys, F.transform(named, lambda e: e["v"]))
        return F.when(F.size(once) == F.size(keys), plain).otherwise(F.map_from_arrays(once, last))

    # an array of one element, so that the entries are worked out once
    named = F.filter(entries, lambda e: e["k"].isNotNull())
    return F.get(F.transform(F.filter(F.array(named), lambda n: n.isNotNull()), settled), F.lit(0))


def drop_fields(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def metric_name(group: str, key: str) -> str:
    """``shuffleReadMetrics`` + ``recordsRead`` to ``shuffleReadRecordsRead``."""
    return group.replace("Metrics", "") + key[:1].upper() + key[1:]


def prefixed_name(group: str, key: str) -> str:
    """``executorLogs`` + ``stdout`` to ``executorLogsStdout``."""
    return group + key.capitalize()


def plain_name(group: str, key: str) -> str:
    return key


def flatten_struct(
    df: DataFrame,
    col: str,
    rule: Callable[[str, str], str] = metric_name,
    keys: Sequence[str] | None = None,
) -> DataFrame:
    """Lift the fields of a struct, and of structs inside it, to columns named by ``rule``.

    Plain fields keep their name. A MAP column is lifted too; its wanted ``keys``
    must be given because they are data, not schema.
    """
    kind = df.schema[col].dataType
    lifted: dict[str, Column] = {}
    if isinstance(kind, T.MapType):
        for key in keys or ():
            lifted[rule(col, key)] = F.try_element_at(F.col(col), F.lit(key))
    else:
        for field in kind.fields:
            inner = F.col(col)[field.name]
            if isinstance(field.dataType, T.StructType):
                for sub in field.dataType.fields:
                    lifted[rule(field.name, sub.name)] = inner[sub.name]
            else:
                lifted[field.name] = inner
    return df.withColumns(lifted).drop(col)


def typed_text(col: Column) -> Column:
    """A text value as ``struct(i BIGINT, d DOUBLE, s STRING)``: the first type that fits, others NULL."""
    i, d = col.try_cast("bigint"), col.try_cast("double")
    return F.struct(
        i.alias("i"), F.when(i.isNull(), d).alias("d"), F.when(i.isNull() & d.isNull(), col).alias("s")
    )


def accumulator_name(col: Column) -> Column:
    """``internal.metrics.shuffle.read.recordsRead`` to ``shuffleReadRecordsRead``; undotted gives NULL."""
    parts = F.split(col, r"\.")
    rest = F.transform(
        F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))),
        lambda x: F.concat(F.upper(F.substring(x, 1, 1)), x.substr(F.lit(2), F.length(x))),
    )
    return F.when(F.size(parts) > 2, F.concat(F.try_element_at(parts, F.lit(3)), F.array_join(rest, "")))


def _last_named(entries: str, name: str) -> Column:
    """Value of the last (k, v) entry of a name, NULL without one."""
    hits = F.filter(F.col(entries), lambda x: x["k"] == F.lit(name))
    return F.try_element_at(hits, F.lit(-1))["v"]


def name_values_to_columns(
    df: DataFrame, arr: str, names: Mapping[str, str], rename: Callable[[Column], Column] = accumulator_name
) -> DataFrame:
    """An array of ``(name, value)`` structs to typed columns, row by row (no shuffle).

    ``names`` maps wanted (renamed) names to SQL types; values that do not parse give NULL.
    """
    entries = F.filter(
        F.transform(F.col(arr), lambda x: F.struct(rename(x["name"]).alias("k"), x["value"].alias("v"))),
        lambda x: x["k"].isNotNull(),
    )
    out = {}
    for name, kind in names.items():
        out[name] = _last_named("_entries", name).try_cast(kind)
    return df.withColumn("_entries", entries).withColumns(out).drop("_entries", arr)


def counters_to_map(groups: Column, suffix: str = "") -> Column:
    """Counter groups (array of structs with a ``counts`` array of name, value) to one map.

    A name that occurs again, in another group or folded to the same camel case, wins.
    """
    flat = F.flatten(F.filter(F.transform(groups, lambda g: g["counts"]), lambda c: c.isNotNull()))
    entries = F.transform(flat, lambda c: F.struct(F.concat(camel_case(c["name"]), F.lit(suffix)).alias("k"), c["value"].alias("v")))
    return last_wins_map(entries)


def counters_to_columns(
    df: DataFrame, groups: str, names: Sequence[str], suffix: str = ""
) -> DataFrame:
    """Named counters of nested counter groups as columns, row by row (no shuffle)."""
    flat = F.flatten(F.filter(F.transform(F.col(groups), lambda g: g["counts"]), lambda c: c.isNotNull()))
    named = F.transform(flat, lambda c: F.struct(camel_case(c["name"]).alias("k"), c["value"].alias("v")))
    out = {}
    for name in names:
        out[f"{name}{suffix}"] = _last_named("_counters", name)
    return df.withColumn("_counters", named).withColumns(out).drop("_counters")


def rows_to_columns(
    df: DataFrame, ids: Sequence[str], key: str, value: str, names: Sequence[str]
) -> DataFrame:
    """Key/value rows to one wide row per id; keys are matched in upper case."""
    return df.groupBy(*ids).agg(
        *[F.max(F.when(F.upper(F.col(key)) == n.upper(), F.col(value))).alias(n.upper()) for n in names]
    )


def or_placeholder(df: DataFrame, *others: DataFrame) -> DataFrame:
    """The rows of ``df``, or one all-NULL row when it and all ``others`` are empty."""
    spark = df.sparkSession
    seen = df.limit(1).select(F.lit(1).alias("_x"))
    for other in others:
        seen = seen.unionByName(other.limit(1).select(F.lit(1).alias("_x")))
    empty = spark.range(1).select(
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    )
    missing = seen.agg(F.count(F.lit(1)).alias("n")).scalar() == 0
    return df.unionByName(empty.filter(missing))
