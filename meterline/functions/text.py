"""Text, naming, decoding and banding column helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


# URL rules (guard, what to replace, replacement); the first guard that matches applies.
URL_RULES = [
    (r"^http://[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+[: ][0-9]*/opportunity/[0-9]+", "/opportunity/[0-9]+", "/opportunity/[id]"),
    (r"^http://[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+[: ][0-9]*/userDetails/[0-9]+", "/userDetails/[0-9]+", "/userDetails/[id]"),
]

# Memory pool name fragments in matching order.
MEMORY_POOLS = [
    ("Tenured", "TenuredGen"),
    ("Old", "OldGen"),
    ("CompressedClass", "CompClass"),
    ("Metaspace", "Metaspace"),
    ("Survivor", "Survivor"),
    ("CodeCache", "CodeCache"),
    ("Eden", "Eden"),
]

# Utilisation bands, each (label, upper edge); edges belong to the lower band.
CPU_BANDS = [("low", 10.0), ("med", 40.0), ("high", 100.0)]


def in_state(col, states: Sequence) -> Column:
    return _col(col).isin(list(states))


def exclude(col, names: Sequence) -> Column:
    """Keep rows whose value is not one of the system names; NULL is kept."""
    c = _col(col)
    return c.isNull() | ~c.isin(list(names))


def decode(col, mapping: Mapping, other="Unknown") -> Column:
    """Code to label; codes outside the mapping (and NULL) give ``other``."""
    c = _col(col)
    out = None
    for code, label in mapping.items():
        out = F.when(c == F.lit(code), F.lit(label)) if out is None else out.when(c == F.lit(code), F.lit(label))
    return F.lit(other) if out is None else out.otherwise(F.lit(other))


def band(col, edges: Sequence[tuple[str, float]] = tuple(CPU_BANDS), low: float = 0.0) -> Column:
    """Label of the first band whose upper edge is not exceeded; outside all bands NULL."""
    c = _col(col)
    out = F.when(c < low, F.lit(None).cast("string"))
    for label, upper in edges:
        out = out.when(c <= upper, F.lit(label))
    return out


def template_url(col, rules: Sequence[tuple[str, str, str]] = tuple(URL_RULES)) -> Column:
    """Replace the variable parts of a URL by the first rule whose guard matches."""
    c = _col(col)
    out = None
    for guard, pattern, replacement in rules:
        shown = F.regexp_replace(c, pattern, replacement)
        out = F.when(c.rlike(guard), shown) if out is None else out.when(c.rlike(guard), shown)
    return c if out is None else out.otherwise(c)


def camel_case(col, separator: str = "_") -> Column:
    """``HDFS_BYTES_READ`` to ``hdfsBytesRead``."""
    words = F.initcap(F.translate(F.lower(_col(col)), separator, " "))
    joined = F.regexp_replace(words, " ", "")
    return F.concat(F.lower(F.substring(joined, 1, 1)), joined.substr(F.lit(2), F.length(joined)))


def dotted_to_underscored(name: str) -> str:
    """``tag.Host`` to ``_tag_host`` (a column name, so plain Python)."""
    head, tail = name.split(".")[:2]
    return f"_{head}_{tail.lower()}"


def memory_pool_name(col) -> Column:
    """Canonical memory pool name: first fragment found in the space-free name."""
    name = F.regexp_replace(_col(col), r"\s+", "")
    out = None
    for fragment, label in MEMORY_POOLS:
        hit = name.contains(fragment)
        out = F.when(hit, F.lit(label)) if out is None else out.when(hit, F.lit(label))
    return out.otherwise(name)


def size_to_kb(col) -> Column:
    """``1.2g`` to kilobytes; a bare number is already kilobytes, other text gives NULL."""
    parts = r"^(\d+\.?\d*|\.\d+)([kmgt]?)$"
    c = F.trim(_col(col))
    number = F.regexp_extract(c, parts, 1).try_cast("double")
    # each letter of the row is 1024 times the one before; none counts as k
    place = F.greatest(F.instr(F.lit("kmgt"), F.regexp_extract(c, parts, 2)) - 1, F.lit(0))
    return number * F.pow(F.lit(1024.0), place)


def string_to_array(col, element: str = "string") -> Column:
    """JSON array held as text, escaped quotes removed first; other text gives NULL."""
    c = _col(col)
    return F.when(c.startswith("["), F.from_json(F.translate(c, "\\", ""), f"array<{element}>"))
