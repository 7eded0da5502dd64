"""Arithmetic column helpers: units, ratios, percentages, guarded division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Divisor that takes the source unit to the named one.
UNIT_DIVISORS = {
    "KB": 1024.0,
    "MB": 1048576.0,
    "GB": 1073741824.0,
    "pages8k_to_MB": 128.0,
    "ms_to_s": 1000.0,
    "ns_to_s": 1e9,
    "s_to_h": 3600.0,
    "bytes_to_Mbit": 125000.0,
    "MB_decimal": 1e6,
}


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def to_unit(col, unit: str, digits: int | None = 2) -> Column:
    """Convert and round; NULL stays NULL."""
    out = _col(col).cast("double") / F.lit(UNIT_DIVISORS[unit])
    return out if digits is None else F.round(out, digits)


def guard_negative(col) -> Column:
    """Sentinel ``-1`` (and any negative) to NULL at the reader edge."""
    c = _col(col)
    return F.when(c >= 0, c)


def ratio(num, den, default=0) -> Column:
    """``num / den`` in double arithmetic; ``default`` when the divisor is zero."""
    n, d = _col(num).cast("double"), _col(den).cast("double")
    return F.when(d == 0, F.lit(default).cast("double")).otherwise(n / d)


def pct(part, limit, digits: int = 2) -> Column:
    """Percentage of a limit; a zero limit gives NULL."""
    p, w = _col(part).cast("double"), _col(limit).cast("double")
    return F.round(F.lit(100.0) * p / F.nullif(w, F.lit(0.0)), digits)


def hit_ratio(hit, miss, scale: int = 100, digits: int = 2, whole: bool = False) -> Column:
    """Hits over traffic; 0 when there was none. ``whole`` truncates to BIGINT."""
    h, m = _col(hit), _col(miss)
    total = h + m
    if whole:
        out = F.when(total == 0, F.lit(0)).otherwise(F.lit(scale) * h.cast("double") / total)
        return F.floor(out).cast("bigint")
    share = F.lit(float(scale)) * h.cast("double") / total.cast("double")
    return F.when(total == 0, F.lit(0.0)).otherwise(F.round(share, digits))


def mean_latency(dtime, dcount, digits: int | None = None) -> Column:
    """Time spent per operation in an interval; 0 when nothing happened."""
    t, n = _col(dtime).cast("double"), _col(dcount).cast("double")
    out = F.when(n == 0, F.lit(0.0)).otherwise(t / n)
    return out if digits is None else F.round(out, digits)


def to_int(col) -> Column:
    """Parse to BIGINT or NULL."""
    return _col(col).try_cast("bigint")


def to_double(col) -> Column:
    """Parse to DOUBLE or NULL."""
    return _col(col).try_cast("double")
