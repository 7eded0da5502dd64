"""Small helpers shared by the tests."""

from datetime import datetime, timedelta, timezone

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def rows(df, *cols):
    """Rows as plain tuples, sorted, NULLs first."""
    out = [tuple(r) for r in (df.select(*cols) if cols else df).collect()]
    return sorted(out, key=lambda t: tuple((x is not None, str(type(x)), x) if not isinstance(x, (dict, list)) else (True, "", str(x)) for x in t))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
