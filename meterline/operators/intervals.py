"""Interval analytics: merged paths, scheduling delay, stragglers, wait time, concurrency.

Endpoints are whole epoch seconds, so groups are first collapsed to one row per
distinct second (map-side combined). What is then worked through in order is cut into
slices where a group is long (``slices.prefix_scan``), so no group is one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .slices import (
    ROWS_PER_SLICE, WIDTH, drop_slices, highest, prefix_scan, running_total, same_keys, slice_groups, total, with_next,
)


def critical_path(
    df: DataFrame, group: Sequence[str], start: str, end: str, min_rows: int = 1, rows_per_slice: int = ROWS_PER_SLICE
) -> DataFrame:
    """Merge overlapping or touching intervals of each group.

    A group with fewer than ``min_rows`` rows, or with any endpoint NULL or <= 0,
    has no path.

    Two scans along the starts: how far the intervals before reach (a running maximum), and how
    many intervals up to here open a new stretch (a running sum). Both carry over the borders
    of slices, so a stretch may span any number of them.
    """
    unusable = F.coalesce((F.col(start) <= 0) | (F.col(end) <= 0), F.lit(True))
    seconds = df.groupBy(*group, start).agg(
        F.max(end).alias("_end"),
        F.count(F.lit(1)).alias("_n"),
        F.max(unusable.cast("int")).alias("_bad"),
    )
    sliced = slice_groups(seconds, group, start, rows_per_slice)
    reached = prefix_scan(
        sliced, group, start,
        {
            "_reach": highest(F.col("_end"), "before"),
            "_rows": total(F.col("_n"), "whole"),
            "_void": highest(F.col("_bad"), "whole"),
        },
    ).filter((F.col("_rows") >= min_rows) & (F.col("_void") == 0))
    opens = F.coalesce((F.col(start) > F.col("_reach")).cast("int"), F.lit(1))
    islands = prefix_scan(reached, group, start, {"_island": total(opens)})
    return (
        drop_slices(islands)
        .groupBy(*group, "_island")
        .agg(F.min(start).alias(start), F.max("_end").alias(end))
        .drop("_island")
    )


def path_length(
    df: DataFrame, group: Sequence[str], start: str, end: str, min_rows: int = 1, name: str = "busy",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Total length of the merged intervals per group."""
    path = critical_path(df, group, start, end, min_rows, rows_per_slice)
    return path.groupBy(*group).agg(F.sum(F.col(end) - F.col(start)).alias(name))


def scheduling_delay(
    parents: DataFrame,
    children: DataFrame,
    group: Sequence[str],
    p_start: str,
    p_end: str,
    c_start: str,
    c_end: str,
    min_rows: int = 1,
    skip_open: bool = True,
    name: str = "scheduling_delay",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Wall time of the parent not covered by its children.

    0 unless both the wall time and the covered time are positive. ``skip_open``
    leaves out children without both endpoints before the path is built; without it
    such a child voids the path of its parent.
    """
    usable = children
    if skip_open:
        usable = children.filter(F.col(c_start).isNotNull() & F.col(c_end).isNotNull())
    names = [f"_g{i}" for i in range(len(group))]
    busy = path_length(usable, group, c_start, c_end, min_rows, "_busy", rows_per_slice)
    busy = busy.select(*[F.col(g).alias(n) for g, n in zip(group, names)], "_busy")
    wall = F.col(p_end) - F.col(p_start)
    delay = F.when((wall > 0) & (F.col("_busy") > 0), wall - F.col("_busy")).otherwise(F.lit(0))
    return parents.join(busy, same_keys(group, names), "left").withColumn(name, delay).drop(*names, "_busy")


def durations(df: DataFrame, submit: str, start: str, end: str) -> DataFrame:
    """``elapsedTime``, ``runTime`` and ``schedulingDelay``; NULL where an endpoint is missing or <= 0."""

    def gap(late: str, early: str) -> Column:
        return F.when((F.col(late) > 0) & (F.col(early) > 0), F.col(late) - F.col(early))

    return df.withColumns(
        {"elapsedTime": gap(end, submit), "runTime": gap(end, start), "schedulingDelay": gap(start, submit)}
    )


def interp_percentile(col, p) -> Column:
    """Exact percentile with linear interpolation, position ``(n - 1) * p``."""
    return F.percentile(col, p)


def group_percentiles(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    points: Mapping[str, float],
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Exact interpolated percentiles per group.

    Equal values are counted first, map-side, so all that follows works on one row per group and
    distinct value. A group with more of these than one task should hold is cut into slices by
    value; running counts then find the values at the wanted positions.
    """
    known = df.select(*group, value).filter(F.col(value).isNotNull())
    counted = known.groupBy(*group, value).agg(F.count(F.lit(1)).alias("_n"))
    sliced = slice_groups(counted, group, value, rows_per_slice)
    ps = F.array(*[F.lit(float(p)) for p in points.values()])
    plain = sliced.filter(F.col(WIDTH).isNull()).groupBy(*group).agg(F.percentile(value, ps, F.col("_n")).alias("_p"))
    plain = plain.select(*group, *[F.col("_p")[i].alias(n) for i, n in enumerate(points)])

    large = sliced.filter(F.col(WIDTH).isNotNull())
    names = [f"_g{i}" for i in range(len(group))]
    # one row per sliced group; slice_groups bounds how many there are
    totals = large.groupBy(*[F.col(g).alias(n) for g, n in zip(group, names)]).agg(F.sum("_n").alias("_all"))
    seen = running_total(large, group, value, F.col("_n"), name="_seen")
    seen = seen.join(F.broadcast(totals), same_keys(group, names))
    picks = []
    for i, p in enumerate(points.values()):
        at = (F.col("_all") - 1) * F.lit(float(p))
        picks.append(F.min(F.when(F.col("_seen") > F.floor(at), F.col(value))).alias(f"_low{i}"))
        picks.append(F.min(F.when(F.col("_seen") > F.ceil(at), F.col(value))).alias(f"_high{i}"))
    found = seen.groupBy(*group).agg(F.max("_all").alias("_all"), *picks)
    out = {}
    for i, (name, p) in enumerate(points.items()):
        at = (F.col("_all") - 1) * F.lit(float(p))
        low, high = F.col(f"_low{i}").cast("double"), F.col(f"_high{i}").cast("double")
        mixed = low * (F.ceil(at) - at) + high * (at - F.floor(at))
        out[name] = F.when(F.floor(at) == F.ceil(at), low).otherwise(mixed)
    return plain.unionByName(found.select(*group, *[c.alias(n) for n, c in out.items()]))


def flag_stragglers(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    name: str = "isStraggler",
    factor: float = 1.5,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """1 for rows above the upper fence ``q75 + 1.5 * (q75 - q25)`` of their group, else 0."""
    names = [f"_g{i}" for i in range(len(group))]
    quartiles = group_percentiles(df, group, value, {"_q25": 0.25, "_q75": 0.75}, rows_per_slice)
    fences = quartiles.select(
        *[F.col(g).alias(n) for g, n in zip(group, names)],
        (F.col("_q75") + F.lit(factor) * (F.col("_q75") - F.col("_q25"))).alias("_fence"),
    )
    flag = F.coalesce((F.col(value) > F.col("_fence")).cast("int"), F.lit(0))
    return df.join(fences, same_keys(group, names), "left").withColumn(name, flag).drop(*names, "_fence")


def wait_time(
    jobs: DataFrame,
    attempts: DataFrame,
    reduce_start_pct: int = 70,
    job: str = "jobId",
    name: str = "waitTime",
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """Time map and reduce attempts spent waiting, added to the jobs.

    Attempts carry ``type, startTime, finishTime, elapsedTime``; jobs carry
    ``submitTime, mapsTotal``. Attempts are collapsed to one row per job, type and
    finish second before the k-th map is looked up.
    """
    valid = attempts.filter((F.col("startTime") > 0) & (F.col("finishTime") > 0) & (F.col("elapsedTime") > 0))
    per_second = valid.groupBy(F.col(job).alias("_job"), F.col("type"), F.col("finishTime")).agg(
        F.count(F.lit(1)).alias("_n"), F.max("elapsedTime").alias("_elapsed")
    )
    ranked = prefix_scan(
        per_second, ["_job", "type"], "finishTime", {"_seen": total(F.col("_n")), "_all": total(F.col("_n"), "whole")},
        rows_per_slice=rows_per_slice,
    )
    k = F.ceil(F.col("_all") * F.lit(reduce_start_pct) / F.lit(100))
    is_map, is_reduce = F.col("type") == "MAP", F.col("type") == "REDUCE"
    per_job = ranked.groupBy("_job").agg(
        F.max(F.when(is_map, F.col("finishTime"))).alias("_m_finish"),
        F.max(F.when(is_map, F.col("_elapsed"))).alias("_m_elapsed"),
        F.max(F.when(is_reduce, F.col("finishTime"))).alias("_r_finish"),
        F.max(F.when(is_reduce, F.col("_elapsed"))).alias("_r_elapsed"),
        F.min(F.when(is_map & (F.col("_seen") >= k) & (k < F.col("_all")), F.col("finishTime"))).alias("_kth"),
    )
    submit = F.col("submitTime")
    map_wait = F.coalesce(F.col("_m_finish") - submit - F.col("_m_elapsed"), F.lit(0))
    reduce_from = (
        F.when(F.col("_m_finish").isNotNull(), F.col("_kth"))
        .when(F.col("mapsTotal") > 0, F.lit(None))
        .otherwise(submit)
    )
    reduce_wait = F.coalesce(F.col("_r_finish") - reduce_from - F.col("_r_elapsed"), F.lit(0))
    out = jobs.join(per_job, F.col(job) == F.col("_job"), "left").withColumn(name, map_wait + reduce_wait)
    return out.drop("_job", "_m_finish", "_m_elapsed", "_r_finish", "_r_elapsed", "_kth")


def even_step(lo: Column, hi: Column, points: int = 25, minimum: int = 5) -> Column:
    """Bucket width that gives about ``points`` buckets, never below ``minimum`` seconds."""
    return F.greatest(F.floor((hi - lo) / F.lit(points)), F.lit(minimum)).cast("bigint")


def concurrency(
    intervals: DataFrame,
    group: Sequence[str],
    start: str,
    end: str,
    step: int | str = 5,
    lo: str | None = None,
    hi: str | None = None,
    by: Mapping[str, Column] | None = None,
    rows_per_slice: int = ROWS_PER_SLICE,
) -> DataFrame:
    """How many intervals of each group overlap each time bucket.

    Buckets ``[x, x + step)`` run from ``lo`` to ``hi`` (columns that are constant in a
    group; the earliest start and latest end by default), the last one cut at ``hi + 1``.
    ``step`` is seconds, or ``"even"`` for about 25 buckets per group. ``by`` maps an
    output column to the condition its intervals must meet. Empty buckets give 0.

    Each interval contributes +1 where it begins and -1 after it ends; the running sum
    over buckets is the count. Two rows per interval, whatever its length.
    """
    by = by or {"task_count": F.lit(True)}
    rows = intervals
    if lo is None or hi is None:
        names = [f"_g{i}" for i in range(len(group))]
        spans = rows.groupBy(*[F.col(g).alias(n) for g, n in zip(group, names)]).agg(
            F.min(F.when(F.col(start) != 0, F.col(start))).alias("_min"), F.max(end).alias("_max")
        )
        rows = rows.join(spans, same_keys(group, names), "left").drop(*names)
    low = F.col(lo) if lo else F.col("_min")
    high = (F.col(hi) if hi else F.col("_max")) + 1
    width = even_step(low, high) if step == "even" else F.lit(int(step)).cast("bigint")
    rows = rows.withColumns({"_first_s": low, "_end_s": high, "_step_s": width})
    rows = rows.filter(F.col("_end_s") > F.col("_first_s")).withColumn(
        "_last_bucket", (F.ceil((F.col("_end_s") - F.col("_first_s")) / F.col("_step_s")) - 1).cast("bigint")
    )

    s, e = F.col(start), F.col(end)
    counted = (s != 0) & (e != 0)
    point = s == e
    overlaps = F.when(point, (s >= F.col("_first_s")) & (s <= F.col("_end_s"))).otherwise(
        (s < F.col("_end_s")) & (e > F.col("_first_s")) & (e > s)
    )
    first = F.floor((s - F.col("_first_s")) / F.col("_step_s"))
    on_edge = point & ((s - F.col("_first_s")) % F.col("_step_s") == 0)
    first = F.when(on_edge, first - 1).otherwise(first)
    last = F.when(point, F.floor((s - F.col("_first_s")) / F.col("_step_s"))).otherwise(
        F.floor((e - 1 - F.col("_first_s")) / F.col("_step_s"))
    )
    begin = F.greatest(first, F.lit(0)).cast("bigint")
    # a point exactly at the clipped end belongs to the last bucket
    begin = F.least(begin, F.col("_last_bucket"))
    stop = F.least(last, F.col("_last_bucket")).cast("bigint")
    live = F.coalesce(counted & overlaps, F.lit(False))

    one = {n: F.when(c & live, F.lit(1)).otherwise(F.lit(0)).alias(n) for n, c in by.items()}
    frame = [*group, "_first_s", "_end_s", "_step_s", "_last_bucket"]
    tagged = rows.select(*frame, begin.alias("_begin"), stop.alias("_stop"), live.alias("_live"), *one.values())
    edges = F.when(
        F.col("_live"),
        F.array(
            F.struct(F.col("_begin").alias("b"), F.lit(1).alias("sign")),
            F.struct((F.col("_stop") + 1).alias("b"), F.lit(-1).alias("sign")),
        ),
    ).otherwise(F.array(F.struct(F.lit(0).cast("bigint").alias("b"), F.lit(0).alias("sign"))))
    changes = (
        tagged.select(*frame, *by, F.explode(edges).alias("_edge"))
        .groupBy(*frame, F.col("_edge.b").alias("bucket"))
        .agg(*[F.sum(F.col(n) * F.col("_edge.sign")).alias(n) for n in by])
    )
    sliced = with_next(slice_groups(changes, frame, "bucket", rows_per_slice), frame, "bucket", "bucket")
    scans = {n: total(F.col(n)) for n in by} | {"_before": total(F.lit(1), "before")}
    levels = drop_slices(prefix_scan(sliced, frame, "bucket", scans)).withColumns(
        {
            "_next": F.coalesce(F.col("_next"), F.col("_last_bucket") + 1),
            "_from": F.when(F.col("_before").isNull(), F.lit(0)).otherwise(F.col("bucket")),
        }
    ).filter(F.col("bucket") <= F.col("_last_bucket"))
    # a level holds until the next change; before the first change it is 0
    out = levels.withColumnRenamed("bucket", "_changed").select(
        "*", F.explode(F.sequence(F.col("_from"), F.col("_next") - 1)).alias("bucket")
    )
    before = F.col("bucket") < F.col("_changed")
    out = out.withColumns({n: F.when(before, F.lit(0)).otherwise(F.col(n)) for n in by})
    b_start = F.col("_first_s") + F.col("bucket") * F.col("_step_s")
    return out.select(
        *group,
        b_start.alias("bucket_start"),
        F.least(b_start + F.col("_step_s"), F.col("_end_s")).alias("bucket_end"),
        *by,
    )


def concurrency_summary(points: DataFrame, group: Sequence[str], count: str = "task_count") -> DataFrame:
    """Lowest, highest and (truncated) mean count over the buckets of each group."""
    return points.groupBy(*group).agg(
        F.min(count).alias("minParallelTasks"),
        F.max(count).alias("maxParallelTasks"),
        F.floor(F.sum(count) / F.count(F.lit(1))).cast("bigint").alias("avgParallelTasks"),
    )
