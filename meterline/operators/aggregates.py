"""Group aggregates: windows of counts, outcomes, ratios, totals, topology."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import epoch_seconds, ratio


def count_windows(df: DataFrame, time: str, width: str = "5 minutes") -> DataFrame:
    """Rows per tumbling, epoch-aligned window; empty windows do not appear."""
    counted = df.groupBy(F.window(F.col(time), width).alias("w")).agg(F.count(F.lit(1)).alias("count"))
    out = counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "count")
    return out.withColumn("timestamp", epoch_seconds("start"))


def pricing_summary(lineitem: DataFrame, cutoff: str = "1998-09-16") -> DataFrame:
    """Quantity and order count by return flag and line status up to a ship date."""
    return (
        lineitem.filter(F.col("l_shipdate") <= F.lit(cutoff).cast(lineitem.schema["l_shipdate"].dataType))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(F.sum("l_quantity").alias("sum_qty"), F.count(F.lit(1)).alias("count_order"))
        .orderBy("l_returnflag", "l_linestatus")
    )


def attempt_outcomes(attempts: DataFrame, job: str = "jobId") -> DataFrame:
    """Succeeded, failed and killed attempts by type, with truncated mean times of the successful ones."""

    def count_of(kind: str, state: str) -> Column:
        return F.count_if((F.col("type") == kind) & (F.col("state") == state))

    def mean_of(kind: str, col: str) -> Column:
        good = (F.col("type") == kind) & (F.col("state") == "SUCCEEDED")
        mean = F.sum(F.when(good, F.coalesce(F.col(col), F.lit(0)))) / F.count_if(good)
        return F.coalesce(F.when(F.count_if(good) > 0, mean).cast("bigint"), F.lit(0))

    return attempts.groupBy(job).agg(
        count_of("MAP", "SUCCEEDED").alias("successfulMapAttempts"),
        count_of("MAP", "FAILED").alias("failedMapAttempts"),
        count_of("MAP", "KILLED").alias("killedMapAttempts"),
        count_of("REDUCE", "SUCCEEDED").alias("successfulReduceAttempts"),
        count_of("REDUCE", "FAILED").alias("failedReduceAttempts"),
        count_of("REDUCE", "KILLED").alias("killedReduceAttempts"),
        mean_of("MAP", "elapsedTime").alias("avgMapTime"),
        mean_of("REDUCE", "elapsedShuffleTime").alias("avgShuffleTime"),
        mean_of("REDUCE", "elapsedMergeTime").alias("avgMergeTime"),
        mean_of("REDUCE", "elapsedReduceTime").alias("avgReduceTime"),
    )


def ratio_of_sums(
    df: DataFrame, group: Sequence[str], num: Column, den: Column, name: str = "ratio"
) -> DataFrame:
    """Sum over sum, 0 when the divisor sums to 0."""
    sums = df.groupBy(*group).agg(F.sum(num).alias("_num"), F.sum(den).alias("_den"))
    return sums.withColumn(name, ratio("_num", "_den")).drop("_num", "_den")


def ratios_of_sums(df: DataFrame, group: Sequence[str], ratios: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """Several ratios ``name: (numerator, divisor)`` of the same groups in one aggregation."""
    sums = {f"_{part}{i}": F.sum(col) for i, pair in enumerate(ratios.values()) for part, col in zip(("num", "den"), pair)}
    out = df.groupBy(*group).agg(*[total.alias(n) for n, total in sums.items()])
    return out.withColumns({name: ratio(f"_num{i}", f"_den{i}") for i, name in enumerate(ratios)}).drop(*sums)


def attempt_ratios(attempts: DataFrame, group: Sequence[str] = ("jobId",)) -> DataFrame:
    """Spill, shuffle and sort ratios and map speed of each job in one pass."""
    work = F.col("elapsedTime") - F.col("elapsedShuffleTime") - F.col("elapsedMergeTime")
    return ratios_of_sums(attempts, group, {
        "mapperSpill": (F.col("spilledRecords"), F.col("mapOutputRecords")),
        "shuffleRatio": (2 * F.col("elapsedShuffleTime"), work),
        "mapSpeed": (F.col("hdfsBytesRead"), F.col("finishTime") - F.col("startTime")),
        "sortRatio": (2 * F.col("elapsedMergeTime"), work),
    })


def mapper_spill(attempts: DataFrame, group: Sequence[str] = ("jobId",)) -> DataFrame:
    return ratio_of_sums(attempts, group, F.col("spilledRecords"), F.col("mapOutputRecords"), "mapperSpill")


def shuffle_ratio(attempts: DataFrame, group: Sequence[str] = ("jobId",)) -> DataFrame:
    work = F.col("elapsedTime") - F.col("elapsedShuffleTime") - F.col("elapsedMergeTime")
    return ratio_of_sums(attempts, group, 2 * F.col("elapsedShuffleTime"), work, "shuffleRatio")


def map_speed(attempts: DataFrame, group: Sequence[str] = ("jobId",)) -> DataFrame:
    busy = F.col("finishTime") - F.col("startTime")
    return ratio_of_sums(attempts, group, F.col("hdfsBytesRead"), busy, "mapSpeed")


def sort_ratio(attempts: DataFrame, group: Sequence[str] = ("jobId",)) -> DataFrame:
    work = F.col("elapsedTime") - F.col("elapsedShuffleTime") - F.col("elapsedMergeTime")
    return ratio_of_sums(attempts, group, 2 * F.col("elapsedMergeTime"), work, "sortRatio")


def tasks_per(df: DataFrame, group: Sequence[str], by: str) -> DataFrame:
    """Map, reduce and all tasks of each group per node (or per start time)."""
    return df.groupBy(*group, by).agg(
        F.count_if(F.col("type") == "MAP").alias("mapTasks"),
        F.count_if(F.col("type") == "REDUCE").alias("reduceTasks"),
        F.count(F.lit(1)).alias("totalTasks"),
    )


def sums_by_category(
    df: DataFrame, group: Sequence[str], category: str, value: str, names: Mapping[str, str]
) -> DataFrame:
    """One sum per listed category, as columns; other categories are ignored and absent ones are 0."""
    return df.groupBy(*group).agg(
        *[
            F.coalesce(F.sum(F.when(F.col(category) == c, F.col(value))), F.lit(0)).alias(n)
            for c, n in names.items()
        ]
    )


def with_aggregate_row(
    df: DataFrame,
    group: Sequence[str],
    entity: str,
    cols: Sequence[str],
    only: Column | None = None,
    label: str = "aggregate",
) -> DataFrame:
    """The detail rows plus one row per group that sums the (selected) details.

    Detail rows are not shuffled; only partial sums are.
    """
    counted = df.filter(only) if only is not None else df
    total = counted.groupBy(*group).agg(*[F.sum(c).alias(c) for c in cols]).withColumn(entity, F.lit(label))
    details = df.select(*group, entity, *cols)
    return details.unionByName(total)


def rollup_sizes(df: DataFrame, levels: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Sums at every level of a hierarchy; ``level`` is how many of ``levels`` are kept.

    Rows are reduced to the finest level first, so the expansion that a rollup needs
    happens on groups and not on rows.
    """
    finest = df.groupBy(*levels).agg(
        *[F.sum(c).alias(c) for c in cols], F.count(F.lit(1)).alias("entities")
    )
    kept = len(levels) - sum(F.grouping(lv).cast("int") for lv in levels)
    return finest.rollup(*levels).agg(
        kept.alias("level"), *[F.sum(c).alias(c) for c in cols], F.sum("entities").alias("entities")
    )


def entity_totals(df: DataFrame, group: Sequence[str], cols: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("entities"), *[F.sum(c).alias(f"total_{c}") for c in cols]
    )


def mean_of_ratios(
    df: DataFrame, group: Sequence[str], hit: str, miss: str, name: str = "hit_ratio", digits: int = 2
) -> DataFrame:
    """Mean of per-row hit percentages; rows without traffic stay out of the mean, none at all gives 0."""
    total = F.col(hit) + F.col(miss)
    share = F.when(total > 0, F.lit(100.0) * F.col(hit).cast("double") / total)
    return df.groupBy(*group).agg(F.round(F.coalesce(F.avg(share), F.lit(0.0)), digits).alias(name))


def band_counts(df: DataFrame, group: Sequence[str], band: Column, names: Mapping[str, str]) -> DataFrame:
    """Rows per band label, as columns."""
    return df.groupBy(*group).agg(*[F.count_if(band == label).alias(n) for label, n in names.items()])


def cpu_topology(cpuinfo: DataFrame, group: Sequence[str] = ("host",)) -> DataFrame:
    """Sockets, cores, logical CPUs, clock and hyper-threading from ``key``/``value``/``line_no`` rows.

    Equal lines of a host are counted first; the distinct counts are then plain counts.
    """
    # Keys of the CPU listing and what they count.
    keys = ["processor", "physical id", "core id", "model name", "cpu MHz"]
    lines = (
        cpuinfo.filter(F.col("key").isin(keys))
        .groupBy(*group, "key", "value")
        .agg(F.count(F.lit(1)).alias("_n"), F.min("line_no").alias("_line"))
    )

    def distinct(key: str) -> Column:
        return F.count_if(F.col("key") == key)

    mhz = F.when(F.col("key") == "cpu MHz", F.col("value").try_cast("double"))
    models = F.array_sort(
        F.collect_list(F.when(F.col("key") == "model name", F.struct(F.col("_line"), F.col("value"))))
    )
    out = lines.groupBy(*group).agg(
        F.array_join(F.transform(models, lambda m: m["value"]), ",").alias("cpuType"),
        F.round(
            F.sum(mhz * F.col("_n")) / F.sum(F.when(F.col("key") == "cpu MHz", F.col("_n"))), 2
        ).alias("clock"),
        distinct("core id").alias("totalCores"),
        distinct("physical id").alias("sockets"),
        distinct("processor").alias("logicalCpus"),
    )
    threaded = (F.col("totalCores") * F.col("sockets") * 2 == F.col("logicalCpus")) & (F.col("logicalCpus") > 0)
    return out.withColumn("hyperThreading", F.when(threaded, F.lit("On")).otherwise(F.lit("off")))
