"""Joins between static, dynamic, parent and child tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .counters import delta_value


def enrich(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on ``keys``; where both sides have a column the right value wins, if there is one.

    The join strategy is left to the planner, which knows the sizes at run time.
    """
    clash = [c for c in right.columns if c in left.columns and c not in keys]
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in clash}).withColumn("_hit", F.lit(True))
    joined = left.join(renamed, list(keys), how)
    fixed = {c: F.when(F.col("_hit"), F.col(f"_r_{c}")).otherwise(F.col(c)) for c in clash}
    return joined.withColumns(fixed).drop("_hit", *[f"_r_{c}" for c in clash])


def stage_tasks(
    stages: DataFrame,
    tasks: DataFrame,
    keys: Sequence[str] = ("appId", "stageId", "stageAttemptId"),
) -> DataFrame:
    """Stages with their tasks; a stage without tasks stays, once.

    Written as an inner join plus the stages left over: AQE can split a stage with very
    many tasks in an inner join, but not on the far side of an outer one.
    """
    own = [c for c in tasks.columns if c in keys or c not in stages.columns]
    matched = stages.join(tasks.select(*own), list(keys), "inner")
    idle = stages.join(tasks.select(*keys).distinct(), list(keys), "left_anti")
    return matched.unionByName(idle, allowMissingColumns=True)


def task_attempts(tasks: DataFrame, attempts: DataFrame, keys: Sequence[str] = ("taskId", "type")) -> DataFrame:
    """Tasks with the attempts of the same id and type; orphan attempts fall away."""
    own = [c for c in attempts.columns if c in keys or c not in tasks.columns]
    return tasks.join(attempts.select(*own), list(keys), "inner")


def attempt_containers(attempts: DataFrame, containers: DataFrame, key: str = "containerId") -> DataFrame:
    """Attempts with their container; of several container rows one is used."""
    own = [c for c in containers.columns if c == key or c not in attempts.columns]
    others = [c for c in own if c != key]
    first = containers.groupBy(key).agg(F.min(F.struct(*others)).alias("_c")).select(key, "_c.*")
    return attempts.join(first, [key], "left")


def expand_jobs(actions: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """One row per job an action started, with its ``position`` (0 = launcher or only job).

    Ids that are NULL, blank or ``-`` are skipped. With ``jobs`` given only jobs that
    are known stay, numbered anew without the missing ones.
    """
    children = F.when(F.col("externalChildIDs") != "", F.split("externalChildIDs", ",")).otherwise(F.array())
    ids = F.concat(F.array(F.col("externalId")), F.coalesce(children, F.array().cast("array<string>")))
    ids = F.filter(F.transform(ids, lambda x: F.trim(x)), lambda x: x.isNotNull() & ~x.isin("", "-"))
    rows = actions.select("*", F.posexplode(ids).alias("position", "jobId"))
    if jobs is None:
        return rows
    own = [c for c in jobs.columns if c == "jobId" or c not in rows.columns]
    known = rows.join(jobs.select(*own), ["jobId"], "inner")
    # an action lists a handful of jobs, so this window never grows with the data
    w = Window.partitionBy("wfId", "wfaId").orderBy("position")
    return known.withColumn("position", F.row_number().over(w) - 1)


def action_documents(actions: DataFrame) -> DataFrame:
    """One document per child job id; an action with a single job repeats that id as its child."""
    children = F.filter(
        F.transform(F.split(F.coalesce("externalChildIDs", F.lit("")), ","), lambda x: F.trim(x)),
        lambda x: ~x.isin("", "-"),
    )
    usable = F.filter(F.array(F.trim("externalId")), lambda x: x.isNotNull() & ~x.isin("", "-"))
    ids = F.when(F.size(children) > 0, children).otherwise(usable)
    return actions.select("*", F.explode(ids).alias("externalChildID"))


def diff_snapshots(
    cur: DataFrame,
    prev: DataFrame,
    keys: Sequence[str],
    cols: Sequence[str],
    time: str | None = None,
    interval_s: float | None = None,
) -> DataFrame:
    """Replace ``cols`` by their change since the previous snapshot.

    Rows without a previous one are left untouched. With ``time`` (epoch seconds) and
    ``interval_s``, a gap of more than three intervals gives 0.
    """
    wanted = [*cols, *([time] if time else [])]
    before = prev.select(*keys, *[F.col(c).alias(f"_p_{c}") for c in wanted]).withColumn("_hit", F.lit(True))
    joined = cur.join(before, list(keys), "left")
    out = {}
    for c in cols:
        gap = F.col(time) - F.col(f"_p_{time}") if time else None
        limit = 3 * interval_s if interval_s is not None else None
        change = delta_value(F.col(c), F.col(f"_p_{c}"), F.col("_hit"), "raw", "passthrough", None, gap, limit)
        out[c] = change
    return joined.withColumns(out).drop("_hit", *[f"_p_{c}" for c in wanted])


def membership_change(cur: DataFrame, prev: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that appeared or went, with ``change`` = ``added`` or ``removed``.

    One pass: both sides are tagged, reduced map-side, and a key seen on one side only is a change.
    """
    both = cur.select(*keys, F.lit(1).alias("_c"), F.lit(0).alias("_p")).unionByName(
        prev.select(*keys, F.lit(0).alias("_c"), F.lit(1).alias("_p"))
    )
    seen = both.groupBy(*keys).agg(F.max("_c").alias("_c"), F.max("_p").alias("_p"))
    change = F.when(F.col("_c") == 1, F.lit("added")).otherwise(F.lit("removed"))
    return seen.filter(F.col("_c") != F.col("_p")).withColumn("change", change).drop("_c", "_p")


def membership_changed(cur: DataFrame, prev: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: did the membership change at all?"""
    return membership_change(cur, prev, keys).agg((F.count(F.lit(1)) > 0).alias("changed"))


def drop_stale(known: DataFrame, active: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Known entities that are still active (their stale siblings are removed)."""
    return known.join(active.select(*keys).distinct(), list(keys), "left_semi")


def stale(known: DataFrame, active: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Known entities no longer active: what the clean-up removes."""
    return known.join(active.select(*keys).distinct(), list(keys), "left_anti")


def merge_pending(new: DataFrame, pending: DataFrame, key: str) -> DataFrame:
    """New applications with the retry state of those that failed before; pending ones come along.

    ``pending`` carries ``retry_attempt_id`` and ``number_of_failures``.
    """
    state = pending.select(
        F.col(key).alias("_pk"), F.col("retry_attempt_id"), F.col("number_of_failures").alias("_fails")
    )
    joined = new.join(state, F.col(key) == F.col("_pk"), "full")
    return joined.withColumns(
        {
            key: F.coalesce(F.col(key), F.col("_pk")),
            "number_of_failures": F.coalesce(F.col("_fails"), F.lit(0)),
        }
    ).drop("_pk", "_fails")


def record_failure(pending: DataFrame, failed: DataFrame, key: str, max_failures: int = 3) -> DataFrame:
    """Pending table after a round: failures counted, entries past the limit dropped.

    ``failed`` carries the key and the ``retry_attempt_id`` that failed.
    """
    now = failed.select(F.col(key).alias("_fk"), F.col("retry_attempt_id").alias("_retry"))
    joined = pending.join(now, F.col(key) == F.col("_fk"), "full")
    hit = F.col("_fk").isNotNull()
    count = F.coalesce(F.col("number_of_failures"), F.lit(0)) + F.when(hit, F.lit(1)).otherwise(F.lit(0))
    out = joined.select(
        F.coalesce(F.col(key), F.col("_fk")).alias(key),
        F.when(hit, F.col("_retry")).otherwise(F.col("retry_attempt_id")).alias("retry_attempt_id"),
        count.alias("number_of_failures"),
    )
    return out.filter(F.col("number_of_failures") <= max_failures)
