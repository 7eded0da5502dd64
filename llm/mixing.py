"""Mixing sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources they belong to). A flow
routes words from patterns to source quotas: source -> pattern arcs exist where the pattern
holds the source, and each pattern offers its words once at cost 0, again at cost 1, and so on
(convex repetition costs, up to ``max_repeats``). The flow of least cost meets the quotas with
as little repetition as possible. Inside a pattern, documents are taken in the order of a seeded
hash: all of them as often as the flow holds the whole pattern, then one more time from the start
of the order until the rest is used up; the last one is taken in part, so quotas are met exactly.

Only sums by pattern reach the driver. The order inside a pattern is never sorted as a whole:
hash buckets are summed on two levels, and only the one bucket in which the rest ends is sorted.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BITS = 12  # of a bucket level


def share_out(total: float, weights: list[float], limits: list[float]) -> list[float]:
    """``total`` by weight, none above its limit; the excess is shared again by weight."""
    out, rest, weight = [0.0] * len(weights), float(total), sum(weights)
    # whoever reaches its limit at the smallest share does so first
    order = sorted(range(len(weights)), key=lambda i: limits[i] / weights[i])
    for place, i in enumerate(order):
        if rest <= 0:
            break
        unit = rest / weight
        if weights[i] * unit <= limits[i]:
            for j in order[place:]:
                out[j] = weights[j] * unit
            break
        out[i] = float(limits[i])
        rest -= limits[i]
        weight -= weights[i]
    return out


class Flow:
    """Min-cost flow by successive shortest paths with potentials (costs are not negative)."""

    def __init__(self):
        self.arcs: list[list] = []  # to, capacity, cost; the reverse arc is at index ^ 1
        self.out: dict[object, list[int]] = {}

    def arc(self, a, b, capacity: int, cost: int) -> int:
        for x, y, c, w in ((a, b, capacity, cost), (b, a, 0, -cost)):
            self.out.setdefault(x, []).append(len(self.arcs))
            self.out.setdefault(y, [])
            self.arcs.append([y, c, w])
        return len(self.arcs) - 2

    def run(self, source, sink) -> None:
        height = dict.fromkeys(self.out, 0)
        while True:
            far, via, heap, tie = {source: 0}, {}, [(0, 0, source)], 0
            while heap:
                d, _, x = heapq.heappop(heap)
                if d > far[x]:
                    continue
                for e in self.out[x]:
                    y, capacity, cost = self.arcs[e]
                    near = d + cost + height[x] - height[y]
                    if capacity > 0 and near < far.get(y, float("inf")):
                        far[y], via[y], tie = near, e, tie + 1
                        heapq.heappush(heap, (near, tie, y))
            if sink not in far:
                return
            most = max(far.values())
            for x in height:
                height[x] += far.get(x, most)
            path, x = [], sink
            while x != source:
                path.append(via[x])
                x = self.arcs[via[x] ^ 1][0]
            push = min(self.arcs[e][1] for e in path)
            for e in path:
                self.arcs[e][1] -= push
                self.arcs[e ^ 1][1] += push


def route(sizes: dict[tuple, int], quotas: dict, max_repeats: int = 2) -> dict[tuple, int]:
    """Words to take of each pattern (a tuple of sources), repeats counted.

    Where no pattern has a choice of sources there is one way only, which needs no search."""
    if all(sum(s in quotas for s in pattern) <= 1 for pattern in sizes):
        single = {p: next((s for s in p if s in quotas), None) for p in sizes}
        if len({s for s in single.values() if s is not None}) == sum(s is not None for s in single.values()):
            return {p: 0 if s is None else min(int(quotas[s]), sizes[p] * max_repeats) for p, s in single.items()}
    flow = Flow()
    flow.out.update({"s": [], "t": []})
    into = {}
    for source, quota in quotas.items():
        flow.arc("s", ("source", source), int(quota), 0)
    for pattern, size in sizes.items():
        for source in pattern:
            if source in quotas:
                flow.arc(("source", source), ("pattern", pattern), size * max_repeats, 0)
        into[pattern] = [flow.arc(("pattern", pattern), "t", size, again) for again in range(max_repeats)]
    flow.run("s", "t")
    return {p: sum(flow.arcs[e ^ 1][1] for e in arcs) for p, arcs in into.items()}


def select(docs: DataFrame, amounts: DataFrame) -> DataFrame:
    """``taken`` of every row of ``docs`` (``pattern, size, id, h`` and others), given ``pattern, total, amount``."""
    # one row for each pattern: bounded by the sources, so the join may broadcast; AQE decides
    whole = F.when(F.col("total") > 0, F.floor(F.col("amount") / F.col("total"))).otherwise(0).cast("long")
    plan = amounts.withColumn("times", whole).withColumn("rest", F.col("amount") - F.col("times") * F.col("total"))
    plan = plan.select("pattern", "times", "rest")
    mask = (1 << BITS) - 1
    rows = docs.withColumn("b1", F.shiftrightunsigned("h", 64 - BITS)).withColumn(
        "b2", F.shiftrightunsigned("h", 64 - 2 * BITS).bitwiseAND(mask)
    )

    def cut(sums: DataFrame, keys: list[str], by: str) -> DataFrame:
        """The bucket in which the rest ends, and what is left for it."""
        before = F.coalesce(F.sum("words").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ahead = sums.withColumn("before", before).filter("before <= rest AND rest < before + words")
        return ahead.withColumn("rest", F.col("rest") - F.col("before")).select(*keys, by, "rest")

    level1 = rows.groupBy("pattern", "b1").agg(F.sum("size").alias("words"))
    c1 = cut(level1.join(plan, "pattern"), ["pattern"], "b1").select("pattern", F.col("b1").alias("c1"), F.col("rest").alias("r1"))
    inside = rows.join(c1, "pattern").filter("b1 = c1").select("pattern", "b2", "size", "r1")
    level2 = inside.groupBy("pattern", "b2").agg(F.sum("size").alias("words"), F.first("r1").alias("rest"))
    c2 = cut(level2, ["pattern"], "b2").select("pattern", F.col("b2").alias("c2"), F.col("rest").alias("r2"))
    cuts = stored(plan.join(c1, "pattern", "left").join(c2, "pattern", "left"), "cuts")
    marked = rows.join(cuts, "pattern", "left")
    border = (F.col("b1") == F.col("c1")) & (F.col("b2") == F.col("c2"))
    below = (F.col("b1") < F.col("c1")) | ((F.col("b1") == F.col("c1")) & (F.col("b2") < F.col("c2")))
    marked = marked.withColumn("border", F.coalesce(border, F.lit(False))).withColumn("below", F.coalesce(below, F.lit(False)))
    # only rows of the one bucket at the border are put in order
    order = Window.partitionBy("pattern").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ends = marked.filter("border").withColumn("before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    part = F.greatest(F.lit(0), F.least("size", F.col("r2") - F.col("before")))
    ends = ends.withColumn("extra", part).drop("before")
    rest = marked.filter(~F.col("border")).withColumn("extra", F.when(F.col("below"), F.col("size")).otherwise(0))
    both = rest.unionByName(ends)
    return both.withColumn("taken", F.coalesce(F.col("times") * F.col("size") + F.col("extra"), F.lit(0)).cast("long"))


def mix(
    docs: DataFrame, sources: str, size: str, id_col: str, quotas: dict, max_repeats: int = 2, seed: int = 11,
) -> DataFrame:
    """Words to take of each row: ``docs`` plus ``taken`` (a column of that name is replaced).

    ``sources`` is an array of the row's sources (its order and repeats do not matter; a row
    without sources, or a null one, is taken 0 times), ``size`` its words (null counts as 0),
    ``quotas`` the words wanted of each source. No row is taken more than ``max_repeats`` times;
    a quota above what its patterns offer is met as far as they go. Rows of size 0 are taken 0
    times. The order inside a pattern is a hash of the seed and the id; rows with equal ids are
    interchangeable if their sizes are equal and ordered by size otherwise, so reruns agree.
    """
    spark = docs.sparkSession
    members = F.array_sort(F.array_distinct(F.coalesce(F.col(sources), F.array())))
    words = F.coalesce(F.col(size), F.lit(0)).cast("long")
    rows = docs.select(
        F.struct(*[c for c in docs.columns if c != "taken"]).alias("row"), members.alias("members"),
        F.to_json(members).alias("pattern"), words.alias("size"), F.col(id_col).alias("id"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("h"),
    )
    sums = rows.groupBy("pattern", "members").agg(F.sum("size").alias("total"))
    found = {tuple(r["members"]): (r["pattern"], int(r["total"])) for r in sums.collect()}
    taken = route({m: total for m, (_, total) in found.items()}, quotas, max_repeats)
    amounts = [(p, total, int(taken[m])) for m, (p, total) in found.items()]
    amounts = spark.createDataFrame(amounts, "pattern string, total long, amount long")
    return select(rows.drop("members"), amounts).select("row.*", "taken")


def mix_by_weight(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: tuple = (3, 1, 2), share: float = 1.5, max_repeats: int = 2, seed: int = 11, keep_text: bool = False,
) -> DataFrame:
    """Documents (without the text, save with ``keep_text``) plus ``size, source_size, target, taken``, whose names are
    replaced where the documents have them; sources are mixed to weights that repeat.

    Sources are numbered by code point, null last (a null source is a source of its own), and
    weigh ``weights`` in turn; they share ``share`` times all words, none above ``max_repeats``
    times its own. A size is the number of words in the whole text (null: 0). Null or repeated
    ids and ties are handled as ``mix`` says; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    source = F.col(source_col).cast("string")
    new = ["size", "source_size", "target", "taken"]
    names = [c for c in docs.columns if c not in new and (keep_text or c != text_col)]
    # a letter before the name keeps a null source apart from every text
    key = F.when(source.isNull(), "n").otherwise(F.concat(F.lit("s"), source))
    sized = stored(docs.select(F.struct(*names).alias("doc"), F.col(id_col).alias("id"), words.alias("size"), key.alias("key")), "sized")
    per = sized.groupBy("key").agg(F.sum("size").alias("n")).collect()
    per = sorted(((r["key"], int(r["n"])) for r in per), key=lambda x: (x[0] == "n", x[0].encode("utf-8")))
    weight = [weights[i % len(weights)] for i in range(len(per))]
    targets = share_out(share * sum(n for _, n in per), weight, [max_repeats * n for _, n in per])
    quotas = {s: round(t) for (s, _), t in zip(per, targets, strict=True)}
    mixed = mix(sized.withColumn("sources", F.array("key")), "sources", "size", "id", quotas, max_repeats, seed)
    table = spark.createDataFrame([(s, n, t) for (s, n), t in zip(per, targets, strict=True)], "key string, source_size long, target double")
    return mixed.join(table, "key").select("doc.*", *new)
