"""Exact top-k inner products by block-at-a-time pruning.

Documents lie in blocks of consecutive ids. A block keeps, for each term (vector component),
its largest and smallest weight, and a forward index (the weights of its rows). For a query
the bound of a block is the sum over the terms of the larger of weight times maximum and
weight times minimum. Blocks are visited in falling order of their bounds and scored through
their forward indexes until the next bound falls below the k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import sorted_runs, stored

BLOCK_ROWS = 256
GROUP_ROWS = 16384
QUERY_ROWS = 1024
GROWTH = 8
_OUT = "query_id long, query_copy long, vec_id long, score long"


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """``id, v``: floor(scale * x) as whole numbers of every usable vector.

    Left out: null vectors and vectors with null or non-finite components. An empty vector
    stays; it scores 0 against vectors of its own length.
    """
    v = F.col(vector_col)
    usable = F.coalesce(
        F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False)
    )
    return df.filter(usable).select(
        F.col(id_col).alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")
    )


def _merge(best_s, best_i, s, ids, k):
    s = np.concatenate([best_s, s])
    ids = np.concatenate([best_i, ids])
    top = np.lexsort((ids, -s))[:k]
    return s[top], ids[top]


def _score_cells(batches: Iterator[pa.RecordBatch], k: int, block_rows: int) -> Iterator[pa.RecordBatch]:
    for run in sorted_runs(batches, ["dim", "dg", "qg"]):
        is_query = np.array(run.column("is_query").to_pylist(), dtype=bool)
        ids = np.array(run.column("id").to_pylist(), dtype=np.int64)
        copy = np.array(run.column("copy").to_pylist(), dtype=np.int64)
        floor = np.array(run.column("floor").to_pylist(), dtype=np.int64)
        dim = run.column("dim")[0].as_py()
        flat = np.array(run.column("v").combine_chunks().flatten(), dtype=np.int64).reshape(len(ids), dim)
        # sums stay exact in doubles below 2^53; beyond, whole numbers are used
        largest = int(np.abs(flat).max(initial=0))
        exact = largest < 2**26 and largest * largest * max(dim, 1) < 2**53
        flat = flat.astype(np.float64 if exact else object)
        docs, queries = np.flatnonzero(~is_query), np.flatnonzero(is_query)
        docs = docs[np.argsort(ids[docs], kind="stable")]
        if not len(docs) or not len(queries):
            continue
        starts = np.arange(0, len(docs), block_rows)
        blocks = [docs[s : s + block_rows] for s in starts]
        q = flat[queries]
        if dim:
            top = np.stack([flat[b].max(axis=0) for b in blocks])
            low = np.stack([flat[b].min(axis=0) for b in blocks])
            zero = flat.dtype.type(0) if exact else 0
            bounds = np.maximum(q, zero) @ top.T + np.minimum(q, zero) @ low.T
        else:
            bounds = np.zeros((len(queries), len(blocks)))
        out_q, out_c, out_d, out_s = [], [], [], []
        order = np.argsort(-bounds, axis=1, kind="stable")
        best = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))] * len(queries)
        least = floor[queries]
        alive = np.flatnonzero((bounds[np.arange(len(queries)), order[:, 0]] >= least).astype(bool))
        for step in range(len(blocks)):  # every query visits the best block it has not seen
            if not len(alive):
                break
            which = order[alive, step]
            go = []
            for b in np.unique(which):
                rows = blocks[b]
                for part in np.array_split(alive[which == b], max(1, len(rows) * int((which == b).sum()) // 4_000_000)):
                    scores = q[part] @ flat[rows].T
                    if not exact:
                        scores = np.clip(scores, -(2**63), 2**63 - 1)
                    scores = scores.astype(np.int64)
                    for j, n in enumerate(part):
                        s, doc_ids = scores[j], ids[rows]
                        other = doc_ids != ids[queries[n]]
                        other &= s >= least[n]
                        s, doc_ids = s[other], doc_ids[other]
                        have = best[n]
                        if len(have[0]) == k:
                            near = s >= have[0][-1]
                            s, doc_ids = s[near], doc_ids[near]
                        elif len(s) > 4 * k:
                            near = s >= np.partition(s, len(s) - k)[len(s) - k]
                            s, doc_ids = s[near], doc_ids[near]
                        if len(s):
                            best[n] = _merge(*have, s, doc_ids, k)
                    go.append(part)
            alive = np.concatenate(go)
            if step + 1 < len(blocks):
                ahead = bounds[alive, order[alive, step + 1]]
                # equal bounds are still visited: a tie goes to the smaller id
                keep = [ahead[j] >= (least[n] if len(best[n][0]) < k else best[n][0][-1]) for j, n in enumerate(alive)]
                alive = alive[np.array(keep, dtype=bool)]
        for n, (s, doc_ids) in enumerate(best):
            out_q += [ids[queries[n]]] * len(s)
            out_c += [copy[queries[n]]] * len(s)
            out_d += doc_ids.tolist()
            out_s += s.tolist()
        if out_q:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(x, dtype=np.int64)) for x in (out_q, out_c, out_d, out_s)],
                names=["query_id", "query_copy", "vec_id", "score"],
            )


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 20,
    block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """The ``k`` highest inner products of each row of ``queries`` among ``vectors``.

    Both have ``id long, v array<long>``. Candidates of a query are all rows with another id
    and as many components. Ties go to the smaller id. Rows with a null id take no part as
    queries and are no candidates; repeated ids are candidates each for themselves, and a
    repeated query answers once for each row. Scores beyond a long count as the largest or smallest
    one. Empty inputs give an empty result.

    The table is cut into groups of about ``group_rows`` consecutive rows by id and the queries
    into groups of about ``query_rows``; a task scores one group against one query group, round by round, and
    the few rows that each leaves are ranked per query. Returns ``query_id, rank, vec_id, score``.
    """
    spark = vectors.sparkSession
    docs = stored(vectors.filter("id IS NOT NULL").withColumn("dim", F.size("v")), "vectors")
    asked = stored(
        queries.filter("id IS NOT NULL").withColumn("dim", F.size("v")).withColumn("copy", F.monotonically_increasing_id()),
        "queries",
    )
    n_docs, n_queries = docs.count(), asked.count()
    d_groups, q_groups = max(1, -(-n_docs // group_rows)), max(1, -(-n_queries // query_rows))
    # groups of consecutive ids; a partition that repeated ids make large is cut by row number.
    # The borders steer placement only: any borders give the same result.
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    docs = stored(
        docs.repartitionByRange(d_groups, "id", F.xxhash64("v")).withColumn(
            "dg", F.spark_partition_id().cast("long") * (1 << 32) + F.floor(row / (2 * group_rows))
        ),
        "grouped",
    )
    asked = asked.withColumn("qg", F.pmod(F.xxhash64("copy"), F.lit(q_groups)).cast("int"))
    # the round of a group by its hash: the last one has most of them, the first about one
    rounds, part = 0, d_groups
    while part > 1:
        rounds, part = rounds + 1, part / GROWTH
    share = F.pmod(F.xxhash64("dg"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    number = F.lit(rounds)
    for r in range(rounds - 1, -1, -1):
        number = F.when(share < GROWTH ** (r - rounds), F.lit(r)).otherwise(number)
    docs = docs.withColumn("round", number)
    every = F.explode(F.sequence(F.lit(0), F.lit(q_groups - 1))).alias("qg")
    parts = max(spark.sparkContext.defaultParallelism, min(d_groups * q_groups, 20000))
    nothing = F.lit(-(1 << 63)).cast("long")
    order = Window.partitionBy("query_copy").orderBy(F.desc("score"), "vec_id")
    best = None
    for r in range(rounds + 1):
        now = docs.filter(F.col("round") == r)
        knows = asked.withColumn("floor", nothing)
        if best is not None:  # the k-th score so far, where there are k
            floors = best.filter(F.col("rank") == k).select(F.col("query_copy").alias("copy"), F.col("score").alias("kth"))
            knows = asked.join(floors, "copy", "left").withColumn("floor", F.coalesce("kth", nothing)).drop("kth")
        groups = now.select("dim", "dg").distinct().select("dim", "dg", every)
        cells = now.select("dim", "dg", every, F.lit(False).alias("is_query"), F.lit(0).cast("long").alias("copy"), nothing.alias("floor"), "id", "v")
        cells = cells.unionByName(
            knows.join(groups, ["dim", "qg"]).select("dim", "dg", "qg", F.lit(True).alias("is_query"), "copy", "floor", "id", "v")
        )
        cells = cells.repartition(parts, "dim", "dg", "qg").sortWithinPartitions("dim", "dg", "qg")
        found = cells.mapInArrow(lambda it: _score_cells(it, k, block_rows), _OUT)
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        # the limit on the rank is applied before the shuffle as well
        ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        best = ranked if r == rounds else stored(ranked, "best")
    return best.select("query_id", "rank", "vec_id", "score")
