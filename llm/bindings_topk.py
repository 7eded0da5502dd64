"""Query of the exact top-k search."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table
from .registry import query
from .topk import quantised, top_k

TOP_K_SQL = """
WITH usable AS (
  SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.id AS query_id, d.id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM usable q JOIN usable d ON q.id <> d.id
  WHERE q.id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""


@query("op8_exact_top_k", TOP_K_SQL)
def op8_exact_top_k(spark, sf_dir):
    vectors = quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return top_k(vectors, vectors.filter(F.col("id") % 20 == 0), 20)
