"""Query of the source divergence audit."""

from __future__ import annotations

from .common import table
from .divergence import divergence
from .registry import query

DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), words AS (
  SELECT doc, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS c FROM words GROUP BY lang, term HAVING count(DISTINCT doc) >= 10
), langs AS (
  SELECT lang, CAST(sum(c) AS HUGEINT) AS total, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, count(*) AS c FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term
), groups AS (
  SELECT g.lang, g.source, coalesce(n.total, 0) AS total
  FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, source, CAST(sum(c) AS HUGEINT) AS total FROM counts GROUP BY lang, source) n USING (lang, source)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
         1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (g.total + 2 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.c + 2)) // (l.total + 2 * l.v) AS of_lang
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang)
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source, y.source AS other, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.source = a.source AND s.other = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - of_lang) * (p - of_lang)) // (p + of_lang) FROM shares WHERE c > 0 AND p > of_lang
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found)
WHERE part = 'pair' OR rank <= 10
"""


@query("op11_source_divergence", DIVERGENCE_SQL)
def op11_source_divergence(spark, sf_dir):
    return divergence(table(spark, sf_dir, "documents"))
