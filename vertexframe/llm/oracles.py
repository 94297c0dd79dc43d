"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

MIXING = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15) AS h
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) AS k
  FROM sized GROUP BY source),
weighed AS (SELECT *, (k % 3 + 1)::DOUBLE AS w, 3 * source_size::DOUBLE AS cap FROM sources),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources)::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
       / ((SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM weighed),
settled AS (SELECT level FROM levels WHERE cap >= level * w ORDER BY cap / w, k LIMIT 1),
goals AS (
  SELECT source, source_size, least(cap, (SELECT level FROM settled) * w) AS target FROM weighed),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM goals),
hashes AS (SELECT source, h, sum(size) AS n FROM sized GROUP BY source, h),
bars AS (
  SELECT hashes.*, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM hashes),
marked AS (
  SELECT bars.source, h, upto <= rest OR (upto - n <= rest AND n - (rest - (upto - n)) <= rest - (upto - n)) AS more
  FROM bars JOIN (SELECT source, target - whole * source_size AS rest FROM plans) p ON bars.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (size * (whole + more::INT))::BIGINT AS taken
FROM sized JOIN plans ON sized.source IS NOT DISTINCT FROM plans.source
JOIN marked ON sized.source IS NOT DISTINCT FROM marked.source AND sized.h = marked.h
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op4_mixing": MIXING, "op5_exact_topk": TOP_K}
