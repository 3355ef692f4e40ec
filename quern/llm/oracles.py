"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP3 = """
WITH v AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""

OP5 = """
WITH turns AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, COALESCE(role, '') AS role, COALESCE(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), prefixes AS MATERIALIZED (
  SELECT conv_id, place, string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '') OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS said,
    md5(string_agg(md5(role) || md5(text), '') OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS h, MAX(place) OVER (PARTITION BY conv_id) AS n FROM turns
)
SELECT MIN(conv_id) AS conv_id, MIN(n) AS n_turns, COUNT(*) AS copies, MIN(said) AS rendered
FROM prefixes w WHERE place = n AND NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.h = w.h AND p.place < p.n) GROUP BY h
"""

OP7 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM sized GROUP BY source
), weighted AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM sources
), levels AS (
  SELECT *, (SUM(source_size) OVER () - COALESCE(SUM(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / SUM(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted
), goals AS (
  SELECT l.source, l.source_size, LEAST(CAST(l.cap AS DOUBLE), l.weight * COALESCE((SELECT level FROM levels WHERE weight * level <= cap ORDER BY cap / weight, rank LIMIT 1), 0.0)) AS target FROM levels l
), running AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
    COALESCE(SUM(s.size) OVER (PARTITION BY s.source ORDER BY md5('mix-1:' || COALESCE(CAST(s.doc_id AS VARCHAR), '')), s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
), epochs AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM running
)
SELECT doc_id, size, source_size, target,
  CAST(whole * size + GREATEST(0, LEAST(size, CAST(floor(target) AS BIGINT) - whole * source_size - before)) AS BIGINT) AS taken FROM epochs
"""


OP10 = r"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, GREATEST(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS MATERIALIZED (
  SELECT doc_id, COUNT(*) AS n FROM shingles GROUP BY doc_id
), links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * COUNT(*) >= 85 * (x.n + y.n - COUNT(*))
), reach AS (
  SELECT a AS doc_id, b AS other FROM links UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT d.doc_id, CAST(COALESCE(s.n, 0) AS BIGINT) AS n_shingles, CAST(LEAST(d.doc_id, COALESCE(r.least, d.doc_id)) AS BIGINT) AS component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, MIN(other) AS least FROM reach GROUP BY doc_id) r ON r.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_topk_search": OP3, "op5_chat": OP5, "op7_mixing": OP7, "op10_ngram_join": OP10}
