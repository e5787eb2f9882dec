"""SQL for DuckDB that gives the rows of those operators whose results SQL can express.

Texts are compared whole and pairs by all that they share: plain definitions, for small tables.
"""

from __future__ import annotations

MINHASH = r"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
l AS (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r(doc_id, c) AS (SELECT DISTINCT u, u FROM l UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.doc_id WHERE r.c < l.v)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, coalesce(least(min(c), s.doc_id), s.doc_id) AS component_id, s.doc_id = coalesce(least(min(c), s.doc_id), s.doc_id) AS kept FROM s LEFT JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, len(g)"""

SUFFIXES = r"""WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, b[i + 1:i + 100] AS x FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 99)) AS i FROM d)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS k FROM w),
o AS (SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM f WHERE k > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM o),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS z FROM g GROUP BY 1, 2),
c AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, list(a ORDER BY a) AS s, list(z ORDER BY a) AS e FROM r GROUP BY 1)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
sha256(CASE WHEN s IS NULL THEN b ELSE list_reduce(list_transform(range(0, len(s) + 1), lambda k: b[CASE WHEN k = 0 THEN 1 ELSE e[k] + 1 END:CASE WHEN k = len(s) THEN octet_length(b) ELSE s[k + 1] END]), lambda x, y: x || y) END) AS kept_sha256 FROM d LEFT JOIN c USING (doc_id)"""

VECTORS = r"""WITH RECURSIVE x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, v FROM x WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(v, lambda c: c <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.9),
r(vec_id, c) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id WHERE r.c < l.b),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1), m AS (SELECT vec_id, min(c) AS c FROM r GROUP BY 1)
SELECT x.vec_id, coalesce(n, 0) AS n_links, least(coalesce(m.c, x.vec_id), x.vec_id) AS component_id, x.vec_id = least(coalesce(m.c, x.vec_id), x.vec_id) AS kept FROM x LEFT JOIN n USING (vec_id) LEFT JOIN m USING (vec_id)"""
