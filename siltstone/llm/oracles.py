"""DuckDB SQL for the operators that SQL can express."""

LOW = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP1 = f"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({LOW.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS s FROM w),
flat AS MATERIALIZED (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(r.c, s.doc_id)) AS component_id,
  s.doc_id = least(s.doc_id, coalesce(r.c, s.doc_id)) AS kept
FROM sets s LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = s.doc_id
"""

_WORDS3 = "regexp_extract_all(" + LOW.format("coalesce(text, '')") + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_OP3 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS3} AS ws FROM documents),
b AS MATERIALIZED (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS3} AS ws FROM benchmark),
win AS MATERIALIZED (
  SELECT DISTINCT item_id, least(10, len(ws)) AS k, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS x
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS i FROM b WHERE len(ws) > 0)),
ks AS MATERIALIZED (SELECT DISTINCT k FROM win),
pos AS MATERIALIZED (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d),
hits AS MATERIALIZED (
  SELECT p.doc_id, p.i, win.k, win.item_id FROM pos p JOIN ks ON p.i + ks.k - 1 <= len(p.ws)
  JOIN win ON win.k = ks.k AND win.x = array_to_string(p.ws[p.i : p.i + ks.k - 1], ' ')),
n_hit AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS w FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
  sha256(coalesce(i.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN n_hit h ON h.doc_id = d.doc_id LEFT JOIN its i ON i.doc_id = d.doc_id
"""

_GOOD = "v IS NOT NULL AND vec_id IS NOT NULL AND len(v) > 0 AND list_bool_and(list_transform(v, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(v, lambda x: x <> 0))"
_OP2 = f"""
WITH e AS MATERIALIZED (SELECT DISTINCT vec_id, v FROM (SELECT CAST(vec_id AS BIGINT) AS vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) WHERE {_GOOD}),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1), lambda i: (c.v[i] - q.v[i]) * (c.v[i] - q.v[i])), lambda a, b: a + b)) AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS k FROM d)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 10
"""

_OP9 = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS x FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM d)),
m AS (SELECT x, min(doc_id) AS least FROM w GROUP BY x HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT w.doc_id, w.i FROM w JOIN m ON m.x = w.x AND m.least < w.doc_id),
isle AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g
  FROM (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM hit)),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM isle GROUP BY doc_id, g),
gap AS (SELECT s.doc_id, a, b, substring(h, 2 * b + 1, 2 * (coalesce(lead(a) OVER (PARTITION BY s.doc_id ORDER BY a), len(h) // 2) - b)) AS rest FROM span s JOIN d ON d.doc_id = s.doc_id),
gone AS (SELECT doc_id, sum(b - a) AS n, count(*) AS k, min(a) AS first, string_agg(rest, '' ORDER BY a) AS rest FROM gap GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN k IS NULL THEN h ELSE substring(h, 1, 2 * first) || rest END)) AS kept_sha256
FROM d LEFT JOIN gone ON gone.doc_id = d.doc_id
"""

ORACLES = {"op1_minhash": _OP1, "op2_ann": _OP2, "op3_decontaminate": _OP3, "op9_suffix_dedup": _OP9}
