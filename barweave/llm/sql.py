"""SQL counterparts of the corpus queries."""

from __future__ import annotations

import string

LOW = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"

NEAR_DUPLICATES = f"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOW}), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM words),
items AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, e.b FROM reach r JOIN ends e ON r.other = e.a),
comp AS (SELECT id, min(other) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN comp ON id = doc_id"""

CONTAMINATION = f"""WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {LOW}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {LOW}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
wins AS (SELECT DISTINCT item_id, w, array_to_string(ws[i:i + w - 1], ' ') AS g FROM (
  SELECT item_id, ws, least(len(ws), 10) AS w, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM bw WHERE len(ws) > 0) AS x),
dwin AS (SELECT doc_id, w, i, array_to_string(ws[i:i + w - 1], ' ') AS g FROM (
  SELECT doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) AS i FROM dw, (SELECT DISTINCT w FROM wins) AS l) AS x),
hits AS (SELECT d.doc_id, d.i, d.w, n.item_id FROM dwin d JOIN wins n ON d.w = n.w AND d.g = n.g),
hit_words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + w)) AS p FROM hits) AS x GROUP BY 1),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) AS x GROUP BY 1),
placed AS (SELECT item_id, rn, w, i AS q, array_to_string(ws[i:i + w - 1], ' ') AS g FROM (
  SELECT item_id, rn, ws, least(len(ws), 10) AS w, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS i FROM (SELECT *, row_number() OVER () AS rn FROM bw) AS y WHERE len(ws) > 0) AS x),
runs AS (SELECT doc_id, rn, i - q AS diagonal, i, w, i - row_number() OVER (PARTITION BY doc_id, rn, i - q ORDER BY i) AS island
  FROM dwin d JOIN placed p USING (w, g)),
longest AS (SELECT doc_id, max(n) AS longest_match, arg_max(start, row(n, -start)) AS longest_start FROM (
  SELECT doc_id, min(i) - 1 AS start, max(i) - min(i) + max(w) AS n FROM runs GROUP BY doc_id, rn, diagonal, island) AS x GROUP BY 1)
SELECT dw.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  CAST(longest_match AS BIGINT) AS longest_match, CAST(longest_start AS BIGINT) AS longest_start
FROM dw LEFT JOIN hit_words USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN longest USING (doc_id)"""

TOP_PRODUCTS = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

CAPTURES = """WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id < top THEN top END AS refers_to FROM g"""

HARD_NEGATIVES = """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5"""
