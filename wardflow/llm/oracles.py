"""DuckDB SQL of those contracts that SQL can express."""

OP2 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS f FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.f, c.f) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.f) = len(c.f) WHERE q.vec_id % 20 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_LOW = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOW + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""
WITH i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(t="text")} AS w FROM benchmark
           WHERE text IS NOT NULL),
g AS (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i
      WHERE len(w) > 0),
p AS (SELECT DISTINCT item, m, array_to_string(w[k : k + m - 1], ' ') AS win FROM g),
sizes AS (SELECT DISTINCT m FROM p),
d AS (SELECT doc_id, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
a AS (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS k FROM d, sizes WHERE len(w) >= m),
h AS (SELECT a.doc_id, a.m, a.k, p.item FROM a JOIN p
      ON p.m = a.m AND p.win = array_to_string(a.w[a.k : a.k + a.m - 1], ' ')),
n AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (
        SELECT doc_id, unnest(range(k, k + m)) AS x FROM (SELECT DISTINCT doc_id, m, k FROM h) y) z GROUP BY doc_id),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
      FROM (SELECT DISTINCT doc_id, item FROM h) u GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN f ON f.doc_id = d.doc_id
"""

OP8 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOW.format(t="coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[k : k + 3], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS k FROM w WHERE len(w) > 0) a),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id
         GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
          WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id,
       w.doc_id = coalesce(c.component_id, w.doc_id) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""

_TERMS = r"regexp_extract_all(" + _LOW + r", '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"

OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           {_TERMS.format(t="coalesce(text, '')")} AS w FROM documents),
t AS (SELECT lang, source, term, count(*) AS c, count(DISTINCT i) AS docs
      FROM (SELECT i, lang, source, unnest(w) AS term FROM d) x GROUP BY ALL),
l AS (SELECT lang, term, CAST(sum(c) AS BIGINT) AS c FROM t GROUP BY ALL HAVING sum(docs) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM l GROUP BY lang),
k AS (SELECT g.lang, g.source, l.term, coalesce(t.c, 0) AS c, l.c AS lc FROM g JOIN l ON l.lang = g.lang
      LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = l.term),
n AS (SELECT lang, source, sum(c) AS n FROM k GROUP BY ALL),
p AS (SELECT k.lang, k.source, term, c,
        1 + (1000000000::HUGEINT * (c + 2)) // (n.n + 2 * v.v) AS p, 1 + (1000000000::HUGEINT * (lc + 2)) // (v.n + 2 * v.v) AS q
      FROM k JOIN n ON n.lang = k.lang AND n.source = k.source JOIN v ON v.lang = k.lang),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
      FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
      FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
      LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL
      SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE c > 0 AND p > q),
s AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM s WHERE part = 'pair' OR rank <= 10
"""

OP12 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS f FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_inner_product(a.f, c.f) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id IS DISTINCT FROM c.vec_id AND len(a.f) = len(c.f) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id, score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id NULLS LAST) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id NULLS LAST) AS INTEGER) AS rank
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
  AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
QUALIFY rank <= 3
"""

OP13 = """
WITH d AS (SELECT row_number() OVER () AS i, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT i, c, substr(x, 2 * c + 1, 1198) AS x
      FROM (SELECT i, x, unnest(range(0, len(x) // 2 - 399, 200)) AS c FROM d WHERE len(x) >= 800) y),
w AS (SELECT i, c + k AS k, hash(substr(x, 2 * k + 1, 800)) AS h, hash(substr(x, 2 * k + 1, 800) || 'x') AS g
      FROM (SELECT i, c, x, unnest(range(0, len(x) // 2 - 399)) AS k FROM b) y),
r AS (SELECT i, k FROM w JOIN (SELECT h, g FROM w GROUP BY h, g HAVING count(*) > 1) t ON t.h = w.h AND t.g = w.g),
e AS (SELECT i, k, CASE WHEN k <= 400 + lag(k) OVER (PARTITION BY i ORDER BY k) THEN 0 ELSE 1 END AS new FROM r),
s AS (SELECT i, min(k) AS a, max(k) + 400 AS z
      FROM (SELECT i, k, sum(new) OVER (PARTITION BY i ORDER BY k) AS run FROM e) u GROUP BY i, run),
c AS (SELECT i, a, z, coalesce(lag(z) OVER (PARTITION BY i ORDER BY a), 0) AS before FROM s),
l AS (SELECT d.i, sum(z - a) AS n_removed, count(*) AS n_spans,
             string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(z) + 1) AS left_
      FROM c JOIN d ON d.i = c.i GROUP BY d.i)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(left_, x))) AS kept_sha256
FROM d LEFT JOIN l ON l.i = d.i
"""
