"""DuckDB SQL that recomputes the results of the registered queries in another way."""

from dossierlake.llm import licences as _licences

# All pairs that share a shingle, then the closure of the links.
NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
    ELSE list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) END) AS x
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT doc_id, doc_id FROM w),
r AS (SELECT a AS x, a AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = w.doc_id
"""

# Windows as joined strings, looked up by equality.
LEAKS = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, unnest(CASE WHEN len(ws) = 0 THEN [] ELSE
    list_transform(range(1, greatest(len(ws) - 9, 1) + 1), lambda i: array_to_string(ws[i:i + 9], ' ')) END) AS x FROM b),
n AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, unnest(range(1, len(ws) - n + 2)) AS i, ws FROM d, n WHERE len(ws) >= n),
h AS (
  SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON bw.n = dw.n AND bw.x = array_to_string(ws[i:i + dw.n - 1], ' ')),
hits AS (SELECT doc_id, count(DISTINCT w) AS k FROM (SELECT doc_id, unnest(range(i, i + n)) AS w FROM h) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS k, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(hits.k, 0)::BIGINT AS n_hit, coalesce(items.k, 0)::BIGINT AS n_items,
  sha256(coalesce(items.names, '')) AS items_sha256, coalesce(hits.k, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

EXACT = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS bare FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(bare) AS text_sha256
FROM n WINDOW w AS (PARTITION BY bare ORDER BY chars DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
"""


def licences() -> str:
    """Licence sentences within one part of the text, and runs of them by gaps; a match inside a longer one is dropped, and so is
    the reservation of all rights beside any other match."""
    known = ", ".join(f"('{text}', '{name}')" for text, name in _licences.KNOWN.items())
    rules = ", ".join(f"('{licence}', '{' '.join(ids)}', {len(ids)})" for licence, ids in _licences.ORDERED)
    return rf"""
WITH known(s, id) AS (VALUES {known}),
rules(licence, ids, n) AS (VALUES {rules}),
p AS (
  SELECT doc_id, unnest(a) AS s, generate_subscripts(a, 1) - 1 AS pos
  FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?;])[ \t]+', '\1' || chr(10), 'g'), chr(10)) AS a FROM documents)),
f AS (
  SELECT doc_id, pos, id, id = '{_licences.RESERVED}' AS bare, row_number() OVER (PARTITION BY doc_id, id = '{_licences.RESERVED}' ORDER BY pos) AS k
  FROM p JOIN known ON known.s = trim(regexp_replace(lower(p.s), '[^a-z0-9]+', ' ', 'g'))),
r AS (
  SELECT a.doc_id, a.bare, a.k, max(b.k) - a.k + 1 AS n, string_agg(b.id, ' ' ORDER BY b.k) AS ids, a.pos AS first, max(b.pos) AS last
  FROM f a JOIN (SELECT unnest(range(1, 5)) AS m) ON true
  JOIN f b ON b.doc_id = a.doc_id AND b.bare = a.bare AND b.k BETWEEN a.k AND a.k + m - 1
  GROUP BY a.doc_id, a.bare, a.k, a.pos, m HAVING count(*) = m AND max(b.pos) - a.pos + 1 - m <= {_licences.MOST_GAP} * (m - 1)),
h AS (SELECT doc_id, bare, k, rules.n, licence, rules.ids, first, last FROM r JOIN rules ON rules.ids = r.ids AND rules.n = r.n)
SELECT doc_id, licence, ids AS sentences, first, last FROM h
WHERE NOT (bare AND EXISTS (SELECT 1 FROM h o WHERE o.doc_id = h.doc_id AND NOT o.bare))
  AND NOT EXISTS (SELECT 1 FROM h o WHERE o.doc_id = h.doc_id AND o.bare = h.bare AND o.k <= h.k AND o.k + o.n >= h.k + h.n AND o.n > h.n)
"""

# Every passage of 50 words as a string, by equality.
REPEATS = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (
  SELECT doc_id, i - 1 AS i, md5(array_to_string(ws[i:i + 49], ' ')) AS x
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1 AS again, count(*) OVER (PARTITION BY x) AS n FROM p),
k AS (SELECT doc_id, i, 'spans' AS kind FROM r WHERE n > 1 UNION ALL SELECT doc_id, i, 'copies' FROM r WHERE again),
g AS (SELECT doc_id, kind, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id, kind ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM k),
h AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, kind ORDER BY i) AS run FROM g),
s AS (SELECT doc_id, kind, min(i) AS first, max(i) + 50 - min(i) AS n FROM h GROUP BY doc_id, kind, run),
t AS (SELECT doc_id, kind, string_agg(first || '+' || n, ' ' ORDER BY first) AS list, sum(n)::BIGINT AS n FROM s GROUP BY doc_id, kind)
SELECT a.doc_id, a.list AS spans, a.n AS n_repeated, coalesce(b.list, '') AS copies, coalesce(b.n, 0)::BIGINT AS n_copied
FROM t a LEFT JOIN t b ON b.doc_id = a.doc_id AND b.kind = 'copies' WHERE a.kind = 'spans'
"""

# Copies by a window over the texts, every document against every order and step.
INTERACTION = r"""
WITH w AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (
  SELECT part, doc_id,
    len(ws) < 100 AS a, 100 * len(list_distinct(ws)) < 80 * len(ws) AS b,
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e
  FROM w),
m AS (SELECT f.*, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id) USING (doc_id)),
g AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM l p, l q, l r, l s, l t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
k AS (SELECT filter_order, step, filter_order[step] AS x FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
j AS (
  SELECT part, filter_order, step, x, n, good, toxic, list_filter(['A', 'B', 'C', 'D', 'E'], lambda y, i: [a, b, c, d, e][i]) AS fails,
    list_min([v for v in list_transform(fails, lambda y: strpos(filter_order, y))]) AS out
  FROM g, k),
s AS (
  SELECT part, filter_order, step, x,
    sum(n) FILTER (out IS NULL OR out > step) AS kept, sum(n) FILTER (out = step) AS removed, sum(n) FILTER (list_contains(fails, x) AND out < step) AS redundant,
    sum(n) FILTER (fails = [x]) AS unique_fails, sum(good) FILTER (out = step) AS good_lost, sum(toxic) FILTER (out = step) AS toxic_lost
  FROM j GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  (sum(coalesce(removed, 0)) OVER (PARTITION BY part, x))::BIGINT AS shapley
FROM s
"""

# CRC-32 byte by byte, from a table that is derived from its polynomial; every feature as a string.
IMPORTANCE = r"""
WITH tab AS MATERIALIZED (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))) AS t),
w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws,
    false AS aim FROM documents
  UNION ALL
  SELECT NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), true FROM benchmark),
f AS (
  SELECT doc_id, aim, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]),
    list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS x FROM w),
n AS (SELECT doc_id, aim, x, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT x, hex(encode(x)) AS h FROM (SELECT DISTINCT x FROM n)),
c AS (
  SELECT x, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 10000 AS bucket FROM h, tab),
b AS (SELECT bucket, sum(n) FILTER (NOT aim) AS s, sum(n) FILTER (aim) AS t FROM n JOIN c USING (x) GROUP BY 1),
a AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM b),
g AS (SELECT bucket, floor(1000 * ln((coalesce(b.t, 0) + 1)::DOUBLE * (a.s + 10000)::DOUBLE / ((coalesce(b.s, 0) + 1)::DOUBLE * (a.t + 10000)::DOUBLE)))::BIGINT AS gain FROM b, a),
v AS (SELECT doc_id, sum(n * gain)::BIGINT AS weight FROM n JOIN c USING (x) JOIN g USING (bucket) WHERE NOT aim GROUP BY 1),
d AS (
  SELECT doc_id, len(ws) AS words, (len(ws) + greatest(len(ws) - 1, 0) + greatest(len(ws) - 2, 0))::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296::DOUBLE))))::BIGINT AS score
  FROM w LEFT JOIN v USING (doc_id) WHERE NOT aim),
r AS (SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS k, count(*) FILTER (words >= 20) OVER () AS able FROM d)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND k <= 5 * able // 100 THEN k END AS rank FROM r
"""
