"""DuckDB equivalents of the queries that SQL can express over whole tables."""

from __future__ import annotations

from .decontaminate import OP4_SQL
from .licenses import PHRASES, TEMPLATES, THRESHOLD

_SPACE = r"[\x09-\x0D\x20]+"
_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_PHRASE_ROWS = ", ".join(f"('{p}', {len(p.split())}, '{label}')" for p, label in PHRASES.items())
_TEMPLATE_ROWS = ", ".join(f"('{label}', '{text}')" for label, text in TEMPLATES.items())

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({_ASCII_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
ph(phrase, k, label) AS (VALUES {_PHRASE_ROWS}), tp(label, body) AS (VALUES {_TEMPLATE_ROWS}),
tw AS (SELECT label, len(string_split(body, ' ')) AS span, len(list_distinct(string_split(body, ' '))) AS size, unnest(list_distinct(string_split(body, ' '))) AS word FROM tp),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
base AS (SELECT doc_id, i - 1 AS i, label FROM pos, ph WHERE array_to_string(w[i:i + k - 1], ' ') = phrase),
hit AS (SELECT doc_id, label, span, size, i, w[i] AS word FROM pos JOIN tw ON w[i] = tw.word),
win AS (SELECT a.doc_id, a.label, a.size, a.i, count(DISTINCT b.word) AS n FROM hit a JOIN hit b ON a.doc_id = b.doc_id AND a.label = b.label AND b.i BETWEEN a.i AND a.i + a.span - 1 GROUP BY 1, 2, 3, 4),
found AS (SELECT doc_id, label, max(n) / any_value(size) AS score FROM win GROUP BY 1, 2 HAVING max(n) >= ceil({THRESHOLD} * any_value(size) - 1e-9)),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS f, max(i) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY 1),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM (SELECT doc_id, label, 1.0 AS score FROM base UNION ALL SELECT * FROM found) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(f AS BIGINT) AS first_word, CAST(l AS BIGINT) AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels, CAST(coalesce(a.score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN a ON d.doc_id = a.doc_id
"""

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
m AS (SELECT k, min(doc_id) AS f FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN m USING (k) WHERE doc_id > f),
g AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(list_filter(w, lambda x, i: NOT coalesce(list_contains(ps, i), false)), ' ')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""

OP6_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({_ASCII_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT doc_id, i, w[i] AS a, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS c
      FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
c1 AS (SELECT a, count(*) AS n FROM t GROUP BY a),
c2 AS (SELECT b, a, count(*) AS n FROM t WHERE b IS NOT NULL GROUP BY b, a),
c3 AS (SELECT c, b, a, count(*) AS n FROM t WHERE c IS NOT NULL GROUP BY c, b, a),
s AS (SELECT t.doc_id, coalesce(c3.n, 0) >= 2 AS top,
      CASE WHEN c3.n >= 2 THEN log10(c3.n / x2.n)
           WHEN c2.n >= 2 THEN log10(c2.n / x1.n) + (least(t.i, 3) - 2) * log10(0.4::DOUBLE)
           ELSE log10(c1.n / (SELECT count(*) FROM t)) + (least(t.i, 3) - 1) * log10(0.4::DOUBLE) END AS v
      FROM t JOIN c1 ON t.a = c1.a LEFT JOIN c2 ON t.b = c2.b AND t.a = c2.a
      LEFT JOIN c3 ON t.c = c3.c AND t.b = c3.b AND t.a = c3.a LEFT JOIN c1 x1 ON t.b = x1.a LEFT JOIN c2 x2 ON t.c = x2.b AND t.b = x2.a),
g AS (SELECT doc_id, count(*) AS n, sum(CAST(top AS BIGINT)) AS tops, sum(v) AS v FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(tops, 0) AS BIGINT) AS n_top,
       round(coalesce(v, 0.0), 6) AS log10_score, round(v / n, 6) AS mean_log10
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""

OP8_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_ASCII_LOWER}, '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 85 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id,
       coalesce(c.component_id, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN c ON d.doc_id = c.doc_id
"""

OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array({_ASCII_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array({_ASCII_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
it AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(w) AS term FROM b)),
s AS (SELECT count(*) AS N, CAST(sum(len(w)) AS BIGINT) AS L FROM d WHERE len(w) > 0),
m AS (SELECT r, 100 - 50 + ((50 * len(w) * N) // L) AS m FROM d, s WHERE len(w) > 0),
t AS (SELECT r, doc_id, term, count(*) AS tf FROM (SELECT r, doc_id, unnest(w) AS term FROM d) SEMI JOIN it USING (term) GROUP BY 1, 2, 3),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * N + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM t, s GROUP BY term, N),
sc AS (SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
       FROM it JOIN t USING (term) JOIN wt USING (term) JOIN m USING (r) GROUP BY 1, 2, 3),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50
"""

_CRC32 = "xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda acc, b: list_reduce(range(8), lambda a, k: xor(a >> 1, 3988292384 * (a & 1)), xor(acc, b)), 4294967295::BIGINT), 4294967295::BIGINT)"

OP13_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'k': md5(concat(length(role), ':', role, text)), 'n': length(text)}} ORDER BY pos) AS w FROM t GROUP BY conv_id),
h AS (SELECT conv_id, w, {_CRC32} % 6 AS h FROM c),
re AS (SELECT h.conv_id, list_concat(coalesce(b.w[1:h.h], []), h.w[h.h + 1:]) AS s FROM h LEFT JOIN c b ON b.conv_id = h.conv_id - h.conv_id % 100),
p AS (SELECT conv_id, d, array_to_string(list_transform(s[1:d], lambda x: x.k), '') AS k, len(s) = d AS ended, CASE WHEN d > 0 THEN s[d].n ELSE 0 END AS chars
      FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM re)),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ended) AS ends FROM p GROUP BY k, d),
ch AS (SELECT left(k, (d - 1) * 32) AS k, count(*) AS n FROM n WHERE d > 0 GROUP BY 1),
below AS (SELECT left(n.k, e * 32) AS k, (n.n - 1) * chars AS saved, CASE WHEN ch.n IS NULL THEN 1 ELSE 0 END AS leaf FROM (SELECT n.*, unnest(range(0, d + 1)) AS e FROM n) n LEFT JOIN ch ON n.k = ch.k),
sub AS (SELECT k, sum(saved) AS saved, sum(leaf) AS leaves FROM below GROUP BY k)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(ch.n, 0) AS n_children, CAST(sub.leaves AS BIGINT) AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM n JOIN sub ON n.k = sub.k LEFT JOIN ch ON n.k = ch.k LEFT JOIN n up ON n.d > 0 AND up.k = left(n.k, (n.d - 1) * 32)
"""

ORACLE_SQL = {
    "op1_license": OP1_SQL,
    "op3_substring": OP3_SQL,
    "op4_decontaminate": OP4_SQL,
    "op6_language_model": OP6_SQL,
    "op8_minhash": OP8_SQL,
    "op12_search": OP12_SQL,
    "op13_trie": OP13_SQL,
}
