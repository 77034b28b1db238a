"""DuckDB SQL that gives the rows of the queries of this subpackage, where SQL can express them."""

from __future__ import annotations

from lexloom.llm.mixing import BLOCK_DIGITS, HALVINGS, PLACES
from lexloom.llm.queries import JUNK_MARKS, MIX, URL_RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1), lambda i: concat_ws(' ', words[i], words[i + 1], words[i + 2]))
      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS s FROM w),
f AS (SELECT DISTINCT doc_id, s FROM g),
n AS (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM f x JOIN f y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 90 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, reach) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.reach)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id)::BIGINT AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node, min(reach) AS c FROM r GROUP BY node) c ON c.node = d.doc_id
"""

_shares = "list_transform(a.shares, lambda t: pow(t, {x}))"
_entropy = f"ln(list_sum({_shares})) - list_sum(list_transform({_shares}, lambda p: p * ln(p))) / list_sum({_shares}) >= {MIX['entropy']} * ln(len(a.shares)) - 1e-12"
OP3 = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
t AS (SELECT coalesce(source, chr(0)) AS s, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY 1),
a AS (SELECT list(tokens / total ORDER BY tokens) AS shares, any_value(total) AS total FROM (SELECT tokens, (sum(tokens) OVER ())::DOUBLE AS total FROM t WHERE tokens > 0)),
b(i, good, bad) AS (SELECT 0, CASE WHEN {_entropy.format(x="1.0")} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, 1.0::DOUBLE FROM a
  UNION ALL SELECT i + 1, CASE WHEN {_entropy.format(x="((good + bad) / 2)")} THEN (good + bad) / 2 ELSE good END, CASE WHEN {_entropy.format(x="((good + bad) / 2)")} THEN bad ELSE (good + bad) / 2 END FROM b, a WHERE i < {HALVINGS}),
e AS (SELECT round(good, {PLACES}) AS x FROM b WHERE i = {HALVINGS}),
z AS (SELECT x, list_sum({_shares.format(x="e.x")}) AS z, a.total FROM a, e),
q AS (SELECT s, coalesce(tokens, 1) AS tokens, CASE WHEN tokens = 0 THEN 1 WHEN x = 1 THEN floor(tokens::DECIMAL(19, 0) * {MIX['budget']}::DECIMAL(9, 6))::BIGINT ELSE floor(total * {MIX['budget']} * pow(tokens / total, x) / z)::BIGINT END AS quota FROM t, z),
q1 AS (SELECT s, CASE WHEN tokens > 0 THEN tokens ELSE 1 END AS tokens, quota FROM q),
l AS (SELECT doc_id, source, n_tokens, s, quota // tokens AS pass, quota % tokens AS room, md5('mix|' || (quota // tokens)::VARCHAR || '|' || doc_id::VARCHAR) AS h FROM d JOIN q1 ON q1.s = coalesce(source, chr(0)) WHERE quota % tokens > 0),
k AS (SELECT *, sum(n_tokens) OVER (PARTITION BY s ORDER BY substr(h, 1, {BLOCK_DIGITS}), h, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM l),
u AS (SELECT doc_id, source, pass::BIGINT AS pass, n_tokens FROM k WHERE running <= room
UNION ALL SELECT doc_id, source, unnest(range(quota // tokens))::BIGINT AS pass, n_tokens FROM d JOIN q1 ON q1.s = coalesce(source, chr(0)) WHERE quota >= tokens)
SELECT *, row_number() OVER (PARTITION BY source, pass ORDER BY md5('mix|' || pass || '|' || doc_id), doc_id::VARCHAR) - 1 AS position FROM u
"""

_words = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+')"


OP5 = f"""
WITH doc_id_w AS (SELECT DISTINCT doc_id, {_words} AS w FROM documents WHERE doc_id IS NOT NULL),
item_id_w AS (SELECT DISTINCT item_id, {_words} AS w, len({_words}) AS n FROM benchmark WHERE item_id IS NOT NULL AND len({_words}) > 0),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM doc_id_w),
y AS (SELECT item_id, n, unnest(w) AS word, generate_subscripts(w, 1) AS place FROM item_id_w),
h AS (SELECT doc_id, item_id, n, x.place - y.place AS shift, list(y.place) AS equal FROM x JOIN y USING (word) GROUP BY ALL HAVING count(*) * 100 >= 80 * least(13, n)),
p AS (SELECT doc_id, item_id, n, len(equal) AS s, least(13, n) AS l, list_max(list_transform(range(1, n - least(13, n) + 2), lambda i: len(list_filter(equal, lambda j: j >= i AND j < i + least(13, n))))) AS best FROM h)
SELECT doc_id, item_id, max(s)::INTEGER AS n_equal, max(n)::INTEGER AS n_words FROM p WHERE best * 100 >= 80 * l GROUP BY doc_id, item_id
"""

_rules = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
OP6 = f"""
WITH b AS (SELECT page_id, url, html, CASE WHEN instr(url, '://') > 0 THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, url, html, coalesce(rest, '') AS rest, CASE WHEN instr(coalesce(rest, ''), '/') > 0 THEN substr(rest, 1, instr(rest, '/') - 1) ELSE coalesce(rest, '') END AS raw FROM b),
p AS (SELECT page_id, html, translate(raw, '{UPPER}', '{LOWER}') AS host, substr(rest, length(raw) + 1) AS path FROM s),
c AS (SELECT *, regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') AS canon FROM p),
listed AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(html, '{JUNK_MARKS}') AND canon <> ''),
r(rh, rp, v) AS (VALUES {_rules}),
f AS (SELECT page_id, arg_max(rh || rp, (length(rh) + length(rp), rh, rp)) AS rule, arg_max(v, (length(rh) + length(rp), rh, rp)) AS v
      FROM c JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT c.page_id, host, path, rule, coalesce(v, CASE WHEN canon <> '' AND canon IN (SELECT canon FROM listed) THEN 'block' ELSE 'allow' END) AS verdict FROM c LEFT JOIN f USING (page_id)
"""

OP8 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x)),
k AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM k WHERE rank <= 20
"""

OP12 = f"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 3),
vs AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY ALL),
c AS (SELECT w.lang, source, w.term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT a.lang, a.source, coalesce((SELECT sum(c) FROM c WHERE c.lang = a.lang AND c.source = a.source), 0) AS n
      FROM (SELECT DISTINCT lang, source FROM d) a),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, 1 + 1000000000::HUGEINT * (coalesce(c.c, 0) + 1) // (g.n + v.v)::HUGEINT AS p,
             1 + 1000000000::HUGEINT * (k.c + 1) // (v.n + v.v)::HUGEINT AS q
      FROM g JOIN kept k USING (lang) JOIN vs v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS other, sum((x.p - y.p) * (x.p - y.p) // y.p) AS value
             FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 200
"""

OP13 = f"""
WITH d AS (
  SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text FROM documents),
ws AS (SELECT lang, unnest([regexp_extract_all(x, '[^\\x20\\x09]+') FOR x IN regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')]) AS ws FROM d),
g AS (SELECT lang, k, unnest([array_to_string(ws[s:s + k - 1], ' ') FOR s IN range(1, len(ws) - k + 2)]) AS p
      FROM ws, (VALUES (1), (2), (3), (4)) AS v(k)),
f AS (SELECT lang, k, p, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY ALL),
c AS (SELECT lang, k, p, string_split(p, ' ') AS w, f AS a FROM f WHERE k > 1 AND f >= 30),
parts AS (SELECT lang, p, a, cut, array_to_string(w[:cut], ' ') AS lp, array_to_string(w[cut + 1:], ' ') AS rp
          FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
cuts AS (SELECT parts.*, x.f AS l, y.f AS r, 2000000 * a // (x.f + y.f) AS score
         FROM parts JOIN f x ON x.lang = parts.lang AND x.p = lp JOIN f y ON y.lang = parts.lang AND y.p = rp),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
inside AS (SELECT lang, array_to_string(w[s:s + m - 1], ' ') AS p, max(a) AS around
           FROM (SELECT *, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY ALL)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM (
  SELECT b.lang, b.p AS phrase, a, l, r, n, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.p)) AS rank
  FROM best b JOIN n USING (lang) LEFT JOIN inside USING (lang, p)
  WHERE around IS NULL OR 100 * around < 80 * a)
WHERE rank <= 2000
"""

ORACLES = {
    "op1_jaccard_join": OP1, "op3_temperature_mixing": OP3, "op5_decontaminate": OP5, "op6_url_filter": OP6, "op8_bit_sliced_top_k": OP8,
    "op12_source_divergence": OP12, "op13_collocations": OP13,
}
