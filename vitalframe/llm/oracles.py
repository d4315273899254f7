"""DuckDB SQL of the contract rows that do not depend on an operator's method."""

from __future__ import annotations

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Words of a text, A-Z in lower case.
WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\\x20\\x09-\\x0D]+')"


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes: the register takes the message bit by bit, lowest bits first."""
    pairs = f"regexp_extract_all(hex(encode({text})), '..')"
    bits = f"flatten(list_transform({pairs}, lambda p: list_transform(range(8), lambda b: (CAST('0x' || p AS BIGINT) >> b) & 1)))"
    step = "lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bits}), {step}), 4294967295)"


def _reach(nodes: str, links: str) -> str:
    """Least node reachable from every node; ``links`` holds both directions."""
    return f"""reach AS (SELECT node, node AS seen FROM {nodes} UNION SELECT r.node, l.y FROM reach r JOIN {links} l ON l.x = r.seen),
least AS (SELECT node, MIN(seen) AS component_id FROM reach GROUP BY node)"""


NEAR_DUPLICATES = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [ws] ELSE list_transform(range(len(ws) - 4), lambda i: ws[i + 1 : i + 5]) END) AS s FROM w),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM shingles GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(md5(CAST(s AS VARCHAR)), '' ORDER BY md5(CAST(s AS VARCHAR)))) AS mark FROM shingles GROUP BY doc_id),
same AS (SELECT mark, MIN(doc_id) AS node FROM sets GROUP BY mark),
few AS (SELECT doc_id, s FROM shingles WHERE doc_id IN (SELECT node FROM same)),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS k FROM few a JOIN few b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * k >= 75 * (p.n + q.n - k)),
nodes AS (SELECT node FROM same),
{_reach('nodes', 'links')}
SELECT d.doc_id AS doc_id, CAST(coalesce(z.n, 0) AS BIGINT) AS n_shingles, coalesce(l.component_id, d.doc_id) AS component_id, coalesce(l.component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes z USING (doc_id) LEFT JOIN sets USING (doc_id) LEFT JOIN same USING (mark) LEFT JOIN least l ON l.node = same.node"""

EMBEDDINGS = f"""WITH RECURSIVE v AS (SELECT vec_id AS node, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fine AS (SELECT node, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
 AND list_bool_and(list_transform(e, lambda x: coalesce(isfinite(x), false))) AND list_dot_product(e, e) > 0),
links AS (SELECT a.node AS x, b.node AS y FROM fine a JOIN fine b ON a.label = b.label AND a.node <> b.node WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
{_reach('v', 'links')}
SELECT v.node AS vec_id, (SELECT COUNT(*) FROM links WHERE x = v.node) AS n_links, component_id, v.node = component_id AS kept FROM v JOIN least ON least.node = v.node"""

SPELLING = f"""WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS i, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), '{UPPER}', '{UPPER.lower()}') AS r FROM documents),
coded AS (SELECT r, {crc32("i || ':' || r")} AS h FROM runs),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word FROM coded),
words AS (SELECT word, COUNT(*) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING COUNT(*) >= 2),
less AS (SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS v FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)),
near AS (SELECT a.word AS word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.k = b.k AND a.v = b.v AND length(a.word) = length(b.word) AND a.word <> b.word
 UNION SELECT l.word, w.word, w.n FROM less l JOIN words w ON w.word = l.v UNION SELECT w.word, l.word, l.n FROM less l JOIN words w ON w.word = l.v),
best AS (SELECT word, COUNT(*) AS n_near, MAX(m) AS m FROM near GROUP BY word),
form AS (SELECT w.word AS word, w.n AS n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 10 * w.n THEN (SELECT MIN(other) FROM near x WHERE x.word = w.word AND x.m = b.m) END AS form, CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n
 FROM words w LEFT JOIN best b ON b.word = w.word),
walk AS (SELECT word, word AS here, 0 AS steps FROM form UNION ALL SELECT k.word, f.form, k.steps + 1 FROM walk k JOIN form f ON f.word = k.here WHERE f.form IS NOT NULL),
last AS (SELECT word, arg_max(here, steps) AS root FROM walk GROUP BY word)
SELECT form.word AS word, form, root, n, n_near, form_n FROM form JOIN last ON last.word = form.word"""

PREFIX_TRIE = f"""WITH own AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS ts
 FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT conv_id, ts, {crc32('CAST(conv_id AS VARCHAR)')} % 4 AS h FROM own),
built AS (SELECT a.conv_id AS c, list_concat(coalesce(b.ts[1 : a.h], []), a.ts[a.h + 1 :]) AS ts FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
paths AS (SELECT c, len(ts) AS n, unnest(range(len(ts) + 1)) AS d, ts FROM built),
members AS (SELECT c, n, d, md5(CAST(ts[1 : d] AS VARCHAR)) AS node, CASE WHEN d > 0 THEN md5(CAST(ts[1 : d - 1] AS VARCHAR)) END AS parent, CASE WHEN d > 0 THEN len(regexp_extract_all(ts[d].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS words FROM paths),
nodes AS (SELECT node, d, any_value(parent) AS parent, MIN(c) AS conv_id, COUNT(*) AS n_convs, (COUNT(*) - 1) * any_value(words) AS saved, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE n = d), '')) AS ends FROM members GROUP BY node, d),
kids AS (SELECT parent, d - 1 AS d, COUNT(*) AS k FROM nodes WHERE parent IS NOT NULL GROUP BY ALL),
full_nodes AS (SELECT x.*, coalesce(k.k, 0) AS n_children FROM nodes x LEFT JOIN kids k ON k.parent = x.node AND k.d = x.d),
below AS (SELECT DISTINCT a.node AS top, a.d AS top_d, b.node AS node, b.d AS d FROM members a JOIN members b ON a.c = b.c AND b.d >= a.d),
sums AS (SELECT top, top_d, SUM(x.saved) AS saved, COUNT(*) FILTER (WHERE x.n_children = 0) AS n_leaves FROM below JOIN full_nodes x ON x.node = below.node AND x.d = below.d GROUP BY top, top_d)
SELECT x.conv_id AS conv_id, CAST(x.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, x.n_convs AS n_convs, CAST(x.n_children AS BIGINT) AS n_children, s.n_leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
FROM full_nodes x LEFT JOIN nodes p ON p.node = x.parent AND p.d = x.d - 1 JOIN sums s ON s.top = x.node AND s.top_d = x.d"""
