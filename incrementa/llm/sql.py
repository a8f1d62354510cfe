"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

#: A-Z to lower case, all else as it is
LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: the 256 steps of CRC-32 by a byte, as a list
CRC = "crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps)"


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes; ``steps`` of ``crc`` has to be in reach."""
    octets = f"list_transform(range(1, 2 * strlen({text}), 2), lambda p: CAST('0x' || substr(hex({text}), p, 2) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {octets}), lambda c, b: xor(steps[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


OP4 = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""

_WORDS = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP11 = f"""
WITH {CRC},
d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
dw AS (SELECT doc_id, unnest(ws) AS w FROM d),
bw AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
every AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
bucket AS (SELECT w, {crc32('w')} % 10000 AS b FROM every CROSS JOIN crc),
counted AS (SELECT b, sum(s) AS s, sum(t) AS t FROM (SELECT w, 1 AS s, 0 AS t FROM dw UNION ALL SELECT w, 0, 1 FROM bw) JOIN bucket USING (w) GROUP BY b),
whole AS (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counted),
gain AS (SELECT b, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS BIGINT) AS g FROM counted CROSS JOIN whole),
weighed AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS weight FROM dw JOIN bucket USING (w) JOIN gain USING (b) GROUP BY doc_id),
scored AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN weighed USING (doc_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count_if(n_features >= 20) OVER () * 10 // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN n_features >= 20 AND place <= drawn THEN place END AS BIGINT) AS rank FROM placed
"""

OP12 = f"""
WITH {CRC},
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS base FROM t GROUP BY conv_id),
k AS (SELECT c.conv_id, c.base, {crc32("CAST(c.conv_id AS VARCHAR)")} % 9 AS h, coalesce(b.n, 0) AS base_n FROM c CROSS JOIN crc LEFT JOIN c b ON b.conv_id = c.base),
e AS (SELECT k.conv_id, place + 1 AS depth, role, text FROM k JOIN t ON t.conv_id = k.base AND place < h
  UNION ALL SELECT k.conv_id, least(h, base_n) + place - h + 1, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND place >= h),
named AS (SELECT conv_id, depth, strlen(text) AS bytes, sha256(depth || ':' || length(role) || ':' || role || ':' || text) AS name FROM e),
occ AS (SELECT conv_id, depth, bytes, string_agg(name, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM named UNION ALL SELECT conv_id, 0, 0, '' FROM c),
o AS (SELECT conv_id, depth, bytes, sha256(path) AS key, lag(sha256(path)) OVER (PARTITION BY conv_id ORDER BY depth) AS above, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM occ),
node AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, max(above) AS above, coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '') AS ended FROM o GROUP BY key, depth),
children AS (SELECT above AS key, count(*) AS n FROM node WHERE above IS NOT NULL GROUP BY above),
below AS (SELECT o.key, CAST(sum((node.n_convs - 1) * node.bytes) AS BIGINT) AS saved, count_if(children.n IS NULL) AS leaves FROM node LEFT JOIN children ON children.key = node.key JOIN o ON o.conv_id = node.conv_id AND o.depth <= node.depth GROUP BY o.key)
SELECT node.conv_id, CAST(node.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, node.n_convs, coalesce(children.n, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, saved AS saved_tokens, sha256(node.ended) AS ends_sha256
FROM node JOIN below ON below.key = node.key LEFT JOIN children ON children.key = node.key LEFT JOIN node p ON p.key = node.above
"""

_SPLIT = "regexp_extract_all(" + LOWER.format("coalesce(text, '')") + r", '[^\x20\x09-\x0D]+')"
OP13 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT} AS ws FROM documents),
held AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS s FROM w),
sets AS (SELECT doc_id, len(s) AS m, unnest(s) AS x FROM held),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sets a JOIN sets b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.m, b.m HAVING 100 * count(*) >= 80 * (a.m + b.m - count(*))),
r AS (SELECT doc_id AS a, doc_id AS c FROM held UNION SELECT r.a, links.b FROM r JOIN links ON links.a = r.c),
roots AS (SELECT a AS doc_id, min(c) AS component_id FROM r GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM held JOIN roots USING (doc_id)
"""

ORACLES = {"op4_exact_dedup": OP4, "op11_importance": OP11, "op12_prefix_trie": OP12, "op13_minhash": OP13}
