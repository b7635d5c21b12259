"""DuckDB twins of the queries that SQL can say, over the same tables."""

from __future__ import annotations

SHARDS = 8

# The checksum's table follows from its polynomial; texts are read byte by byte from their hexadecimal form.
OP3 = f"""WITH step AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS t),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, (strlen(coalesce(text, '')) + 1)::BIGINT AS size,
 xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295)) AS text_crc32 FROM documents, step),
h AS (SELECT *, list_transform(range({SHARDS + 1}), lambda s: ('0x' || substr(md5(k || ':' || s), 1, 13))::BIGINT) AS draws FROM d),
p AS (SELECT *, (list_position(draws[1:{SHARDS}], list_max(draws[1:{SHARDS}])) - 1)::INT AS shard, (list_position(draws, list_max(draws)) - 1)::INT AS grown_shard FROM h)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5(k || ':slot'), doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM p"""

OP5 = r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
g AS (SELECT t, first(doc_id ORDER BY n DESC, doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)"""

OP6 = """WITH c AS (SELECT conv_id, turn, 'u' || turn AS call_id, text FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, 'u' || (turn - 1) AS call_id, count(*) AS answers, min(turn) AS result_turn, first(text ORDER BY turn, text NULLS FIRST) AS content FROM conversations WHERE role = 'assistant' GROUP BY 1, 2),
u AS (SELECT conv_id, call_id, count(*) AS uses FROM c GROUP BY 1, 2),
p AS (SELECT c.*, a.result_turn, a.content, concat_ws(',', CASE WHEN c.text IS NULL THEN 'missing prompt' END, CASE WHEN length(c.text) > 20000 THEN 'long prompt' END, CASE WHEN uses > 1 THEN 'repeated identifier' END,
 CASE WHEN answers IS NULL THEN 'no result' END, CASE WHEN answers > 1 THEN 'several results' END, CASE WHEN turn >= 2 AND NOT EXISTS (FROM c b WHERE b.conv_id = c.conv_id AND b.turn = c.turn - 2) THEN 'missing need' END) AS problems
 FROM c LEFT JOIN a USING (conv_id, call_id) LEFT JOIN u USING (conv_id, call_id))
SELECT conv_id, turn, call_id, 'reply' AS name, turn AS ready_turn, 0 AS hops, result_turn, problems = '' AS valid, problems,
 '{"arguments":{' || CASE WHEN text IS NULL THEN '' ELSE '"prompt":' || json_quote(text) || ',' END || '"turn":' || turn || '},"call_id":' || json_quote(call_id) || ',"name":"reply","result":' || coalesce(json_quote(content)::VARCHAR, 'null') || '}' AS json FROM p
UNION ALL SELECT conv_id, turn, call_id, NULL, turn, 0, turn, false, CASE WHEN k IS NULL THEN concat_ws(',', CASE WHEN conv_id IS NULL OR call_id IS NULL THEN 'no identifier' END, 'no call') ELSE 'surplus result' END,
 '{"arguments":null,"call_id":' || coalesce(json_quote(call_id)::VARCHAR, 'null') || ',"name":null,"result":' || coalesce(json_quote(text)::VARCHAR, 'null') || '}'
 FROM (SELECT m.*, CASE WHEN u.call_id IS NOT NULL THEN row_number() OVER (PARTITION BY m.conv_id, m.call_id ORDER BY m.turn, m.text NULLS FIRST) END AS k FROM (SELECT *, 'u' || (turn - 1) AS call_id FROM conversations WHERE role = 'assistant') m LEFT JOIN u USING (conv_id, call_id)) WHERE k IS NULL OR k > 1
UNION ALL SELECT conv_id, turn, NULL, 'message', turn, 0, NULL, problems = '', problems, '{"content":' || coalesce(json_quote(text)::VARCHAR, 'null') || ',"role":' || coalesce(json_quote(role)::VARCHAR, 'null') || '}'
 FROM (SELECT *, concat_ws(',', CASE WHEN conv_id IS NULL THEN 'no identifier' END, CASE WHEN role IS NULL THEN 'no role' WHEN role <> 'system' THEN 'unknown role' END) AS problems FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant', 'tool'))"""

OP9 = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS l FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 4 THEN [array_to_string(l, ' ')] ELSE list_distinct(list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i + 3], ' '))) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM o JOIN n i ON i.doc_id = x JOIN n j ON j.doc_id = y WHERE 100 * shared >= 80 * (i.k + j.k - shared)),
r AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY 1)
SELECT doc_id, coalesce(k, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM w JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)"""

# As in OP3, the checksum's table follows from its polynomial; a subtree's nodes are found through the path of their smallest member.
OP11 = """WITH step AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i)) AS t),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(conv_id::VARCHAR), '..'), lambda x: ('0x' || x)::BIGINT), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295)) % 6 AS h FROM (SELECT DISTINCT conv_id FROM o), step),
f AS (SELECT c.conv_id, o.p AS d, role, text FROM c JOIN o ON o.conv_id = c.base AND o.p <= c.h),
n AS (SELECT conv_id, count(*) AS n FROM f GROUP BY 1),
r AS (SELECT * FROM f UNION ALL SELECT o.conv_id, o.p - c.h + coalesce(n.n, 0), role, text FROM o JOIN c USING (conv_id) LEFT JOIN n USING (conv_id) WHERE o.p > c.h),
k AS (SELECT conv_id, d, length(text) AS chars, md5(string_agg(md5(md5(role) || md5(text)), '') OVER (PARTITION BY conv_id ORDER BY d)) AS k FROM r UNION ALL SELECT conv_id, 0, 0, '' FROM c),
m AS (SELECT d, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM k GROUP BY 1, 2),
u AS (SELECT m.*, q.conv_id AS parent FROM m LEFT JOIN k ON k.conv_id = m.conv_id AND k.d = m.d - 1 LEFT JOIN m q ON q.d = k.d AND q.k = k.k),
kids AS (SELECT d - 1 AS d, parent AS conv_id, count(*) AS n_children FROM u WHERE d > 0 GROUP BY 1, 2),
v AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN kids USING (d, conv_id)),
s AS (SELECT k.d, k.k, sum(CASE WHEN v.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.chars) AS saved_tokens FROM v JOIN k ON k.conv_id = v.conv_id AND k.d <= v.d GROUP BY 1, 2),
l AS (SELECT conv_id, max(d) AS d FROM k GROUP BY 1),
e AS (SELECT d, k, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM k JOIN l USING (conv_id, d) GROUP BY 1, 2)
SELECT conv_id::BIGINT AS conv_id, d::BIGINT AS depth, parent::BIGINT AS parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
 FROM v JOIN s USING (d, k) LEFT JOIN e USING (d, k)"""

OP13 = r"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS l FROM documents WHERE text IS NOT NULL),
x AS (SELECT count(*) AS n, sum(len(l))::BIGINT AS total FROM d WHERE len(l) > 0),
q AS (SELECT item_id, md5(text) AS tag, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL)),
a AS (SELECT item_id, tag, term, count(*) AS times FROM q GROUP BY 1, 2, 3),
p AS (SELECT r, doc_id, len(l) AS size, unnest(l) AS term FROM d),
t AS (SELECT r, doc_id, size, term, count(*) AS tf FROM p GROUP BY 1, 2, 3, 4),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM t, x GROUP BY term, n),
s AS (SELECT item_id, tag, r, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * size * n) // total))))::BIGINT AS score FROM a JOIN w USING (term) JOIN t USING (term), x GROUP BY 1, 2, 3, 4)
SELECT item_id, row_number() OVER (PARTITION BY item_id, tag ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score FROM s WHERE score > 0
 QUALIFY rank <= 20"""
