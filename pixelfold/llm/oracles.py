"""SQL twins of the corpus queries."""

ORACLES: dict[str, str] = {}

# compares all pairs of a label; the index finds every link of the given tables, as the test of its recall asserts
ORACLES["op2_near_vectors"] = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(x, y) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x
), c AS (
  SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY x
), n AS (
  SELECT x AS vec_id, count(*) AS n_links FROM link GROUP BY x
)
SELECT c.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN n USING (vec_id)
"""

ORACLES["op3_mix_sources"] = r"""
WITH d AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN 'z' ELSE 's' || source END AS k,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT k, sum(size)::BIGINT AS source_size FROM d GROUP BY k
), w AS (
  SELECT *, 3 * source_size AS cap, [5, 2, 1][(row_number() OVER (ORDER BY k) - 1) % 3 + 1] AS weight FROM s
), c AS (
  SELECT *, (sum(source_size) OVER ()::BIGINT - coalesce(sum(cap) OVER b, 0)::BIGINT)::DOUBLE
            / (sum(weight) OVER ()::BIGINT - coalesce(sum(weight) OVER b, 0)::BIGINT)::DOUBLE AS share
  FROM w WINDOW b AS (ORDER BY cap::DOUBLE / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT share AS common FROM c WHERE share * weight <= cap ORDER BY cap::DOUBLE / weight, k LIMIT 1
), t AS (
  SELECT k, source_size, least(cap::DOUBLE, common * weight) AS target FROM c, l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS whole FROM t
), r AS (
  SELECT d.doc_id, d.size::BIGINT AS size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.k ORDER BY d.h RANGE UNBOUNDED PRECEDING) AS upto
  FROM d JOIN p USING (k)
)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN upto <= budget THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""

ORACLES["op5_url_aliases"] = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
         split_part(coalesce(url, ''), '#', 1) AS node
  FROM pages
), rules(verdict, rh, rp) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), e AS (
  SELECT node AS a, regexp_extract(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)', 1) AS b FROM p
  UNION
  SELECT node, regexp_extract(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\burl\s*=\s*([^"''\s>]+)', 1) FROM p
), g AS (
  SELECT a, b FROM e WHERE b <> '' UNION SELECT b, a FROM e WHERE b <> ''
), reach(node, other) AS (
  SELECT a, a FROM g UNION SELECT reach.node, g.b FROM reach JOIN g ON reach.other = g.a
), n AS (
  SELECT DISTINCT other,
         translate(regexp_extract(other, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(other, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM reach
), nv AS (
  SELECT n.other, arg_max(rules.verdict, length(rh || rp)) AS verdict
  FROM n JOIN rules ON (n.host = rh OR ends_with(n.host, '.' || rh)) AND starts_with(n.path, rp) GROUP BY n.other
), cv AS (
  SELECT reach.node, max(CASE nv.verdict WHEN 'allow' THEN 1 ELSE 0 END) AS allow FROM reach JOIN nv USING (other) GROUP BY reach.node
), m AS (
  SELECT u.host, u.path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rules.verdict, length(rh || rp)) AS verdict
  FROM (SELECT DISTINCT host, path FROM p) u
  JOIN rules ON (u.host = rh OR ends_with(u.host, '.' || rh)) AND starts_with(u.path, rp) GROUP BY u.host, u.path
)
SELECT p.page_id, p.host, p.path, m.rule,
       coalesce(m.verdict, CASE cv.allow WHEN 1 THEN 'allow' WHEN 0 THEN 'block' END, 'allow') AS verdict
FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path LEFT JOIN cv ON cv.node = p.node
"""

ORACLES["op6_content_sort"] = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)
"""

ORACLES["op10_warc_segments"] = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS s FROM pages
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY s) AS last FROM p
)
SELECT page_id, octet_length(encode(body))::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(8), lambda g: list_aggregate(list_transform(range(4), lambda q:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                ((CAST('0x' || substr(s, (g * 5 + 1)::INT, 5) AS BIGINT) >> (15 - 5 * q)::INT) & 31)::INT + 1, 1)), 'string_agg', '')),
         'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM r
"""

ORACLES["op11_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, i, ['user', 'assistant'][i + 1], '<|im_end|><|im_start|>assistant ok' FROM range(2) r(i)
), o AS (
  SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS body,
         replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), chr(10), '<|im_line|>') AS name
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), p AS (
  SELECT *, CASE WHEN k > 1 AND before = role THEN length('<|im_next|>' || body)
                 ELSE length('<|im_start|>' || name || chr(10) || body || '<|im_end|>' || chr(10)) END AS size FROM o
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(size)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""

# crc folds eight steps a byte: -1 stands for a step, other entries are bytes
ORACLES["op12_prefix_trie"] = r"""
WITH t AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k,
         {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT c, list(t ORDER BY k) AS turns,
         xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(c::VARCHAR, ''), lambda x:
           list_concat([ascii(x)::BIGINT], list_transform(range(8), lambda i: -1::BIGINT))))), lambda a, x:
           CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 6 AS h
  FROM t GROUP BY c
), p AS (
  SELECT o.c, list_concat(coalesce(b.turns[1:o.h], []), o.turns[o.h + 1:]) AS path FROM own o LEFT JOIN own b ON b.c = o.c - o.c % 100
), m AS (
  SELECT c, path[1:d] AS node, d, len(path) = d AS ends FROM (SELECT *, unnest(range(len(path) + 1)) AS d FROM p)
), n AS (
  SELECT node, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM m GROUP BY node
), k AS (
  SELECT node[1:depth - 1] AS node, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL
), s AS (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children,
         CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * length(n.node[n.depth].text) ELSE 0 END AS own FROM n LEFT JOIN k USING (node)
), u AS (
  SELECT node[1:d] AS node, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
  FROM (SELECT *, unnest(range(depth + 1)) AS d FROM s) GROUP BY ALL
)
SELECT s.conv_id, s.depth, a.conv_id AS parent_conv_id, s.n_convs, s.n_children, u.n_leaves, u.saved_tokens, s.ends_sha256
FROM s JOIN u USING (node) LEFT JOIN n a ON s.depth > 0 AND a.node = s.node[1:s.depth - 1]
"""
