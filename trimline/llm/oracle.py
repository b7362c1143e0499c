"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

OP10_EXACT_DEDUP = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
), g AS (
  SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g USING (h)
"""

#: All windows of all documents, so for small tables only in reasonable time.
OP3_SUBSTRING_DEDUP = r"""
WITH d AS (
  SELECT doc_id, [x FOR x IN string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+') IF x <> ''] AS w FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(w[s : s + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d)
), earliest AS (
  SELECT k, min(doc_id * 4294967296 + s) AS place FROM win GROUP BY k HAVING count(*) > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS pos
  FROM win JOIN earliest USING (k) WHERE doc_id * 4294967296 + s > place
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d)
  ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP11_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), numbered AS (
  SELECT *, row_number() OVER () AS n FROM v
), parts AS (
  SELECT vec_id, n, len(w) AS dim, unnest(w) AS x, unnest(range(len(w))) AS i FROM numbered
), scored AS (
  SELECT q.vec_id AS query_id, q.n AS qn, c.vec_id, c.n AS cn, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.dim = c.dim AND q.n <> c.n
  WHERE q.vec_id % 50 = 0 GROUP BY ALL
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY qn ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP12_COLLOCATIONS = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), piece AS (
  SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS t FROM d
), w AS (
  SELECT lang, [x FOR x IN string_split_regex(t, '[\x20\x09]+') IF x <> ''] AS w FROM piece
), place AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w
), gram AS (
  SELECT lang, w[i : i + k - 1] AS g FROM place, (VALUES (1), (2), (3), (4)) AS t(k) WHERE i + k - 1 <= len(w)
), f AS (
  SELECT lang, g, count(*) AS f FROM gram GROUP BY lang, g HAVING count(*) >= 30
), cut AS (
  SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r,
         CAST(CAST(2000000 AS HUGEINT) * c.f // (x.f + y.f) AS BIGINT) AS score
  FROM (SELECT lang, g, f, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1) c
  JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : k]
  JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1 : len(c.g)]
), lowest AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), inside AS (
  SELECT lang, g[i : i + k - 1] AS g, max(f) AS longer
  FROM (SELECT lang, g, f, k, unnest(range(1, len(g) - k + 2)) AS i FROM f, (VALUES (2), (3)) AS t(k) WHERE k < len(g))
  GROUP BY ALL
), kept AS (
  SELECT lowest.*, array_to_string(g, ' ') AS phrase FROM lowest LEFT JOIN inside USING (lang, g)
  WHERE longer IS NULL OR 100 * longer < 80 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang) USING (lang)
QUALIFY rank <= 2000
"""

#: CRC-32 of the decimal digits bit by bit: 8 steps of the reflected polynomial for each byte.
OP13_CONVERSATION_TRIE = """
WITH t AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS name,
         list({'r': role, 't': text} ORDER BY turn NULLS FIRST, sha256(concat(strlen(role), ':', role, text))) AS l
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations) x
  WHERE conv_id IS NOT NULL GROUP BY conv_id
), c AS (
  SELECT conv_id, l, xor(4294967295, list_reduce(
           list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(name) + 1), lambda i: CAST(ascii(name[i]) AS BIGINT))),
           lambda crc, b: list_reduce(
             list_prepend(xor(crc, b), list_transform(range(8), lambda z: CAST(0 AS BIGINT))),
             lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 4 AS h
  FROM t
), rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.l, [])[1 : c.h], c.l[c.h + 1 :]) AS s
  FROM c LEFT JOIN t b ON b.conv_id = c.conv_id - c.conv_id % 20
), step AS (
  SELECT conv_id, d, s[1 : d] AS p, len(s) AS n, coalesce(s[d]['t'], '') AS last
  FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)
), node AS (
  SELECT min(conv_id) AS conv_id, d AS depth, p, count(*) AS n_convs,
         len(regexp_extract_all(min(last), '[^\\x20\\x09-\\x0D]+')) AS words,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256
  FROM step GROUP BY d, p
), path AS (
  SELECT step.conv_id, step.d, node.conv_id AS owner FROM step JOIN node ON node.depth = step.d AND node.p = step.p
), linked AS (
  SELECT node.*, path.owner AS parent_conv_id
  FROM node LEFT JOIN path ON path.conv_id = node.conv_id AND path.d = node.depth - 1
), counted AS (
  SELECT l.*, coalesce(k.n, 0) AS n_children
  FROM linked l LEFT JOIN (SELECT parent_conv_id AS p, depth - 1 AS d, count(*) AS n FROM linked GROUP BY ALL) k
  ON k.p = l.conv_id AND k.d = l.depth
), below AS (
  SELECT path.owner, path.d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * words) AS saved
  FROM counted x JOIN path ON path.conv_id = x.conv_id AND path.d <= x.depth GROUP BY ALL
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM counted JOIN below ON below.owner = counted.conv_id AND below.d = counted.depth
"""

ORACLES = {
    "op3_substring_dedup": OP3_SUBSTRING_DEDUP,
    "op10_exact_dedup": OP10_EXACT_DEDUP,
    "op11_top_k": OP11_TOP_K,
    "op12_collocations": OP12_COLLOCATIONS,
    "op13_conversation_trie": OP13_CONVERSATION_TRIE,
}
