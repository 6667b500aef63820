"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

ORACLES = {
    "op2_exact_dedup": r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
""",
    "op13_merkle_manifest": r"""
WITH RECURSIVE
crc_table AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS i))
),
marked AS (
  SELECT *, doc_id IS NOT NULL AND xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
      lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8)), 4294967295::BIGINT) % 5 = 0 AS tampered
  FROM documents, crc_table
),
framed AS (
  SELECT doc_id, source, tampered,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS body,
    coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS small
  FROM marked
),
hashed AS (
  SELECT doc_id, source, sha256(head || body) AS leaf, sha256(head || CASE WHEN tampered THEN small ELSE body END) AS given
  FROM framed
),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed
),
up AS (
  SELECT source, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM leaves
  UNION ALL
  SELECT source, level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 15) // 16
  FROM up WHERE n > 1 GROUP BY source, level, pos // 16
),
subroots AS (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM up WHERE n = 1
),
top AS (
  SELECT 0 AS level, pos, subroot AS digest, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (max(n) + 15) // 16
  FROM top WHERE n > 1 GROUP BY level, pos // 16
),
-- every node with the digests before and after it in its run
around AS (
  SELECT source, level, pos,
    coalesce(string_agg(digest, '') OVER (PARTITION BY source, level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (PARTITION BY source, level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM up WHERE n > 1
),
top_around AS (
  SELECT level, pos,
    coalesce(string_agg(digest, '') OVER (PARTITION BY level, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(digest, '') OVER (PARTITION BY level, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM top WHERE n > 1
),
steps AS (
  SELECT l.source, l.pos, a.level AS step, a.before, a.after
  FROM leaves l JOIN around a ON a.source IS NOT DISTINCT FROM l.source AND a.pos = l.pos // (16 ** a.level)::BIGINT
  UNION ALL
  SELECT l.source, l.pos, 1000 + a.level, a.before, a.after
  FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN top_around a ON a.pos = s.pos // (16 ** a.level)::BIGINT
),
paths AS (
  SELECT source, pos, list({'before': before, 'after': after} ORDER BY step) AS path FROM steps GROUP BY source, pos
),
folded AS (
  SELECT source, pos, given AS digest, path, 1 AS i
  FROM (SELECT l.source, l.pos, l.given, coalesce(p.path, []) AS path FROM leaves l
        LEFT JOIN paths p ON p.source IS NOT DISTINCT FROM l.source AND p.pos = l.pos)
  UNION ALL
  SELECT source, pos, sha256(path[i].before || digest || path[i].after), path, i + 1 FROM folded WHERE i <= len(path)
),
ends AS (
  SELECT source, pos, digest AS folded_root, path FROM folded WHERE i = len(path) + 1
)
SELECT l.doc_id, l.leaf, s.subroot, (SELECT digest FROM top WHERE n = 1) AS root,
  sha256(coalesce(array_to_string(list_transform(e.path, lambda x: x.before || x.after), ''), '')) AS proof_sha256,
  e.folded_root, e.folded_root = (SELECT digest FROM top WHERE n = 1) AS verified
FROM leaves l JOIN ends e ON e.source IS NOT DISTINCT FROM l.source AND e.pos = l.pos
JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source
""",
    "op12_bond_negatives": r"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS same,
    list_dot_product(a.v, r.v)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
  other_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same
  AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
""",
}
