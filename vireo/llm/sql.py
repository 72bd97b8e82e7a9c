"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from vireo.llm import decontam, packing, sharding, vafile

_PACKING = f"""
WITH RECURSIVE n AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f]+'))::BIGINT AS n FROM documents
), seqs AS (
  SELECT doc_id, s::INTEGER AS seq_no, least({packing.MAX_LEN}, n - s * {packing.MAX_LEN})::INTEGER AS n_tokens
  FROM n, unnest(range(0, greatest(0, (n - 1) // {packing.MAX_LEN})::BIGINT + 1)) AS u(s)
), hist AS (
  SELECT n_tokens AS l, count(*) AS c, row_number() OVER (ORDER BY n_tokens) AS j FROM seqs WHERE n_tokens > 0 GROUP BY n_tokens
), cum AS (
  SELECT j, l, sum(c) OVER (ORDER BY j)::BIGINT AS c, sum(c * l) OVER (ORDER BY j)::BIGINT AS s FROM hist
), dp AS (
  SELECT 1 AS k, j, l * c - s AS cost, [l] AS path FROM cum
  UNION ALL
  SELECT k, j, p.cost, list_append(p.path, l) FROM (
    SELECT any_value(d.k) + 1 AS k, t.j AS j, any_value(t.l) AS l,
      min({{'cost': d.cost + t.l * (t.c - f.c) - (t.s - f.s), 'i': f.j, 'path': d.path}}) AS p
    FROM dp d JOIN cum f ON f.j = d.j JOIN cum t ON t.j > f.j
    WHERE d.k < {packing.BUCKETS} GROUP BY t.j
  )
), bounds AS (
  SELECT unnest(path) AS bound FROM (SELECT path FROM dp WHERE j = (SELECT max(j) FROM cum) ORDER BY k DESC LIMIT 1)
), placed AS (
  SELECT doc_id, seq_no, n_tokens, CASE WHEN n_tokens > 0 THEN (SELECT min(bound) FROM bounds WHERE bound >= n_tokens) END AS bucket_len,
    (((coalesce(doc_id, 0) % 2147483648 + 2147483648) % 2147483648) * 2654435761 % 4294967296) // 4194304 AS cell
  FROM seqs
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY bucket_len ORDER BY cell, doc_id NULLS FIRST, seq_no, n_tokens) - 1 AS r,
    greatest(1, {packing.BUDGET} // bucket_len) AS size FROM placed
)
SELECT doc_id, seq_no, n_tokens, bucket_len::INTEGER AS bucket_len,
  CASE WHEN bucket_len IS NOT NULL THEN r // size END::BIGINT AS batch_id,
  CASE WHEN bucket_len IS NOT NULL THEN r % size END::INTEGER AS slot
FROM ranked
"""

_TOKEN = "[\\p{L}\\p{N}\\p{M}]+"
_PIECE = "[^\\p{L}\\p{N}\\p{M}]*[\\p{L}\\p{N}\\p{M}]+"

_DECONTAMINATION = f"""
WITH item AS (
  SELECT regexp_extract_all(lower(text), '{_TOKEN}') AS w FROM benchmark WHERE text IS NOT NULL
), gram AS (
  SELECT DISTINCT size, array_to_string(w[i:i + size - 1], ' ') AS g
  FROM (SELECT w, least({decontam.N}, len(w)) AS size FROM item WHERE len(w) >= {decontam.LEAST}), unnest(range(1, len(w) - size + 2)) AS u(i)
), doc AS (
  SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '{_TOKEN}') AS w,
    regexp_extract_all(coalesce(text, ''), '{_PIECE}') AS piece FROM documents
), hits AS (
  SELECT r, list_distinct(flatten(list(range(i, i + s.size)))) AS hit
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM doc, (SELECT DISTINCT size FROM gram) WHERE len(w) >= size) s
  JOIN gram ON gram.size = s.size AND gram.g = array_to_string(s.w[s.i:s.i + s.size - 1], ' ')
  GROUP BY r
), found AS (
  SELECT doc.*, coalesce(hit, []) AS hit, len(w) AS n_tokens, len(coalesce(hit, [])) AS n_hit FROM doc LEFT JOIN hits USING (r)
)
SELECT doc_id,
  CASE WHEN n_hit = 0 THEN text WHEN n_hit >= {decontam.DROP_SHARE} * n_tokens THEN NULL ELSE
    array_to_string(list_filter(piece, lambda x, i: NOT list_contains(hit, i)), '') || substr(text, len(array_to_string(piece, '')) + 1) END AS text,
  n_tokens::BIGINT AS n_tokens, n_hit::BIGINT AS n_hit, len(list_filter(hit, lambda x: NOT list_contains(hit, x - 1)))::BIGINT AS n_spans,
  CASE WHEN n_hit = 0 THEN 'keep' WHEN n_hit >= {decontam.DROP_SHARE} * n_tokens THEN 'drop' ELSE 'trim' END AS action
FROM found
"""

_SHARDING = f"""
WITH below AS (
  SELECT *, coalesce(sum(strlen(coalesce(text, ''))) OVER (ORDER BY doc_id NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
    - sum(strlen(coalesce(text, ''))) OVER (PARTITION BY doc_id), 0)::HUGEINT AS b, sum(strlen(coalesce(text, ''))) OVER ()::HUGEINT AS total FROM documents
), sized AS (
  SELECT *, greatest({sharding.SHARDS}, (total + {sharding.SHARD_BYTES - 1}) // {sharding.SHARD_BYTES}) AS shards FROM below
)
SELECT doc_id, text, lang, source, n_chars,
  CASE WHEN doc_id IS NULL OR total = 0 THEN 0 ELSE least(shards - 1, b * shards // total) END::INTEGER AS shard_id
FROM sized
"""

_TOP_K = f"""
WITH pair AS (
  SELECT q.vec_id, x.vec_id AS neighbour, sqrt(list_sum(list_transform(list_zip(q.embedding, x.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2))) AS d
  FROM embeddings q JOIN embeddings x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0
)
SELECT vec_id, rank::INTEGER AS rank, neighbour, round(d, 6) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, neighbour) AS rank FROM pair) WHERE rank <= {vafile.K}
"""

ORACLES = {"op1_decontamination": _DECONTAMINATION, "op2_sharding": _SHARDING, "op3_packing": _PACKING, "op8_top_k": _TOP_K}
