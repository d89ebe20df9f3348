"""DuckDB SQL for the operators that SQL can express."""

from lodeline.llm.chat import PART_TURNS

NEAR_DUP_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
c AS MATERIALIZED (SELECT doc_id, len(sh) AS n, min(doc_id) OVER (PARTITION BY list_sort(sh)) AS rep, sh FROM s),
e AS MATERIALIZED (SELECT doc_id, n, unnest(sh) AS x FROM c WHERE doc_id = rep),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k
      FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * k >= 75 * (na + nb - k)),
g AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT rep AS id, rep AS hit FROM c WHERE n > 0 GROUP BY rep UNION SELECT r.id, g.b FROM r JOIN g ON g.a = r.hit),
m AS (SELECT id, min(hit) AS root FROM r GROUP BY id)
SELECT c.doc_id, c.n AS n_shingles, CASE WHEN c.n = 0 THEN c.doc_id ELSE m.root END AS component_id,
       c.doc_id = CASE WHEN c.n = 0 THEN c.doc_id ELSE m.root END AS kept
FROM c LEFT JOIN m ON m.id = c.rep
"""

CHAT_SQL = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
r AS (SELECT t.conv_id, p.perspective, row_number() OVER (PARTITION BY t.conv_id, p.perspective ORDER BY t.role <> 'system', t.turn NULLS FIRST, t.role, t.text) AS k,
  t.role = p.perspective AS mine,
  CASE WHEN t.role = p.perspective THEN '<|assistant|>' WHEN t.role = 'system' THEN '<|system|>'
    ELSE '<|user:' || regexp_replace(regexp_replace(t.role, '<(\\*)\|', '<\\\1|', 'g'), '\|(\\*)>', '|\\\1>', 'g') || '|>' END || chr(10) AS head,
  regexp_replace(t.text, '<(\\*)\|', '<\\\1|', 'g') || '<|end|>' AS body
  FROM t JOIN p ON p.conv_id IS NOT DISTINCT FROM t.conv_id),
c AS (SELECT *, (k - 1) // {PART_TURNS} AS part FROM r),
s AS (SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY k) - length(body) - 1 AS st FROM c)
SELECT conv_id, perspective, part, count(*) AS n_turns,
  string_agg(head || body || chr(10), '' ORDER BY k) AS text,
  coalesce(list(st::BIGINT::VARCHAR || '-' || (st + length(body))::BIGINT::VARCHAR ORDER BY k) FILTER (WHERE mine), []) AS masks,
  sum(CASE WHEN mine THEN length(body) ELSE 0 END)::BIGINT AS n_masked
FROM s GROUP BY conv_id, perspective, part
"""
