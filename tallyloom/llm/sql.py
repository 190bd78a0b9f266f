"""The same results in DuckDB SQL, where SQL can express them."""

OP10 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
FROM t JOIN g USING (body)
"""

OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (
  SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS node, a AS seen FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id,
       w.doc_id = coalesce(c.component_id, w.doc_id) AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = w.doc_id
"""

OP5 = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, text FROM conversations),
ra AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC NULLS LAST) AS back
  FROM t WHERE role = 'assistant'),
l AS (
  SELECT conv_id, max(turn) FILTER (WHERE back = 1) AS last_turn, max(text) FILTER (WHERE back = 2) AS stale
  FROM ra WHERE back <= 2 GROUP BY conv_id),
c AS (
  SELECT conv_id, turn, role, replace(coalesce(text, ''), '<|', '<\|') AS c,
         replace(coalesce(CASE WHEN turn = last_turn AND role = 'assistant' THEN stale ELSE text END, ''), '<|', '<\|') AS r
  FROM t JOIN l USING (conv_id) WHERE turn <= last_turn),
x AS (SELECT 'chosen' AS side, conv_id, turn, role, c AS text FROM c UNION ALL SELECT 'rejected', conv_id, turn, role, r FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY side, conv_id ORDER BY turn, role, text) AS k FROM x),
f AS (
  SELECT a.conv_id, coalesce(min(a.k) FILTER (WHERE a.role <> b.role OR a.text <> b.text) - 1, max(a.k)) AS n
  FROM p a JOIN p b ON a.conv_id = b.conv_id AND a.k = b.k AND a.side = 'chosen' AND b.side = 'rejected' GROUP BY a.conv_id),
s AS (
  SELECT p.side, p.conv_id, p.k, f.n, p.role, '<|' || p.role || '|>' || chr(10) AS head, p.text || '<|end|>' AS body
  FROM p JOIN f USING (conv_id)),
m AS (
  SELECT *, k <= n AS shared,
         coalesce(sum(length(head) + length(body) + 1) OVER (
           PARTITION BY side, conv_id, k <= n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at0
  FROM s),
g AS (
  SELECT conv_id, max(n) AS prompt_turns,
    coalesce(string_agg(head || body || chr(10), '' ORDER BY k) FILTER (WHERE shared AND side = 'chosen'), '') AS prompt,
    coalesce(string_agg(head || body || chr(10), '' ORDER BY k) FILTER (WHERE NOT shared AND side = 'chosen'), '') AS chosen,
    coalesce(string_agg(head || body || chr(10), '' ORDER BY k) FILTER (WHERE NOT shared AND side = 'rejected'), '') AS rejected,
    coalesce(string_agg((at0 + length(head)) || '-' || (at0 + length(head) + length(body)), ',' ORDER BY k)
      FILTER (WHERE NOT shared AND side = 'chosen' AND role = 'assistant'), '') AS chosen_mask,
    coalesce(string_agg((at0 + length(head)) || '-' || (at0 + length(head) + length(body)), ',' ORDER BY k)
      FILTER (WHERE NOT shared AND side = 'rejected' AND role = 'assistant'), '') AS rejected_mask
  FROM m GROUP BY conv_id)
SELECT conv_id, prompt_turns::INTEGER AS prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask FROM g
"""

ORACLE = {"op5_preference_pairs": OP5, "op10_exact_dedup": OP10, "op4_minhash_near_dedup": OP4}
