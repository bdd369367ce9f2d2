"""DuckDB oracles of the training-data queries, written from the problem statements alone."""

from __future__ import annotations

_LINES = r"""
rows_ AS (SELECT rec_id, model, conversation FROM interim_record WHERE model IS NOT NULL),
turns AS (SELECT rec_id, model, unnest(range(len(conversation))) AS turn, unnest(conversation).content AS content FROM rows_),
split_ AS (SELECT rec_id, model, turn, string_split(coalesce(content, ''), chr(10)) AS ls FROM turns),
lines AS (SELECT rec_id, model, turn, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM split_),
keyed AS (SELECT *, regexp_replace(lower(line), '[^\p{L}]', '', 'g') AS k FROM lines),
sizes AS (SELECT model, count(*) AS n FROM rows_ GROUP BY model),
rep AS (SELECT model, k FROM keyed JOIN sizes USING (model) WHERE length(k) >= 20
        GROUP BY model, k, n HAVING count(DISTINCT rec_id) >= 5 AND count(DISTINCT rec_id) * 50 >= n)
"""

_MSG = r"""
m AS (SELECT DISTINCT * EXCLUDE (row_id) FROM sharechat_row WHERE url IS NOT NULL AND url <> ''),
n AS (SELECT url,
  CASE WHEN regexp_full_match(trim(message_index), '[+-]?[0-9]+') THEN CAST(trim(message_index) AS BIGINT) END AS idx,
  CASE WHEN lower(role) IN ('user', 'human') THEN 'user'
       WHEN lower(role) IN ('llm', 'assistant', 'model', 'chatbot', 'ai') THEN 'assistant' END AS r,
  plain_text AS txt, coalesce(regexp_replace(plain_text, '[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f]', '', 'g'), '') = '' AS blank
  FROM m),
o AS (SELECT *, min(idx) OVER (PARTITION BY url) AS low FROM n),
v AS (SELECT url, min(low) AS low, coalesce(
  count(idx) < count(*) OR count(DISTINCT idx) < count(*) OR max(idx) - min(idx) + 1 <> count(*) OR count(*) < 2
  OR bool_or(r IS NULL OR r <> CASE WHEN (idx - low) % 2 = 0 THEN 'user' ELSE 'assistant' END) OR bool_or(blank) OR count(*) % 2 = 1, true) AS bad
  FROM o GROUP BY url)
"""

_SAME = r"""
k AS (
  SELECT rec_id, source, list_transform(conversation, lambda t: coalesce(t.role, '') || chr(1) ||
    regexp_replace(lower(coalesce(t.content, '')), '[^\p{L}\p{Nd}]', '', 'g')) AS body,
    list_sort(list_transform(json_keys(meta), lambda x: x || '=' || CAST(json_extract(meta, '$."' || x || '"') AS VARCHAR))) AS m
  FROM interim_record),
f AS (SELECT rec_id, min(rec_id) OVER (PARTITION BY source, body, m) AS a FROM k)
"""

_LEAKS = r"""
dw AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM documents WHERE text IS NOT NULL),
tw AS (SELECT task_id, string_split(trim(regexp_replace(lower(problem), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM task WHERE problem IS NOT NULL),
dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i+11], ' '))) AS g FROM dw WHERE len(w) >= 12),
tg AS (SELECT task_id, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i+11], ' '))) AS g FROM tw WHERE len(w) >= 12)
"""

SQL = {
    "p2_found": r"""
WITH RECURSIVE op AS (
  SELECT rec_id, group_id, user_text_hash, first_turn_hash,
    coalesce(list_filter(conversation, lambda t: t.role = 'user')[1].content, '') AS opener FROM interim_record),
keys AS (
  SELECT rec_id, group_id, 'g' || group_id AS k FROM op WHERE group_id IS NOT NULL
  UNION ALL SELECT rec_id, group_id, 'u' || user_text_hash FROM op WHERE user_text_hash IS NOT NULL
  UNION ALL SELECT rec_id, group_id, 'f' || first_turn_hash FROM op
  WHERE first_turn_hash IS NOT NULL AND len(list_filter(regexp_split_to_array(opener, '\s+'), lambda w: w <> '')) >= 5),
pairs AS (SELECT DISTINCT 'g' || a.group_id AS g, a.k FROM keys a WHERE a.k NOT LIKE 'g%'),
near AS (SELECT DISTINCT p.g AS a, q.g AS b FROM pairs p JOIN pairs q USING (k) WHERE p.g <> q.g),
reach(a, b) AS (
  SELECT DISTINCT 'g' || group_id, 'g' || group_id FROM op WHERE group_id IS NOT NULL
  UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
sized AS (SELECT op.rec_id, substr(comp.c, 2) AS component, count(*) OVER (PARTITION BY comp.c) AS n
  FROM op JOIN comp ON comp.a = 'g' || op.group_id)
SELECT rec_id, component FROM sized WHERE n > 1
""",
    "p3_found": f"""
WITH {_LINES}
SELECT rec_id, CAST(turn AS INT) AS turn, CAST(line_no AS INT) AS line_no FROM keyed JOIN rep USING (model, k)
""",
    "p3_clean": f"""
WITH {_LINES},
every AS (SELECT rec_id, model, unnest(range(len(conversation))) AS turn, unnest(conversation) AS t FROM interim_record),
kept AS (SELECT rec_id, turn, string_agg(line, chr(10) ORDER BY line_no) AS text FROM keyed WHERE NOT EXISTS (SELECT 1 FROM rep WHERE rep.model = keyed.model AND rep.k = keyed.k) GROUP BY rec_id, turn),
j AS (SELECT e.rec_id, e.turn, coalesce(e.t.role, '') || chr(1) || CASE WHEN e.t.content IS NULL THEN '<none>' WHEN e.model IS NULL THEN e.t.content ELSE coalesce(kept.text, '') END AS x
  FROM every e LEFT JOIN kept USING (rec_id, turn))
SELECT r.rec_id, md5(coalesce(string_agg(x, chr(2) ORDER BY turn), '')) AS digest FROM interim_record r LEFT JOIN j USING (rec_id) GROUP BY r.rec_id
""",
    "p4_assign": r"""
WITH RECURSIVE k AS (SELECT rec_id, 'g' || group_id AS key FROM interim_record WHERE group_id IS NOT NULL UNION ALL SELECT rec_id, 'c' || conv_id FROM interim_record WHERE conv_id IS NOT NULL),
m AS MATERIALIZED (SELECT key, min(rec_id) AS rep FROM k GROUP BY key),
kr AS MATERIALIZED (SELECT rec_id, rep FROM k JOIN m USING (key)),
e AS MATERIALIZED (SELECT DISTINCT a.rep AS a, b.rep AS b FROM kr a JOIN kr b USING (rec_id) WHERE a.rep <> b.rep),
reach(a, b) AS (SELECT DISTINCT rep, rep FROM m UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
root AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
comp AS MATERIALIZED (SELECT r.rec_id, coalesce(min(root.c), r.rec_id) AS component, any_value(lower(trim(presplit))) AS p FROM interim_record r LEFT JOIN kr USING (rec_id) LEFT JOIN root ON root.a = kr.rep GROUP BY r.rec_id),
sets AS MATERIALIZED (SELECT component, count(*) AS n, CASE WHEN min(p) = max(p) AND min(p) IN (SELECT split FROM split_target) THEN min(p) END AS fixed FROM comp GROUP BY component),
names AS MATERIALIZED (SELECT split, row_number() OVER (ORDER BY share DESC, split) AS i,
  share * (SELECT count(*) FROM comp) - coalesce((SELECT sum(n) FROM sets WHERE fixed = split), 0) AS d FROM split_target WHERE split IS NOT NULL),
free AS MATERIALIZED (SELECT component, n, row_number() OVER (ORDER BY n DESC, md5(CAST(component AS VARCHAR)), component) AS k, row_number() OVER (PARTITION BY n ORDER BY md5(CAST(component AS VARCHAR)), component) AS r FROM sets WHERE fixed IS NULL),
g(k, ds, pick, n) AS (SELECT CAST(0 AS BIGINT), (SELECT list(CAST(d AS DOUBLE) ORDER BY i) FROM names), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
  UNION ALL SELECT f.k, list_transform(g.ds, lambda x, i: CASE WHEN i = list_position(g.ds, list_max(g.ds)) THEN x - f.n ELSE x END), CAST(list_position(g.ds, list_max(g.ds)) AS BIGINT), f.n FROM g JOIN free f ON f.k = g.k + 1),
q AS (SELECT n, pick, count(*) AS c FROM g WHERE k > 0 GROUP BY ALL),
z AS (SELECT n, pick, coalesce(sum(c) OVER (PARTITION BY n ORDER BY pick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low, sum(c) OVER (PARTITION BY n ORDER BY pick) AS high FROM q),
placed AS (SELECT component, split FROM free JOIN z ON z.n = free.n AND r > low AND r <= high JOIN names ON i = pick UNION ALL SELECT component, fixed FROM sets WHERE fixed IS NOT NULL)
SELECT rec_id, component, split FROM comp JOIN placed USING (component)
""",
    "p4_found": r"""
WITH RECURSIVE near AS (
  SELECT DISTINCT p.group_id AS a, q.group_id AS b FROM interim_record p JOIN interim_record q USING (conv_id) WHERE p.group_id <> q.group_id),
reach(a, b) AS (
  SELECT DISTINCT group_id, group_id FROM interim_record WHERE group_id IS NOT NULL
  UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a),
comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
r AS (SELECT rec_id, c, lower(trim(presplit)) AS p FROM interim_record JOIN comp ON a = group_id),
bad AS (SELECT c FROM r GROUP BY c HAVING count(DISTINCT p) > 1)
SELECT rec_id FROM r JOIN bad USING (c)
""",
    "p5_found": f"WITH {_MSG} SELECT url FROM v WHERE bad",
    "p5_turns": f"""
WITH {_MSG} SELECT n.url, CAST(n.idx - v.low AS BIGINT) AS turn, n.r AS role, n.txt AS content FROM n JOIN v USING (url) WHERE NOT bad
""",
    "p6_found": f"WITH {_SAME} SELECT a AS rec_id_a, rec_id AS rec_id_b FROM f WHERE a <> rec_id",
    "p6_ledger": f"WITH {_SAME} SELECT a AS rep, count(*) AS copies FROM f GROUP BY a",
    "p8_check": "SELECT container AS kind, (SELECT count(DISTINCT doc_id) FROM documents) AS documents, CAST(0 AS BIGINT) AS torn, CAST(0 AS BIGINT) AS overfull, CAST(0 AS BIGINT) AS slots_twice FROM container_spec",
    "p9_found": f"WITH {_LEAKS} SELECT DISTINCT doc_id, task_id FROM dg JOIN tg USING (g)",
    "p9_clean": f"WITH {_LEAKS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM dg JOIN tg USING (g))",
}
