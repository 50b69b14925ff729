"""DuckDB SQL for the queries that SQL can express; the others are held against brute force in tests/llm."""

#: Fixed values of op2_chat: budget 1024, history 256.
_CHAT = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS no,
  '<|im_start|>' || replace(replace(replace(role, '\\', '\\b'), '<|', '<\\|'), chr(10), '\\n') || chr(10)
  || replace(replace(text, '\\', '\\b'), '<|', '<\\|') || '<|im_end|>' || chr(10) AS piece FROM t),
q AS (SELECT *, greatest(CAST(ceil(strlen(piece) / 4.0) AS BIGINT), 1) AS tokens, (no = 1 AND role = 'system') AS sys FROM p),
c AS (SELECT *, CASE WHEN sys THEN 0 ELSE tokens END AS counted,
  max(CASE WHEN sys THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS aside FROM q),
f AS (SELECT *, CAST(sum(counted) OVER (PARTITION BY conv_id ORDER BY no) AS BIGINT) AS till,
  greatest(1024 - aside, 0) AS room, greatest(CAST(floor(greatest(1024 - aside, 0) / 2.0) AS BIGINT), 1) AS width FROM c),
h AS (SELECT *, till - counted AS frm, greatest(till - 1, 0) // width AS cell FROM f),
i AS (SELECT *, cell * 2 + CASE WHEN (sys OR frm >= cell * width) AND sum(counted) OVER (PARTITION BY conv_id, cell) > room THEN 1 ELSE 0 END AS part FROM h),
g AS (SELECT *, CASE WHEN sys THEN coalesce(min(CASE WHEN NOT sys THEN part END) OVER (PARTITION BY conv_id), 0) ELSE part END AS win FROM i),
s AS (SELECT conv_id, win, min(frm) AS start, min(no) AS first, least(256, greatest(any_value(room) - max(till) + min(frm), 0)) AS reach FROM g GROUP BY ALL),
again AS (
  SELECT g.conv_id, sum(length(g.piece)) AS n FROM g JOIN s ON g.conv_id IS NOT DISTINCT FROM s.conv_id
  WHERE (g.sys AND s.first > 1) OR (NOT g.sys AND s.win > g.win AND g.till <= s.start AND g.frm >= s.start - s.reach) GROUP BY ALL)
SELECT g.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY no)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY no), '')) AS loss_sha256,
  CAST(sum(length(piece)) + coalesce(any_value(again.n), 0) AS BIGINT) AS formatted_chars, count(DISTINCT win) AS n_windows
FROM g LEFT JOIN again ON g.conv_id IS NOT DISTINCT FROM again.conv_id GROUP BY g.conv_id
"""

_TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 20
"""

_NEAR = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
h AS (SELECT DISTINCT doc_id, s FROM (
  SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) AS s FROM w WHERE len(w) >= 3
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM w WHERE len(w) BETWEEN 1 AND 2)),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY 1),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM h a JOIN h b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m ON m.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

_REPEATS = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
f AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) < doc_id AS dup FROM g),
x AS (SELECT doc_id, list(DISTINCT p) AS gone FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM f WHERE dup) GROUP BY 1),
k AS (SELECT doc_id, list(e ORDER BY p) AS kept FROM (SELECT w.doc_id, unnest(w.w) AS e, unnest(range(1, len(w.w) + 1)) AS p FROM w) e
  ANTI JOIN (SELECT doc_id, unnest(gone) AS p FROM x) y USING (doc_id, p) GROUP BY 1)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(len(x.gone), 0) AS BIGINT) AS n_removed,
  sha256(coalesce(array_to_string(k.kept, ' '), '')) AS kept_sha256
FROM w LEFT JOIN x USING (doc_id) LEFT JOIN k USING (doc_id)
"""

SQL = {"op1_near_dedup": _NEAR, "op2_chat": _CHAT, "op3_topk": _TOPK, "op9_substring_dedup": _REPEATS}
