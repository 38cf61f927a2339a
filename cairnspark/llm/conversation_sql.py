"""DuckDB SQL of the conversation operators: the same rows by recursion over turns and by joins over prefixes."""

from __future__ import annotations

#: crc32 of the strings of `keyed` (k): a table of the 256 bytes, then a byte a step.
_CRC = (
    "crc0 AS (SELECT range AS i, range AS c FROM range(256)), "
    + ", ".join(f"crc{n + 1} AS (SELECT i, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) AS c FROM crc{n})" for n in range(8))
    + """, crcs AS (SELECT k, 1 AS pos, 4294967295::BIGINT AS crc FROM keyed UNION ALL
SELECT r.k, r.pos + 1, xor(r.crc >> 8, t.c) FROM crcs r JOIN crc8 t ON t.i = xor(r.crc & 255, ascii(substr(r.k, r.pos, 1))) & 255 WHERE r.pos <= length(r.k)),
crc AS (SELECT k, xor(crc, 4294967295) AS v FROM crcs WHERE pos = length(k) + 1)"""
)

OP12_SQL = f"""WITH RECURSIVE said AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
keyed AS (SELECT DISTINCT conv_id::VARCHAR AS k FROM said), {_CRC},
own AS (SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role, text) AS turns FROM said GROUP BY 1),
built AS (SELECT o.conv_id, list_concat(coalesce(list_slice(h.turns, 1, c.v % 6), []), list_slice(o.turns, (c.v % 6) + 1, len(o.turns))) AS turns
  FROM own o JOIN crc c ON c.k = o.conv_id::VARCHAR LEFT JOIN own h ON h.conv_id = o.conv_id - o.conv_id % 100),
steps AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM built),
nodes AS (SELECT list_slice(turns, 1, depth) AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(turns) = depth), '')) AS ends_sha256 FROM steps GROUP BY 1, 2),
kids AS (SELECT list_slice(p, 1, depth - 1) AS p, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1, 2),
worth AS (SELECT n.p, n.depth, (k.n IS NULL)::INT AS leaf, CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * length(n.p[n.depth].t) END AS saved FROM nodes n LEFT JOIN kids k ON k.p = n.p AND k.depth = n.depth),
sums AS (SELECT list_slice(p, 1, up) AS p, up AS depth, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS up FROM worth) GROUP BY 1, 2)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.p = n.p AND s.depth = n.depth LEFT JOIN kids k ON k.p = n.p AND k.depth = n.depth LEFT JOIN nodes u ON u.depth = n.depth - 1 AND u.p = list_slice(n.p, 1, n.depth - 1)"""

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: States: 0 start, 1 after system, 2 after user, 3 after assistant. Inserted rows by the state before and after.
OP11_SQL = f"""WITH RECURSIVE said AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
keyed AS (SELECT DISTINCT k FROM said), {_CRC},
hurt AS (SELECT conv_id, turn, CASE WHEN v % 20 = 4 THEN 'user' ELSE role END AS role, CASE v % 20 WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(CASE WHEN v % 20 = 3 THEN [0, 1] ELSE [0] END) AS twin FROM said JOIN crc USING (k) WHERE v % 20 <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, twin) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, twin) AS copy,
  rtrim(text, {_SPACES}) AS tail FROM hurt),
judged AS (SELECT *, CASE WHEN tail = '' THEN 'blank' WHEN copy > 1 THEN 'duplicate' WHEN right(tail, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM placed),
pairs AS (SELECT *, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM judged),
signs AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM pairs GROUP BY 1),
ins(a, b, letters, lines) AS (VALUES (0, 0, '', []::VARCHAR[]), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 1, '', []), (1, 2, 'I', ['user:']), (1, 3, 'II', ['user:', 'assistant:']),
  (2, 2, '', []), (2, 3, 'I', ['assistant:']), (2, 2, 'II', ['assistant:', 'user:']), (3, 3, '', []), (3, 2, 'I', ['user:']), (3, 3, 'II', ['user:', 'assistant:'])),
keeps(q, initial, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
best AS (SELECT conv_id, 0::BIGINT AS i, 0 AS q, {{'cost': 0::BIGINT, 's': '', 'lines': []::VARCHAR[]}} AS x FROM signs UNION ALL
  SELECT conv_id, i, q, min(x) AS x FROM (
    SELECT b.conv_id, b.i + 1 AS i, w.after AS q, {{'cost': b.x.cost + 2 * length(e.letters) + w.cost + CASE WHEN w.letter <> 'D' AND r.fault = 'truncated' THEN 1 ELSE 0 END, 's': b.x.s || e.letters || w.letter,
      'lines': list_concat(b.x.lines, e.lines, CASE w.letter WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [(CASE e.b WHEN 2 THEN 'assistant:' ELSE 'user:' END) || r.text] END)}} AS x
    FROM best b JOIN judged r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.i = b.i + 1 JOIN ins e ON e.a = b.q
    JOIN (SELECT q, 'K' AS letter, initial, after, 0 AS cost FROM keeps UNION ALL SELECT q, 'R', NULL, CASE q WHEN 2 THEN 3 ELSE 2 END, 2 FROM (SELECT unnest(range(4))::INT AS q) UNION ALL SELECT q, 'D', NULL, q, 3 FROM (SELECT unnest(range(4))::INT AS q)) w
      ON w.q = e.b AND (w.initial IS NULL OR w.initial = left(r.role, 1)) AND (w.letter = 'D' OR r.fault IS NULL OR r.fault = 'truncated')) GROUP BY 1, 2, 3),
done AS (SELECT s.conv_id, min({{'cost': b.x.cost + 2 * length(e.letters), 's': b.x.s || e.letters, 'lines': list_concat(b.x.lines, e.lines)}}) AS x
  FROM signs s JOIN best b ON b.conv_id IS NOT DISTINCT FROM s.conv_id AND b.i = s.n JOIN ins e ON e.a = b.q AND e.b IN (0, 3) GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(d.x.cost, 0) AS cost,
coalesce(d.x.s, '') AS audit, sha256(coalesce(array_to_string(d.x.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN signs s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id"""
