"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from tallyforge.llm import mixing

_A = [weight for _, weight in mixing.LENGTHS]
_M = mixing.MOST_COPIES
_CLASS = " + ".join(f"(size >= {least})::INT" for least, _ in mixing.LENGTHS)
#: Expected copies by length class, from target and the words s[1], s[2], s[3] of the classes.
_LAMBDA = f"""
  SELECT *, w3 IS NULL OR {_M} * w3 <= {_A[2]} * target AS full3 FROM (
    SELECT *, ({_A[0]} * s[1] + {_A[1]} * s[2] + {_A[2]} * s[3])::DOUBLE AS w3, ({_A[0]} * s[1] + {_A[1]} * s[2])::DOUBLE AS w2, ({_A[0]} * s[1])::DOUBLE AS w1,
      target - {_M} * s[3] AS rest2, target - {_M} * s[3] - {_M} * s[2] AS rest1
    FROM goals)"""

OP8 = rf"""
WITH base AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('{mixing.SEED}' || chr(1) || coalesce(doc_id::VARCHAR, '') || chr(1) || md5(coalesce(text, ''))), 1, {mixing.BITS // 4}))::BIGINT AS u,
    coalesce(doc_id::VARCHAR, '') AS d, md5(coalesce(text, '')) AS h
  FROM documents),
sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [{", ".join(f"sum(CASE WHEN {_CLASS} = {k + 1} THEN size ELSE 0 END)::BIGINT" for k in range(len(_A)))}] AS s,
    [{", ".join(map(str, mixing.WEIGHTS))}][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1)::INT]::BIGINT AS w
  FROM base GROUP BY source),
filled AS (
  SELECT *, source_size * {mixing.MOST_COPIES} AS cap,
    (sum(source_size) OVER () - coalesce(sum(source_size * {mixing.MOST_COPIES}) OVER before, 0))::DOUBLE AS rest,
    (sum(w) OVER () - coalesce(sum(w) OVER before, 0))::DOUBLE AS rest_w
  FROM sizes
  WINDOW before AS (ORDER BY (source_size * {mixing.MOST_COPIES})::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT rest, rest_w FROM filled WHERE NOT (cap::DOUBLE * rest_w <= w::DOUBLE * rest) ORDER BY cap::DOUBLE / w, source ASC NULLS LAST LIMIT 1),
goals AS (
  SELECT source, source_size, s,
    CASE WHEN cap::DOUBLE * f.rest_w <= w::DOUBLE * f.rest OR l.rest IS NULL THEN cap::DOUBLE ELSE (w::DOUBLE * l.rest) / l.rest_w END AS target
  FROM filled f LEFT JOIN level l ON true),
one AS ({_LAMBDA}),
two AS (SELECT *, full3 AND {_M} * w2 <= {_A[1]} * rest2 AS full2 FROM one),
three AS (SELECT *, full2 AND {_M} * w1 <= {_A[0]} * rest1 AS full1 FROM two),
four AS (
  SELECT *, CASE WHEN NOT full3 AND w3 > 0 THEN target / w3 WHEN full3 AND NOT full2 AND w2 > 0 THEN rest2 / w2 WHEN full2 AND NOT full1 AND w1 > 0 THEN rest1 / w1 END AS t
  FROM three),
five AS (
  SELECT source, source_size, target, s,
    [{", ".join(f"CASE WHEN full{k + 1} OR t IS NULL THEN {_M}::DOUBLE ELSE least({_M}::DOUBLE, {_A[k]} * t) END" for k in range(3))}] AS lam FROM four),
six AS (SELECT *, target - (floor(lam[1]) * s[1] + floor(lam[2]) * s[2] + floor(lam[3]) * s[3]) AS need FROM five),
drawn AS (
  SELECT b.*, g.source_size, g.target, g.need, floor(lam[{_CLASS}]) AS whole, lam[{_CLASS}] - floor(lam[{_CLASS}]) AS p, (u + 0.5::DOUBLE) / {float(1 << mixing.BITS)}::DOUBLE AS x
  FROM base b JOIN six g ON b.source IS NOT DISTINCT FROM g.source),
placed AS (SELECT *, CASE WHEN p > 0 THEN floor(x * (1 - p) / (x * (1 - p) + (1 - x) * p) * {float(1 << mixing.BITS)}::DOUBLE) END AS r FROM drawn),
ranked AS (
  SELECT *, sum(CASE WHEN p > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY r NULLS LAST, d, h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(size) OVER (PARTITION BY source, r, d, h) AS own
  FROM placed)
SELECT doc_id, size, source_size, target,
  ((whole + CASE WHEN p > 0 AND need > 0 AND 2 * upto - own <= 2 * need THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM ranked
"""


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = rf"""
WITH item AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, row_number() OVER () AS n, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT n, item_id, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM item, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS r(i) WHERE len(w) > 0),
doc AS (SELECT doc_id, row_number() OVER () AS d, {_WORDS} AS w FROM documents),
seen AS (
  SELECT d, i, z.size, array_to_string(w[i : i + z.size - 1], ' ') AS win
  FROM doc, (SELECT DISTINCT size FROM windows) z, unnest(range(1, len(w) - z.size + 2)) AS r(i)),
found AS (SELECT d, i, seen.size, n, item_id FROM seen JOIN windows USING (size, win)),
hit AS (SELECT d, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + size)) AS r(p) GROUP BY d),
owner AS (SELECT d, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT d, n, item_id FROM found) GROUP BY d)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN hit USING (d) LEFT JOIN owner USING (d)
"""


OP2 = r"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s FROM word, unnest(range(1, greatest(len(w), 2))) AS r(i) WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
sized AS (SELECT * FROM shingle JOIN size USING (doc_id)),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM sized a JOIN sized b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x, y FROM both_ UNION SELECT r.x, b.y FROM reach r JOIN both_ b ON r.y = b.x)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(c, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(c, d.doc_id)) AS kept
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) USING (doc_id)
"""


#: The checksum of the driver's folds, from its polynomial: a table of 256 remainders, then a fold over the bytes of ASCII keys.
_CRC = r"""crc AS (SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), n)) AS remainder)"""


def _crc32(key: str) -> str:
    return f"xor(list_reduce(list_transform(range(1, length({key}) + 1), lambda i: ascii(substr({key}, i, 1))::BIGINT), lambda c, b: xor(c >> 8, remainder[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


OP11 = rf"""
WITH RECURSIVE {_CRC},
raw AS (
  SELECT conv_id, turn, coalesce(conv_id::VARCHAR, '') AS c, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind
  FROM conversations, crc),
damaged AS (
  SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM raw, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS r(i) WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY pos) AS times, lag(role[1:1]) OVER (PARTITION BY c ORDER BY pos) || role[1:1] AS pair FROM placed),
fault AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN times > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM seen),
conv AS (SELECT DISTINCT conv_id, c FROM raw),
ins(x, y, letters) AS (VALUES (0, 0, ''), (0, 2, 'I'), (0, 3, 'IJ'), (1, 1, ''), (1, 2, 'I'), (1, 3, 'IJ'), (2, 2, ''), (2, 3, 'J'), (3, 3, ''), (3, 2, 'I')),
move(x, y, letter, role) AS (VALUES (0, 0, 'D', NULL), (1, 1, 'D', NULL), (2, 2, 'D', NULL), (3, 3, 'D', NULL), (0, 1, 'K', 's'), (0, 2, 'K', 'u'), (1, 2, 'K', 'u'), (3, 2, 'K', 'u'), (2, 3, 'K', 'a'), (0, 2, 'R', NULL), (1, 2, 'R', NULL), (3, 2, 'R', NULL), (2, 3, 'S', NULL)),
best AS (
  SELECT c, 0::BIGINT AS pos, 0 AS st, {{'cost': 0::BIGINT, 'audit': '', 'code': ''}} AS b FROM conv
  UNION ALL
  SELECT d.c, d.pos + 1, m.y, min({{'cost': b.cost + 2 * length(i.letters) + CASE m.letter WHEN 'D' THEN 3 WHEN 'K' THEN 0 ELSE 2 END + CASE WHEN m.letter <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END,
    'audit': b.audit || translate(i.letters || m.letter, 'JS', 'IR'), 'code': b.code || i.letters || m.letter}})
  FROM best d JOIN fault f ON f.c = d.c AND f.pos = d.pos + 1 JOIN ins i ON i.x = d.st JOIN move m ON m.x = i.y
  WHERE m.letter = 'D' OR (f.fault NOT IN ('blank', 'duplicate') AND (m.letter <> 'K' OR m.role = f.role[1:1]))
  GROUP BY d.c, d.pos, m.y),
done AS (
  SELECT d.c, min({{'cost': b.cost + 2 * length(i.letters), 'audit': b.audit || translate(i.letters, 'J', 'I'), 'code': b.code || i.letters}}) AS b
  FROM best d JOIN (SELECT c, max(pos) AS pos FROM best GROUP BY c) USING (c, pos) JOIN ins i ON i.x = d.st WHERE i.y IN (0, 3) GROUP BY d.c),
letter AS (SELECT c, k, b.code[k:k] AS l, length(regexp_replace(b.code[1:k], '[IJ]', '', 'g')) AS pos FROM done, unnest(range(1, length(b.code) + 1)) AS r(k)),
said AS (
  SELECT l.c, string_agg(CASE WHEN l = 'K' THEN f.role WHEN l IN ('I', 'R') THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l IN ('I', 'J') THEN '' ELSE f.text END, chr(10) ORDER BY k) AS said
  FROM letter l LEFT JOIN fault f ON f.c = l.c AND f.pos = l.pos WHERE l <> 'D' GROUP BY l.c),
counts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM fault GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, b.cost::BIGINT AS cost, b.audit AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM conv JOIN done USING (c) LEFT JOIN said USING (c) LEFT JOIN counts USING (c)
"""


OP13 = r"""
WITH doc AS (
  SELECT row_number() OVER () AS d, doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
flag AS (
  SELECT d, part, doc_id, len(w) < 100 AS A, 100 * len(list_distinct(w)) < 80 * len(w) AS B, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS C,
    regexp_matches(t, '[#$%&*|]') AS D_, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS E FROM doc),
label AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT f.*, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    concat(CASE WHEN A THEN 'A' ELSE '' END, CASE WHEN B THEN 'B' ELSE '' END, CASE WHEN C THEN 'C' ELSE '' END, CASE WHEN D_ THEN 'D' ELSE '' END, CASE WHEN E THEN 'E' ELSE '' END) AS failed
  FROM flag f LEFT JOIN label USING (doc_id)),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
  WHERE b.x <> a.x AND c.x NOT IN (a.x, b.x) AND d.x NOT IN (a.x, b.x, c.x) AND e.x NOT IN (a.x, b.x, c.x, d.x)),
grouped AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM fails GROUP BY part, failed),
gone AS (
  SELECT *, (SELECT coalesce(min(i), 6) FROM range(1, 6) AS r(i) WHERE contains(failed, filter_order[i:i])) AS hit FROM grouped, orders),
parts AS (SELECT DISTINCT part FROM doc),
rows_ AS (
  SELECT part, filter_order, step::INT AS step, filter_order[step:step] AS own, sum(CASE WHEN hit > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN hit = step THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN hit < step AND contains(failed, filter_order[step:step]) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN failed = filter_order[step:step] THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN hit = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN hit = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM gone, range(1, 6) AS s(step) GROUP BY part, filter_order, step)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM rows_
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_near_duplicates": OP2, "op3_benchmark_decontamination": OP3, "op8_mixing": OP8, "op11_conversation_repair": OP11, "op13_filter_interactions": OP13}
