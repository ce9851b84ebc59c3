"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from gridloom.llm.licenses import PHRASES, REACH, TEMPLATES, THRESHOLD

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPACE = r"[^\x20\x09-\x0D]+"


def _words(column: str, pattern: str) -> str:
    return f"regexp_extract_all({_LOWER.format(column)}, '{pattern}')"


NEAR_DEDUP = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_words('text', _SPACE)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 3], ' ') AS shingle FROM d, unnest(range(1, greatest(len(w) - 3, 1) + 1)) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 80 * (p.n + q.n - common)),
r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
m AS (SELECT x AS doc_id, min(y) AS least FROM r GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(m.least, doc_id)) AS component_id, coalesce(m.least, doc_id) >= doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_words('text', _ALNUM)} AS w FROM documents),
b AS (SELECT item_id, {_words('text', _ALNUM)} AS w FROM benchmark WHERE item_id IS NOT NULL),
v AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
      FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) t(i) WHERE len(w) > 0),
p AS (SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS win FROM d, (SELECT DISTINCT k FROM v), unnest(range(1, len(w) - k + 2)) t(i)),
h AS (SELECT doc_id, i, k, item_id FROM p JOIN v USING (k, win)),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM h, unnest(range(i, i + k)) t(j) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item_id::VARCHAR) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def _values(rows: list[tuple[str, str]]) -> str:
    return ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in rows)


LICENSES = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_words('text', _ALNUM)} AS w FROM documents),
f AS (SELECT label, string_split(phrase, ' ') AS p FROM (VALUES {_values([(v, k) for k, v in PHRASES.items()])}) t(label, phrase)),
b AS (SELECT doc_id, label, i - 1 AS place FROM d, f, unnest(range(1, len(w) - len(p) + 2)) t(i) WHERE w[i] = p[1] AND w[i : i + len(p) - 1] = p),
base AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS z FROM b GROUP BY 1),
t AS (SELECT label, list_distinct({_words('body', _ALNUM)}) AS p, {REACH} * len({_words('body', _ALNUM)}) AS reach FROM (VALUES {_values(list(TEMPLATES.items()))}) t(label, body)),
lines AS (SELECT doc_id, list_distinct({_words('line', _ALNUM)}) AS w FROM d, unnest(string_split(text, chr(10))) t(line)),
share AS (SELECT doc_id, label, len(list_intersect(lines.w, p))::DOUBLE / len(p) AS share FROM lines, t WHERE len(lines.w) >= {THRESHOLD} * len(p) - 1e-9),
near AS (SELECT doc_id, w, label, p, reach FROM d, t WHERE len(list_intersect(list_distinct(w), p)) >= {THRESHOLD} * len(p) - 1e-9),
runs AS (SELECT doc_id, label, len(list_intersect(list_distinct(w[i : i + reach - 1]), p))::DOUBLE / len(p) AS share
         FROM near, unnest(range(1, len(w) + 1)) t(i) WHERE list_contains(p, w[i])),
m AS (SELECT doc_id, label, max(share) AS share FROM (SELECT * FROM share UNION ALL SELECT * FROM runs) WHERE share >= {THRESHOLD} - 1e-9 GROUP BY 1, 2),
names AS (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM m),
bl AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS s FROM b GROUP BY 1),
al AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS s FROM names GROUP BY 1),
top AS (SELECT doc_id, max(share) AS share FROM m GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, z AS last_word, coalesce(bl.s, '') AS base_labels, coalesce(al.s, '') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN bl USING (doc_id) LEFT JOIN al USING (doc_id) LEFT JOIN top USING (doc_id)
"""

ORACLE_SQL = {"op1_near_dedup": NEAR_DEDUP, "op4_decontamination": DECONTAMINATION, "op10_license_scan": LICENSES}
