"""DuckDB SQL of op3 and of op11 to op13. Checksums are computed bit by bit, as DuckDB has no CRC-32."""

from __future__ import annotations

from .line_rules import LEAST_LEFT, MAX_DOCS, MAX_SHARE


def crc32(text: str) -> str:
    """Unsigned CRC-32 of an ASCII text: eight steps a byte."""
    step = (
        "lambda acc, j: CASE WHEN j % 8 = 0 THEN "
        f"{_shifted(f'xor(acc, unicode(substring({text}, j // 8 + 1, 1))::BIGINT)')} ELSE {_shifted('acc')} END"
    )
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], range(0, 8 * length({text}))), {step}), 4294967295::BIGINT)"


def _shifted(acc: str) -> str:
    return f"xor(({acc}) >> 1, 3988292384::BIGINT * (({acc}) & 1))"


#: Strings of 400 bytes by digest, texts in hexadecimal digits: for small tables.
OP3_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, i, md5(substring(x, 2 * i + 1, 800)) AS m FROM (SELECT r, x, unnest(range(0, len(x) // 2 - 399)) AS i FROM d) AS p),
c AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM (SELECT r, i, count(*) OVER (PARTITION BY m) AS n FROM w) AS k WHERE n > 1),
s AS (SELECT r, i, before, sum(CASE WHEN i <= before + 400 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS span FROM c),
g AS (SELECT r, span, min(i) AS a, max(i) + 400 AS b FROM s GROUP BY r, span),
k AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM g GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
 sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE array_to_string(list_transform(range(0, n_spans + 1), lambda j: substring(x, CASE WHEN j = 0 THEN 1 ELSE 2 * ends[j] + 1 END, CASE WHEN j = n_spans THEN len(x) ELSE 2 * starts[j + 1] - CASE WHEN j = 0 THEN 0 ELSE 2 * ends[j] END END)), '') END)) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

OP11_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w) AS x),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) AS x, range(5) AS k(k) WHERE c > 1 GROUP BY r),
l AS (SELECT r, source, t, line, regexp_replace(lower(regexp_replace(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]', '0', 'g') AS norm
  FROM (SELECT r, source, t, unnest(string_split(t, chr(10))) AS line FROM d) AS x WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l GROUP BY r),
f AS (SELECT source, norm FROM (SELECT source, norm, count(DISTINCT t) AS n FROM l GROUP BY source, norm) AS c JOIN (SELECT source, count(DISTINCT t) AS docs FROM d GROUP BY source) AS h USING (source) WHERE n > {MAX_DOCS} AND n > docs * {MAX_SHARE}::DOUBLE),
gone AS (SELECT r, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) AS n FROM l JOIN f USING (source, norm) GROUP BY r),
m AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(w.t, '[#*$%&|<>]')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(gone.n, 0) AS n_line_words FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND n_words - n_line_words >= {LEAST_LEFT}::DOUBLE * n_words AS kept, CAST(n_line_words AS BIGINT) AS n_line_words FROM b
"""

OP12_SQL = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS place, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS own, conv_id - conv_id % 100 AS head, {crc32("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, t.place AS k, 0 AS part, role, text FROM c JOIN t ON t.conv_id = c.head AND t.place <= c.h
  UNION ALL SELECT c.conv_id, t.place, 1, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.place > c.h),
d AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, k) AS depth, length(text) AS tokens, md5(concat(length(role), ':', role, text)) AS m FROM r),
p AS (SELECT conv_id, depth, tokens, string_agg(m, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS path FROM d
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
q AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS length FROM p),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(tokens) AS tokens, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = length), '') AS ends FROM q GROUP BY path, depth),
k AS (SELECT a.*, b.conv_id AS parent_conv_id, (SELECT count(*) FROM n AS x WHERE x.depth = a.depth + 1 AND x.path[: len(a.path)] = a.path) AS n_children FROM n AS a LEFT JOIN n AS b ON b.depth = a.depth - 1 AND b.path = a.path[: len(a.path) - 32])
SELECT a.conv_id, CAST(a.depth AS BIGINT) AS depth, a.parent_conv_id, a.n_convs, a.n_children, CAST(count(*) FILTER (b.n_children = 0) AS BIGINT) AS n_leaves, CAST(sum((b.n_convs - 1) * b.tokens) AS BIGINT) AS saved_tokens, sha256(any_value(a.ends)) AS ends_sha256
FROM k AS a JOIN k AS b ON b.path[: len(a.path)] = a.path GROUP BY a.path, a.depth, a.conv_id, a.parent_conv_id, a.n_convs, a.n_children
"""

#: The grammar's moves: state before, initial of a kept row (null: any), edit, state behind, cost. Inserted turns stand alone.
_MOVES = (
    "('', 's', 'K', 's', 0), ('', 'u', 'K', 'u', 0), ('s', 'u', 'K', 'u', 0), ('u', 'a', 'K', 'a', 0), ('a', 'u', 'K', 'u', 0), "
    "('', NULL, 'R', 'u', 1), ('s', NULL, 'R', 'u', 1), ('u', NULL, 'R', 'a', 1), ('a', NULL, 'R', 'u', 1), "
    "('', NULL, 'D', '', 2), ('s', NULL, 'D', 's', 2), ('u', NULL, 'D', 'u', 2), ('a', NULL, 'D', 'a', 2)"
)
_INSERTS = "('', '', ''), ('s', '', 's'), ('u', '', 'u'), ('a', '', 'a'), ('', 'I', 'u'), ('s', 'I', 'u'), ('u', 'I', 'a'), ('a', 'I', 'u'), ('', 'II', 'a'), ('s', 'II', 'a')"

OP13_SQL = rf"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations),
x AS (SELECT *, {crc32("key")} % 20 AS kind FROM o),
y AS (SELECT conv_id, turn, role AS tie_role, md5(text) AS tie_text, copy, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
  CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM x, range(2) AS c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
z AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, tie_role, tie_text, copy) AS k,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, tie_role, tie_text, copy) AS again FROM y),
f AS (SELECT *, substring(role, 1, 1) AS initial, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN again > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM z),
g AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY k) || initial AS pair FROM f),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM g GROUP BY conv_id),
moves(state, needs, edit, upto, cost) AS (VALUES {_MOVES}), inserts(state, edits, upto) AS (VALUES {_INSERTS}),
walk(conv_id, state, k, best) AS (
  SELECT conv_id, '', 0::BIGINT, {{'cost': 0, 'audit': ''}} FROM s
  UNION ALL
  SELECT w.conv_id, m.upto, w.k + 1, min({{'cost': w.best.cost + 5 * len(i.edits) + m.cost + CASE WHEN r.fault = 3 AND m.edit <> 'D' THEN 5 ELSE 0 END, 'audit': w.best.audit || i.edits || m.edit}})
  FROM walk w JOIN f AS r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.k = w.k + 1 JOIN inserts i ON i.state = w.state JOIN moves m ON m.state = i.upto AND (m.needs IS NULL OR m.needs = r.initial) AND (r.fault NOT IN (1, 2) OR m.edit = 'D')
  GROUP BY w.conv_id, m.upto, w.k),
e AS (SELECT w.conv_id AS conv_id, min({{'cost': best.cost + 5 * len(i.edits), 'audit': best.audit || i.edits}}) AS best FROM walk AS w JOIN s AS n ON w.conv_id IS NOT DISTINCT FROM n.conv_id AND w.k = n.n JOIN inserts AS i ON i.state = w.state AND i.upto IN ('', 'a') GROUP BY w.conv_id),
u AS (SELECT conv_id, best.audit AS audit, unnest(range(1, len(best.audit) + 1)) AS pos FROM e),
v AS (SELECT conv_id, pos, audit[pos] AS edit, len(replace(audit[: pos], 'I', '')) AS k, len(replace(audit[: pos], 'D', '')) AS place FROM u),
t AS (SELECT v.*, r.role AS old, r.text AS text, max(CASE WHEN edit = 'K' AND r.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY v.conv_id) AS led FROM v LEFT JOIN f AS r ON r.conv_id IS NOT DISTINCT FROM v.conv_id AND r.k = v.k AND v.edit <> 'I' WHERE edit <> 'D'),
h AS (SELECT t.conv_id, string_agg(concat(CASE WHEN edit = 'K' THEN old WHEN (place - led) % 2 = 1 THEN 'user' ELSE 'assistant' END, ':', coalesce(text, '')), chr(10) ORDER BY pos) AS whole FROM t GROUP BY conv_id)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS i LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM i.conv_id
"""
