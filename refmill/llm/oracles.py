"""The SQL by which queries of the subpackage are checked, where another engine can say the same."""

from __future__ import annotations

from refmill.llm.truncation import LEAST, NEARLY_ALL, OFTEN, RATIO, SEEN, TAIL, TIMES, VISIBLY

_MASKED = "translate(lower({0}), '0123456789', '9999999999')"
_CUT = "list_filter(string_split_regex(regexp_replace(regexp_replace(" + _MASKED + ", '[.:?!/|]+(\\s|$)', '¦ \\1', 'g'), '[\"“”()\\[\\]{{}}\\n\\t]+', '¦ ', 'g'), '[^\\p{{L}}\\p{{N}}¦]+'), lambda w: w <> '')"
_BARE = "replace(coalesce({0}, ''), '¦', '')"

_TRUNCATED = f"""
v AS (SELECT citation_id AS id, 'raw' AS field, source, raw AS text FROM citations UNION ALL SELECT citation_id, 'title', source, title FROM citations),
words AS MATERIALIZED (SELECT id, field, source, text, length(text) AS n, {_CUT.format('text')} AS c, {_CUT.format(f'right(text, {TAIL})')} AS tail_c FROM v WHERE text IS NOT NULL AND trim(text) <> ''),
spots AS (SELECT {_BARE.format("c[i - 2]")} AS w1, {_BARE.format("c[i - 1]")} AS w2, {_BARE.format("c[i]")} AS w3, c[i + 1] IS NOT NULL AND NOT ends_with(c[i], '¦') AND NOT starts_with(coalesce(c[i + 1], ''), '¦') AS inside, c[i + 1] IS NULL AS last
 FROM (SELECT c, unnest(range(1, len(c) + 1)) AS i FROM words) WHERE c[i] <> '¦'),
tri AS MATERIALIZED (SELECT w1, w2, w3, count(*) FILTER (WHERE inside) AS n_inside, count(*) FILTER (WHERE NOT inside) AS n_end, count(*) FILTER (WHERE last) AS n_last FROM spots GROUP BY w1, w2, w3),
pairs AS MATERIALIZED (SELECT w2, w3, sum(n_inside) AS n_inside, sum(n_end) AS n_end, sum(n_last) AS n_last FROM tri GROUP BY w2, w3),
vocabulary AS (SELECT w3, sum(n_inside) AS n_inside, sum(n_end) AS n_end, sum(n_last) AS n_last FROM pairs GROUP BY w3),
ends AS MATERIALIZED (SELECT id, field, source, n, {_BARE.format("c[len(c)]")} AS w3, {_BARE.format("c[len(c) - 1]")} AS w2, {_BARE.format("c[len(c) - 2]")} AS w1,
 regexp_matches(right(rtrim(text, ' ' || chr(9) || chr(13) || chr(10) || '"”’''*;'), 6), '(\\.\\.\\.|…|\\[(\\.\\.\\.|…)\\]|\\x{{FFFD}})$') AS marked,
 regexp_matches(right(rtrim(text, ' ' || chr(9) || chr(13) || chr(10)), 1), '[\\p{{L}},&–-]') AS open_end,
 regexp_matches(right(rtrim(text, ' ' || chr(9) || chr(13) || chr(10) || '*;'), 1), '[\\p{{L}}\\p{{N}},&–-]') AS on_word
 FROM (SELECT id, field, source, text, n, CASE WHEN n > {TAIL} AND len(tail_c) <= 4 THEN c ELSE tail_c END AS c FROM words) WHERE len(c) > 0),
of_tri AS (SELECT o.w1, o.w2, o.w3, sum(CASE WHEN t.w3 = o.w3 THEN n_inside ELSE 0 END) AS t_inside, sum(CASE WHEN t.w3 = o.w3 THEN n_end ELSE 0 END) AS t_end, sum(CASE WHEN t.w3 = o.w3 THEN n_end - n_last ELSE 0 END) AS t_closed,
 sum(CASE WHEN t.w3 <> o.w3 THEN n_inside + n_end - n_last ELSE 0 END) AS t_longer FROM (SELECT DISTINCT w1, w2, w3 FROM ends WHERE on_word AND w3 <> '') o JOIN tri t ON o.w1 = t.w1 AND o.w2 = t.w2 AND left(o.w3, 1) = left(t.w3, 1) AND starts_with(t.w3, o.w3) GROUP BY ALL),
by_tri AS MATERIALIZED (SELECT e.id, e.field, e.source, e.n, e.w2, e.w3, e.open_end, ends_with(e.w3, '9') AS on_number, coalesce(t_inside, 0) AS t_inside, coalesce(t_end, 0) AS t_end, on_word AND NOT coalesce(t_closed > 0 AND t_end > t_inside, false) AS may_go_on,
 CASE WHEN marked THEN 'mark' WHEN on_word AND NOT ends_with(e.w3, '9') AND t_inside >= {OFTEN} AND t_inside >= {RATIO} * t_end THEN 'goes_on' WHEN on_word AND t_longer >= CASE WHEN ends_with(e.w3, '9') THEN {RATIO} ELSE {SEEN} END AND t_longer >= {RATIO} * CASE WHEN ends_with(e.w3, '9') THEN {RATIO} ELSE 1 END * (t_inside + t_closed) THEN 'part_of_word' END AS reason
 FROM ends e LEFT JOIN of_tri t ON on_word AND e.w1 = t.w1 AND e.w2 = t.w2 AND e.w3 = t.w3),
open_pairs AS MATERIALIZED (SELECT DISTINCT w2, w3 FROM by_tri WHERE may_go_on AND reason IS NULL AND w3 <> ''),
by_pair AS (SELECT o.w2, o.w3, sum(CASE WHEN a.w3 = o.w3 THEN n_inside ELSE 0 END) AS p_inside, sum(CASE WHEN a.w3 = o.w3 THEN n_end ELSE 0 END) AS p_end, sum(CASE WHEN a.w3 <> o.w3 THEN n_inside + n_end - n_last ELSE 0 END) AS p_longer
 FROM open_pairs o JOIN pairs a ON a.w2 = o.w2 AND left(a.w3, 1) = left(o.w3, 1) AND starts_with(a.w3, o.w3) GROUP BY ALL),
by_word AS (SELECT o.w3, sum(CASE WHEN a.w3 = o.w3 THEN n_inside ELSE 0 END) AS v_inside, sum(CASE WHEN a.w3 = o.w3 THEN n_end ELSE 0 END) AS v_end, sum(CASE WHEN a.w3 = o.w3 THEN n_last ELSE 0 END) AS v_last, sum(CASE WHEN a.w3 <> o.w3 THEN n_inside + n_end - n_last ELSE 0 END) AS v_longer
 FROM (SELECT DISTINCT w3 FROM open_pairs) o JOIN vocabulary a ON left(a.w3, 3) = left(o.w3, 3) AND starts_with(a.w3, o.w3) GROUP BY ALL),
said AS MATERIALIZED (SELECT e.id, e.field, e.source, e.n, e.open_end, e.may_go_on AND NOT e.on_number AS may_go_on,
 CASE WHEN e.reason IS NOT NULL OR NOT e.may_go_on THEN e.reason
  WHEN NOT on_number AND ((t_inside + t_end - 1 < {OFTEN} AND p_inside >= {OFTEN} AND p_inside >= {RATIO} * p_end) OR (coalesce(p_inside + p_end - 1, 0) < {OFTEN} AND v_inside >= {OFTEN} AND v_inside >= {RATIO} * v_end)) THEN 'pair_goes_on'
  WHEN (p_longer >= {OFTEN} AND p_longer >= {RATIO} * CASE WHEN on_number THEN {RATIO} ELSE 1 END * (p_inside + p_end)) OR (NOT on_number AND coalesce(v_inside + v_end, 0) <= coalesce(v_last, 0) AND v_longer >= 1) THEN 'pair_part_of_word' END AS reason
 FROM by_tri e LEFT JOIN by_pair p ON e.w2 = p.w2 AND e.w3 = p.w3 LEFT JOIN by_word v ON e.w3 = v.w3),
lengths AS (SELECT source, field, n, count(*) AS k, count(reason) AS k_cut FROM said GROUP BY source, field, n),
limits AS (SELECT source, field, n FROM (SELECT *, (sum(k) OVER (PARTITION BY source, field ORDER BY n RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) - k) / 10.0 AS expected FROM lengths) WHERE k >= {LEAST} AND k >= {TIMES} * (expected + 1) AND k_cut >= {VISIBLY} * k),
openf AS (SELECT field FROM said WHERE open_end GROUP BY field HAVING count(*) >= {LEAST} AND count(reason) >= {NEARLY_ALL} * count(*)),
found AS (SELECT s.id, s.field, s.source, coalesce(s.reason, CASE WHEN l.n IS NOT NULL AND s.may_go_on THEN 'limit' WHEN o.field IS NOT NULL AND s.open_end THEN 'open_end' END) AS reason
 FROM said s LEFT JOIN limits l ON s.source IS NOT DISTINCT FROM l.source AND s.field = l.field AND s.n = l.n LEFT JOIN openf o ON s.field = o.field)"""

ORACLES = {
    "p4_found": f"WITH {_TRUNCATED} SELECT id AS citation_id, field AS field_name FROM found WHERE reason IS NOT NULL",
    "p4_rates": f"WITH {_TRUNCATED} SELECT source, field, count(*) AS n_values, count(reason) AS n_cut, round(count(reason) / count(*)::DOUBLE, 6) AS share_cut, count(*) FILTER (WHERE reason IN ('goes_on', 'part_of_word')) AS by_trigram, count(*) FILTER (WHERE reason LIKE 'pair%') AS by_pair, count(*) FILTER (WHERE reason = 'mark') AS by_mark, count(*) FILTER (WHERE reason IN ('limit', 'open_end')) AS by_length FROM found GROUP BY source, field",
}
