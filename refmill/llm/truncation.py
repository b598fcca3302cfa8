"""Text cut off by field limits: evidence from word trigrams inside texts and at their ends, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from refmill.session import cut

_SPLIT = r"""array_remove(split(regexp_replace(translate(lower(TEXT), '0123456789', '9999999999'),
         '[.:?!/|]+(?=\\s|$)|["“”()\\[\\]{{}}\n\t]+', '¦ '), '[^\\p{{L}}\\p{{N}}¦]+'), '')"""

#: One row per value: its words in small letters, with ¦ on the side where a clause begins or ends, and digits masked:
#: a run of digits becomes as many 9s, so that 547-555 and 101-110 are one pattern.
_VALUES = r"""
SELECT id, field, source, text, length(text) AS n, WHOLE AS c, TAIL AS tail_c
FROM {values} WHERE text IS NOT NULL AND trim(text) <> ''
""".replace("WHOLE", _SPLIT.replace("TEXT", "text")).replace("TAIL", _SPLIT.replace("TEXT", "right(text, {tail})"))

#: Every word c with the two before it and the one after it. The start of a text counts as two empty words, so that
#: short texts have trigrams too.
_SPOTS = r"""
SELECT translate(a, '¦', '') AS w1, translate(b, '¦', '') AS w2, translate(c, '¦', '') AS w3,
       NOT (d IS NULL OR endswith(c, '¦') OR startswith(d, '¦')) AS inside, d IS NULL AS last
FROM (SELECT inline(arrays_zip(a, b, c, d))
      FROM (SELECT concat(array('', ''), c) AS a, concat(array(''), c) AS b, c, slice(c, 2, size(c)) AS d FROM {words}))
WHERE c IS NOT NULL AND c <> '¦'
"""

#: How often a run of three words (h, the hash of the first two, and w3; w2 empty) and of two (w2 and w3; h is 0) stands
#: inside a clause (a word follows), at the end of one, and at the end of all. Both in one pass over the texts.
_RUNS = r"""
SELECT h, w2, w3, count_if(inside) AS n_inside, count_if(NOT inside) AS n_end, count_if(last) AS n_last
FROM (SELECT inside, last, stack(2, xxhash64(w1, w2), '', 0L, w2) AS (h, w2), w3 FROM {spots})
GROUP BY h, w2, w3
"""
_TRIGRAMS = "SELECT h, left(w3, 1) AS one, w3, n_inside, n_end, n_last FROM {runs} WHERE h <> 0"
_PAIRS = "SELECT w2, w3, n_inside, n_end, n_last FROM {runs} WHERE h = 0"

#: The last words of each value, and whether the text ends on a word, so that it may go on, or shows a mark of the cut.
#: Words are taken from the last {tail} characters if those hold more than the three wanted, else from the whole text.
_ENDS = r"""
SELECT id, field, source, n, translate(element_at(c, -1), '¦', '') AS w3, translate(coalesce(get(c, size(c) - 2), ''), '¦', '') AS w2,
       translate(coalesce(get(c, size(c) - 3), ''), '¦', '') AS w1,
       right(trim(TRAILING ' \t\r\n"”\'’*;' FROM text), 6) RLIKE '(\\.\\.\\.|…|\\[(\\.\\.\\.|…)\\]|\\x{{FFFD}})$' AS marked,
       right(trim(TRAILING ' \t\r\n' FROM text), 1) RLIKE '[\\p{{L}},&–-]' AS open_end,
       right(trim(TRAILING ' \t\r\n*;' FROM text), 1) RLIKE '[\\p{{L}}\\p{{N}},&–-]' AS on_word
FROM (SELECT id, field, source, text, n, if(n > {tail} AND size(tail_c) <= 4, c, tail_c) AS c FROM {words}) WHERE size(c) > 0
"""

#: What the trigrams say of the last one of each value: how often it goes on and ends elsewhere, and how often a
#: trigram stands elsewhere whose last word only begins with this one's: then the value ends in mid-word.
_OF_TRIGRAM = r"""
SELECT o.h, o.w3, sum(if(t.w3 = o.w3, n_inside, 0)) AS t_inside, sum(if(t.w3 = o.w3, n_end, 0)) AS t_end, sum(if(t.w3 = o.w3, n_end - n_last, 0)) AS t_closed,
       sum(if(t.w3 <> o.w3, n_inside + n_end - n_last, 0)) AS t_longer
FROM (SELECT DISTINCT xxhash64(w1, w2) AS h, left(w3, 1) AS one, w3 FROM {ends} WHERE on_word AND w3 <> '') o
JOIN {trigrams} t ON o.h = t.h AND o.one = t.one AND startswith(t.w3, o.w3) GROUP BY o.h, o.w3
"""

#: The last trigram is complete if it ends a clause before a mark elsewhere, and no more often goes on; it goes on if
#: it almost never ends one; it is cut in its last word if longer ones are far more frequent. Ends of whole texts
#: don't prove it complete: many may be cut at the same place. Ends on numbers vary, so they count only if far rarer.
_BY_TRIGRAM = r"""
SELECT e.id, e.field, e.source, e.n, e.w2, e.w3, e.open_end, endswith(e.w3, '9') AS on_number, coalesce(t_inside, 0) AS t_inside, coalesce(t_end, 0) AS t_end,
  on_word AND NOT coalesce(t_closed > 0 AND t_end > t_inside, false) AS may_go_on,
  CASE WHEN marked THEN 'mark' WHEN on_word AND NOT endswith(e.w3, '9') AND t_inside >= {often} AND t_inside >= {ratio} * t_end THEN 'goes_on'
       WHEN on_word AND t_longer >= if(endswith(e.w3, '9'), {ratio}, {seen}) AND t_longer >= {ratio} * if(endswith(e.w3, '9'), {ratio}, 1) * (t_inside + t_closed) THEN 'part_of_word' END AS reason
FROM {ends} e LEFT JOIN {of_trigram} t ON on_word AND xxhash64(e.w1, e.w2) = t.h AND e.w3 = t.w3
"""

#: The ends on which more is to be found out, and of the pairs those that begin as one of them does.
_OPEN_PAIRS = "SELECT DISTINCT w2, w3 FROM {by_trigram} WHERE may_go_on AND reason IS NULL AND w3 <> ''"
_ALIKE = r"""
SELECT p.*, k FROM {pairs} p LEFT SEMI JOIN (SELECT DISTINCT w2, left(w3, 1) AS one FROM {open_pairs}) o ON p.w2 = o.w2 AND left(p.w3, 1) = o.one
       LATERAL VIEW explode(sequence(1, length(p.w3))) AS k
"""

#: Of each such end: how often the two words go on and end, and how often a longer word follows the first of them.
_BY_PAIR = r"""
SELECT o.w2, o.w3, sum(CASE WHEN a.w3 = o.w3 THEN n_inside ELSE 0 END) AS p_inside, sum(CASE WHEN a.w3 = o.w3 THEN n_end ELSE 0 END) AS p_end,
       sum(CASE WHEN a.w3 <> o.w3 THEN n_inside + n_end - n_last ELSE 0 END) AS p_longer
FROM {open_pairs} o JOIN {alike} a ON a.w2 = o.w2 AND left(a.w3, a.k) = o.w3 GROUP BY o.w2, o.w3
"""

#: The same of its last word alone.
_VOCABULARY = "SELECT w3, sum(n_inside) AS n_inside, sum(n_end) AS n_end, sum(n_last) AS n_last FROM {pairs} GROUP BY w3"
_BY_WORD = r"""
SELECT o.w3, sum(CASE WHEN a.w3 = o.w3 THEN n_inside ELSE 0 END) AS v_inside, sum(CASE WHEN a.w3 = o.w3 THEN n_end ELSE 0 END) AS v_end,
       sum(CASE WHEN a.w3 = o.w3 THEN n_last ELSE 0 END) AS v_last, sum(CASE WHEN a.w3 <> o.w3 THEN n_inside + n_end - n_last ELSE 0 END) AS v_longer
FROM (SELECT DISTINCT w3 FROM {open_pairs}) o
JOIN (SELECT v.*, k FROM {vocabulary} v LEFT SEMI JOIN (SELECT DISTINCT left(w3, 3) AS three FROM {open_pairs}) s ON left(v.w3, 3) = s.three
      LATERAL VIEW explode(sequence(least(3, length(v.w3)), length(v.w3))) AS k) a ON left(a.w3, a.k) = o.w3
GROUP BY o.w3
"""

#: What the ends say. In order: a mark of the cut; a last trigram, else pair, else word, that goes on inside texts and
#: almost never ends a clause; a last word that is only the beginning of those that follow the word before it, or that
#: is the beginning of others and stands nowhere but at an end. Ends on numbers vary, so only a beginning counts there,
#: and only if it is far rarer than what is longer.
_SAID = r"""
SELECT e.id, e.field, e.source, e.n, e.open_end, e.may_go_on AND NOT e.on_number AS may_go_on,
  CASE
    WHEN e.reason IS NOT NULL OR NOT e.may_go_on THEN e.reason
    WHEN NOT on_number AND ((t_inside + t_end - 1 < {often} AND p_inside >= {often} AND p_inside >= {ratio} * p_end)
      OR (coalesce(p_inside + p_end - 1, 0) < {often} AND v_inside >= {often} AND v_inside >= {ratio} * v_end)) THEN 'pair_goes_on'
    WHEN (p_longer >= {often} AND p_longer >= {ratio} * if(on_number, {ratio}, 1) * (p_inside + p_end))
      OR (NOT on_number AND coalesce(v_inside + v_end, 0) <= coalesce(v_last, 0) AND v_longer >= 1) THEN 'pair_part_of_word'
  END AS reason
FROM {by_trigram} e LEFT JOIN {by_pair} p ON e.w2 = p.w2 AND e.w3 = p.w3 LEFT JOIN {by_word} v ON e.w3 = v.w3
"""

#: Limits of fields: lengths at which far more values of a source end than at the lengths beside them, many of them visibly cut.
_LIMITS = r"""
SELECT source, field, n FROM (
  SELECT source, field, n, k, k_cut,
         (sum(k) OVER (PARTITION BY source, field ORDER BY n RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) - k) / 10 AS expected
  FROM (SELECT source, field, n, count(1) AS k, count(reason) AS k_cut FROM {said} GROUP BY source, field, n))
WHERE k >= {least} AND k >= {times} * (expected + 1) AND k_cut >= {visibly} * k
"""

#: Fields in which a text that ends on a word, without a closing mark, is nearly always visibly cut.
_OPEN = r"""
SELECT field FROM {said} WHERE open_end GROUP BY field HAVING count(1) >= {least} AND count(reason) >= {nearly_all} * count(1)
"""

_FOUND = r"""
SELECT s.id, s.field, s.source,
       coalesce(s.reason, CASE WHEN l.n IS NOT NULL AND s.may_go_on THEN 'limit' WHEN o.field IS NOT NULL AND s.open_end THEN 'open_end' END) AS reason
FROM {said} s
LEFT JOIN {limits} l ON s.source <=> l.source AND s.field = l.field AND s.n = l.n
LEFT JOIN {open} o ON s.field = o.field
"""

_RATES = r"""
SELECT source, field, count(1) AS n_values, count(reason) AS n_cut, round(count(reason) / count(1), 6) AS share_cut,
       count_if(reason IN ('goes_on', 'part_of_word')) AS by_trigram, count_if(reason LIKE 'pair%') AS by_pair, count_if(reason = 'mark') AS by_mark, count_if(reason IN ('limit', 'open_end')) AS by_length
FROM {found} GROUP BY source, field
"""

#: Characters at the end of a text from which its last words are taken, if they hold enough.
TAIL = 120
#: A trigram counts as seen if it stands so often in other places; going on is so many times as common as ending.
OFTEN, RATIO = 3, 10
#: A trigram with a longer last word counts if it stands so often in other places.
SEEN = 1
#: A limit has so many values, so many times those expected by the lengths beside it, of which this share is visibly cut.
LEAST, TIMES, VISIBLY = 12, 4, 0.25
#: Share of the open ends of a field that must be visibly cut for all of them to count.
NEARLY_ALL = 0.9


def truncated(df: DataFrame, key: str, source: str, fields: list[str]) -> DataFrame:
    """(id, field, source, reason) for every value of the named fields that isn't null or blank; reason is null where nothing was lost.

    Reasons: mark (of the cut); goes_on and part_of_word, by trigrams; pair_goes_on and pair_part_of_word, by pairs and words
    where a trigram is too rare to tell; limit, open_end. All counts are over all values of all fields. Nulls and blanks
    give no row; a null source is a source of its own; texts of any length are read whole; equal rows each give
    their own; other columns of df play no part.
    """
    spark = df.sparkSession
    values = None
    for f in fields:
        part = df.selectExpr(f"`{key}` AS id", f"'{f}' AS field", f"`{source}` AS source", f"`{f}` AS text")
        values = part if values is None else values.unionByName(part)
    words = spark.sql(_VALUES, values=values, tail=TAIL)
    runs = cut(spark.sql(_RUNS, spots=spark.sql(_SPOTS, words=words)))
    ends = cut(spark.sql(_ENDS, words=words, tail=TAIL))
    of_trigram = spark.sql(_OF_TRIGRAM, ends=ends, trigrams=spark.sql(_TRIGRAMS, runs=runs))
    by_trigram = cut(spark.sql(_BY_TRIGRAM, ends=ends, of_trigram=of_trigram, often=OFTEN, seen=SEEN, ratio=RATIO))
    open_pairs = cut(spark.sql(_OPEN_PAIRS, by_trigram=by_trigram))
    pairs = spark.sql(_PAIRS, runs=runs)
    by_pair = spark.sql(_BY_PAIR, open_pairs=open_pairs, alike=spark.sql(_ALIKE, pairs=pairs, open_pairs=open_pairs))
    by_word = spark.sql(_BY_WORD, open_pairs=open_pairs, vocabulary=spark.sql(_VOCABULARY, pairs=pairs))
    said = cut(spark.sql(_SAID, by_trigram=by_trigram, by_pair=by_pair, by_word=by_word, often=OFTEN, ratio=RATIO))
    limits = spark.sql(_LIMITS, said=said, least=LEAST, times=TIMES, visibly=VISIBLY)
    open_fields = spark.sql(_OPEN, said=said, least=LEAST, nearly_all=NEARLY_ALL)
    return spark.sql(_FOUND, said=said, limits=limits, open=open_fields)


def truncation_rates(found: DataFrame) -> DataFrame:
    """(source, field, n_values, n_cut, share_cut, by_trigram, by_pair, by_mark, by_length): how often each source cuts each field, and what told so."""
    return found.sparkSession.sql(_RATES, found=found)
