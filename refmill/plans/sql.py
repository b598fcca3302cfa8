"""Pieces of SQL by which queries are checked: the same meaning said by another engine's functions."""

from __future__ import annotations

import unicodedata

from refmill.functions import predicates as P
from refmill.operators.metrics import GROUPS, STATUSES  # noqa: F401


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _compatible() -> tuple[str, str]:
    """Characters whose compatibility form is one other character, and those forms; ideographs aside."""
    pairs = [(c, unicodedata.normalize("NFKC", c)) for c in map(chr, [*range(0xA0, 0xD800), *range(0xFB00, 0x10000), *range(0x1D400, 0x1D800)])]
    one = [(c, n) for c, n in pairs if len(n) == 1 and n != c]
    return "".join(c for c, _ in one), "".join(n for _, n in one)


_FROM, _TO = _compatible()
_LONGER = [(c, unicodedata.normalize("NFKC", c)) for c in "ﬀﬁﬂﬃﬄﬅﬆ№…℡™Ⅱ½¼¾"]
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", "\xa0"), ("&amp;", "&"))


def resolve(x: str) -> str:
    out = f"coalesce({x}, '')"
    for a, b in _ENTITIES:
        out = f"replace({out}, {quoted(a)}, {quoted(b)})"
    for a, b in _LONGER:
        out = f"replace({out}, {quoted(a)}, {quoted(b)})"
    return f"replace(nfc_normalize(translate({out}, {quoted(_FROM)}, {quoted(_TO)})), chr(173), '')"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[\\s\\x{{00a0}}\\x{{2028}}\\x{{2029}}\\x{{0085}}\\x{{000b}}]+', ' ', 'g'))"


def clean(x: str) -> str:
    return collapse(resolve(x))


def words(x: str) -> str:
    """Of text already cleaned."""
    return f"trim(regexp_replace(strip_accents(replace(lower({x}), 'ß', 'ss')), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def normal(x: str) -> str:
    return words(clean(x))


def doi(x: str) -> str:
    """The first DOI of text already cleaned."""
    return f"lower(rtrim(regexp_extract({x}, '10\\.[0-9]{{4,9}}/[-._;()/:A-Za-z0-9]+'), {quoted('.,;:)]}' + chr(34))}))"


def url(x: str) -> str:
    return f"rtrim(regexp_extract({x}, {quoted('(?i)https?://[^ <>' + chr(92) + '[' + chr(92) + ']{}' + chr(34) + chr(39) + ']+')}), {quoted('.,;:)]}' + chr(34))})"


def year(x: str, group: int = 1) -> str:
    return f"CAST(nullif(regexp_extract({x}, '(?:^|[^0-9])(1[89][0-9]{{2}}|20[0-9]{{2}}|2100)[A-Za-z]?(?:[^0-9]|$)', 1), '') AS INTEGER)"


def repaired(x: str) -> str:
    """Of text already cleaned: words put on without a blank where an identifier goes on."""
    goes_on = r"regexp_matches(a, '(?i)(?:10\.[0-9]{4,9}/(?:\S*[-_/.])?|https?://\S*[-/_=&?#%.])$') AND regexp_matches(b, '^[A-Za-z0-9]') OR regexp_matches(a, '(?i)\bdoi\.$') AND regexp_matches(b, '(?i)^org\b')"
    return f"list_reduce(string_split({x}, ' '), lambda a, b: a || CASE WHEN {goes_on} THEN '' ELSE ' ' END || b)"


def surname(x: str) -> str:
    """Of a name already cleaned."""
    return f"CASE WHEN contains({x}, ',') THEN {words(f'split_part({x}, {quoted(chr(44))}, 1)')} ELSE string_split({words(x)}, ' ')[-1] END"


_SLOTS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%()*+,-./:;<=>?@[]^{|}~" + "".join(map(chr, range(1, 32)))


def similarity(a: str, b: str) -> str:
    """Of normalized texts, by letters: the edit distance here counts bytes, so letters beyond ASCII are first put to free ASCII marks."""
    odd = f"array_to_string(list_distinct(regexp_extract_all({a} || {b}, '[^\\x00-\\x7F]')), '')"
    put = lambda t: f"translate({t}, {odd}, {quoted(_SLOTS)})"
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 1.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 1 - levenshtein({put(a)}, {put(b)}) / CAST(greatest(length({a}), length({b})) AS DOUBLE) END"


def re2(pattern: str) -> str:
    """A pattern as a literal; it must use nothing the other engine lacks."""
    return quoted(pattern)


LABEL = "CASE WHEN lower(trim(label)) IN ('valid','true','1','genuine','verified') THEN 'valid' WHEN lower(trim(label)) IN ('invalid','false','0','fake','ghost','hallucinated') THEN 'invalid' END"
ACCEPTED = "status IN ('verified', 'web_validated', 'grey_literature_validated')"
HEADING_KEY = "regexp_replace(lower(regexp_replace({0}, '^\\s*[0-9]+(?:\\.[0-9]+)*\\s*', '')), '[^a-z]', '', 'g')"
IS_HEADING = f"(length({{0}}) <= 100 AND {HEADING_KEY} IN {P.HEADINGS})"
IS_END_HEADING = f"({{0}} <> '' AND length({{0}}) <= 180 AND regexp_matches({HEADING_KEY}, '^(?:{'|'.join(P.END_HEADINGS)})'))"
_W = r"[\p{L}\p{N}_]"
END_INLINE = (
    r"(?i)(?:^|[^\p{L}\p{N}_])((?:\d{1,4}\s+)?(?:appendix|appendices|annex|annexes|附录)\s+[A-Z0-9IVX一二三四五六七八九十]+[:：.\-–—])",
    r"(?i)(?:^|[^\p{L}\p{N}_])((?:how\s+to\s+cite\s+this\s+article|author\s+biograph(?:y|ies)|biographical\s+notes|about\s+the\s+authors))",
)


def starts(x: str) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, {quoted(p)})" for p in P.STARTS) + ")"


def has_bibliographic_year(x: str) -> str:
    return f"({year(f'regexp_replace({x}, {quoted(P.DOI_WITH_LEAD)}, {quoted(str())}, {quoted(chr(103))})')} IS NOT NULL)"


def fragment(x: str) -> str:
    few = f"regexp_matches({x}, {quoted(P.DOI)}) AND len(string_split({x}, ' ')) < 18 AND NOT {has_bibliographic_year(x)}"
    return f"({x} <> '' AND NOT {starts(x)} AND (regexp_matches({x}, {quoted(P.FRAGMENT_LINK)}) OR regexp_matches({x}, {quoted(P.FRAGMENT_VOLUME)}) OR {few}))"


def flags(x: str) -> str:
    checks = [
        (f"len(regexp_extract_all({x}, {quoted(P.DOI)})) >= 2", "MERGED_CITATION"),
        (f"len(regexp_extract_all({x}, '(?i)https?://')) >= 2", "MULTIPLE_URLS"),
        (fragment(x), "SPLIT_CITATION"),
    ] + [(f"regexp_matches({x}, {quoted(p)})", f) for f, p in P.CONTENT_FLAGS.items()]
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{f}' END" for c, f in checks) + "], lambda f: f IS NOT NULL)"


FATAL = "(" + ", ".join(quoted(f) for f in P.FATAL) + ")"
