"""Predicates on lines, entries and results. Text is expected cleaned; patterns are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from refmill.functions.text import DOI, YEAR, extract_year

#: Headings that open a reference list, and what a heading after it begins with, by their letters.
HEADINGS = ("references", "bibliography", "workscited", "referencelist")
END_HEADINGS = (
    "appendix", "appendices", "annex", "annexes", "acknowledgments", "acknowledgements", "declarations", "funding", "fundinginformation", "conflictofinterest", "conflictsofinterest",
    "authorbiographies", "authorbiography", "biographicalnotes", "abouttheauthors", "authordetails", "howtocitethisarticle",
)
#: Ends of a list inside a line; what stands before them still belongs to it.
END_INLINE = (
    r"(?i)(?<![\p{L}\p{N}_])(?:\d{1,4}\s+)?(?:appendix|appendices|annex|annexes|附录)\s+[A-Z0-9IVX一二三四五六七八九十]+[:：.\-–—]",
    r"(?i)(?<![\p{L}\p{N}_])(?:how\s+to\s+cite\s+this\s+article|author\s+biograph(?:y|ies)|biographical\s+notes|about\s+the\s+authors)",
)
_MAY_END = r"(?i)append|annex|附录|to\s+cite|biograph|the\s+authors"
UPPER = "A-ZÀ-ÖØ-Þ"
LETTER = r"\p{L}\p{N}_'’\-"
_DATED = r"(?:18|19|20)[0-9]{2}[a-z]?"
#: How an entry begins: with a number, a person and a year, a body and a date, or Chinese and a year.
NUMBERED = r"^\s*(?:\[[0-9]+\]|[0-9]{1,3}[.)])\s+"
PERSON = rf"^[{UPPER}][{LETTER}]+(?:\s+[{UPPER}][{LETTER}]+)*,\s*(?:[{UPPER}]\.(?:\s*-\s*[{UPPER}]\.)?\s*){{1,4}}(?:.{{0,220}}?(?:\(|\b){_DATED})"
BODY = rf"^[{UPPER}][{LETTER}&]*(?:\s+(?:[{UPPER}][{LETTER}&]+|of|and|the)){{0,11}}\.\s*(?:\((?:{_DATED}(?:,\s*[^)]{{1,40}})?|n\.?\s*d\.?)\)|{_DATED}\.)"
CHINESE = rf"^[\x{{3400}}-\x{{9fff}}].{{0,100}}?[（(]{_DATED}[）)]"
STARTS = (NUMBERED, PERSON, BODY, CHINESE)
NO_DATE = r"\(\s*n\.?\s*d\.?\s*\)"
PUBLISHED = r"(?i)\(\s*(?:18|19|20)[0-9]{2}[a-z]?(?:,\s*[^)]{1,40})?\)|\b(?:18|19|20)[0-9]{2}[a-z]?\b"
FRAGMENT_LINK = r"(?i)^(?:https?://|doi\s*:)"
FRAGMENT_VOLUME = rf"(?i)^[{UPPER}][{LETTER}& ]{{2,60}},\s*(?:[0-9]{{1,4}}|vol\.?\b|no\.?\b|article\b)"
DOI_WITH_LEAD = r"(?i)(?:https?://(?:dx\.)?doi\.org/|doi\s*:\s*)?" + DOI
PUBLISHER = r"(?i)Downloaded\s+from|Wiley\s+Online\s+Library|Terms\s+and\s+Conditions|articles?\s+are\s+governed\s+by|Page\s+\d+\s+of\s+\d+"
#: Parse flags that forbid a look-up.
FATAL = (
    "SPLIT_CITATION", "MERGED_CITATION", "APPENDIX_CONTAMINATION", "REFERENCE_BOUNDARY_CONTAMINATION", "WATERMARK_CONTAMINATION", "SELF_DOI_CONTAMINATION", "BIOGRAPHY_CONTAMINATION",
)
#: Flags and what in an entry raises them.
CONTENT_FLAGS = {
    "APPENDIX_CONTAMINATION": r"(?i)\b(?:appendix|appendices|annex|annexes)\b|附录",
    "WATERMARK_CONTAMINATION": r"(?i)Downloaded\s+from|Wiley\s+Online\s+Library|Terms\s+and\s+Conditions",
    "BIOGRAPHY_CONTAMINATION": r"(?i)\bAUTHOR\s+BIOGRAPH(?:Y|IES)\b|\bis\s+(?:a|an|the)\s+(?:Professor|Dean|Research Associate)",
    "REFERENCE_BOUNDARY_CONTAMINATION": r"(?i)\bHow\s+to\s+cite\s+this\s+article\s*:",
}
#: Statuses that count as accepted.
ACCEPTED = ("verified", "web_validated", "grey_literature_validated")


def heading_key(line: Column) -> Column:
    """The letters a-z of a line without its section number."""
    return F.regexp_replace(F.lower(F.regexp_replace(line, r"^\s*[0-9]+(?:\.[0-9]+)*\s*", "")), "[^a-z]", "")


def is_heading(line: Column) -> Column:
    return (F.length(line) <= 100) & heading_key(line).isin(*HEADINGS)


def is_end_heading(line: Column) -> Column:
    return (line != "") & (F.length(line) <= 180) & heading_key(line).rlike("^(?:" + "|".join(END_HEADINGS) + ")")


def before_end(line: Column) -> Column:
    """What of a line belongs to the list: nothing of an end heading, of an end inside the line what stands before it."""
    first = F.when(line.rlike(END_INLINE[0]), F.trim(F.regexp_replace(line, "(?s)" + END_INLINE[0] + ".*$", "")))
    cut = F.coalesce(first, F.trim(F.regexp_replace(line, "(?s)" + END_INLINE[1] + ".*$", "")))
    # few lines have any of the words, and words are found sooner than the patterns
    return F.when(is_end_heading(line), F.lit("")).when(line.rlike(_MAY_END), cut).otherwise(line)


def is_start(line: Column) -> Column:
    """Whether an entry begins here; a blank text begins none."""
    found = line.rlike(STARTS[0])
    for p in STARTS[1:]:
        found = found | line.rlike(p)
    return found


def has_bibliographic_year(text: Column) -> Column:
    """Whether a year is left once DOIs are taken away."""
    return F.regexp_replace(text, DOI_WITH_LEAD, "").rlike(YEAR)


def is_fragment(line: Column) -> Column:
    """Whether a line goes on with an entry begun before: a link, a venue with its volume, or a DOI in few words without a year."""
    bare_doi = line.rlike(DOI) & (F.size(F.split(line, " ")) < 18) & ~has_bibliographic_year(line)
    return (line != "") & ~is_start(line) & (line.rlike(FRAGMENT_LINK) | line.rlike(FRAGMENT_VOLUME) | bare_doi)


def is_titled_start(line: Column, before: Column) -> Column:
    """Whether a dated line begins an entry by its title, the text before it being complete."""
    complete = before.endswith(".") | before.rlike(r"(?i)https?://\S+$") | F.right(before, F.lit(180)).rlike(DOI)
    return (line.rlike(PUBLISHED) | line.rlike(NO_DATE)) & complete


def looks_like_reference(text: Column) -> Column:
    return (F.length(text) >= 25) & (extract_year(text).isNotNull() | text.rlike(DOI) | text.rlike(NO_DATE))


def is_page_number(line: Column) -> Column:
    return line.rlike(r"^\s*[0-9]{1,4}\s*$")


def has_fatal_flag(flags: Column) -> Column:
    return F.coalesce(F.arrays_overlap(flags, F.array(*(F.lit(f) for f in FATAL))), F.lit(False))


def is_publisher_noise(text: Column) -> Column:
    return text.rlike(PUBLISHER)


def is_coverage_gap(raw: Column, doi: Column) -> Column:
    """Whether registries are likely not to hold the work."""
    grey = raw.rlike(r"(?i)\b(?:thesis|dissertation|report|white\s+paper|working\s+paper|cnki|cctv)\b")
    return raw.rlike(r"[\x{3400}-\x{9fff}]") | grey | (raw.rlike(r"(?i)https?://") & (doi == ""))


def is_accepted(status: Column) -> Column:
    return status.isin(*ACCEPTED)


def diagnose(text: Column) -> Column:
    """The flags an entry's text raises, in a fixed order."""
    several_links = F.size(F.split(text, "(?i)https?://")) > 2
    checks = [(F.regexp_count(text, F.lit(DOI)) >= 2, "MERGED_CITATION"), (several_links, "MULTIPLE_URLS"), (is_fragment(text), "SPLIT_CITATION")]
    checks += [(text.rlike(p), flag) for flag, p in CONTENT_FLAGS.items()]
    return F.array_compact(F.array(*(F.when(c, F.lit(flag)) for c, flag in checks)))
