"""The fields of a reference: identifiers, year, authors, title, venue, kind and how far to trust them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refmill.functions import predicates as P
from refmill.functions.text import collapse, doi_in, repair_identifiers, url_in, venue_head

#: The year of publication with what belongs to it, in brackets or bare; marks taken off around it.
IN_BRACKETS = r"\(\s*((?:18|19|20)[0-9]{2})[a-z]?(?:,\s*[^)]{1,40})?\)\s*[.,;:]?\s*"
BARE_YEAR = r"\b((?:18|19|20)[0-9]{2})[a-z]?\b\s*[.,;:]?\s*"
BEFORE_YEAR, AFTER_NO_DATE, AROUND = " ,.;()", " .,:;", " .;,"
#: Family name and initials; what parts names written otherwise; names kept at most.
FAMILY = rf"(?:^|,\s+|&\s+)([{P.UPPER}][{P.LETTER}]*(?:\s+[{P.UPPER}][{P.LETTER}]*)?),\s*((?:[A-Z]\.?(?:\s*|-)?)+)"
BETWEEN = r"\s*(?:;|\s&\s|\sand\s)\s*"
MOST_AUTHORS = 12
#: Words and forms that tell the kind of work, in the order asked.
KINDS = (
    ("book_thesis", r"(?i)\b(?:master'?s\s+thesis|doctoral\s+thesis|ph\.?d\.?\s+thesis|dissertation|handbook|monograph|isbn|book\s+chapter|university\s+press)\b", None),
    ("scholarly", r"(?i)\b(?:journal|proceedings|conference|volume|vol\.?|issue)\b|\b[0-9]+\s*\([0-9]+\)\s*[:,]", "doi"),
    ("web_policy", r"(?i)\b(?:policy|guidelines?|report|university|institute|association|commission|government|publisher)\b", "url"),
)
#: What is taken from a confidence of 1.
PENALTY = {"title": 0.35, "authors": 0.18, "year": 0.12, "unknown": 0.18, "urls": 0.30, "merged": 0.08, "split": 0.03, "very_long": 0.35, "long": 0.18}


def publication_year(raw: Column) -> Column:
    """The year in brackets, else the first bare one, else null."""
    return F.coalesce(*(F.nullif(F.regexp_extract(raw, "(?i)" + p, 1), F.lit("")).cast("int") for p in (IN_BRACKETS, BARE_YEAR)))


def split_at_year(raw: Column) -> tuple[Column, Column]:
    """What stands before and after the year of publication; else before and after "n.d."; else up to the first full stop, and all."""
    left, right = F.element_at(F.split(raw, r"\.", 2), 1), raw
    for pattern, strip in ((P.NO_DATE, AFTER_NO_DATE), ("(?i)" + BARE_YEAR, " "), ("(?i)" + IN_BRACKETS, " ")):
        halves, found = F.split(raw, pattern, 2), raw.rlike(pattern)
        left = F.when(found, F.btrim(F.element_at(halves, 1), F.lit(BEFORE_YEAR))).otherwise(left)
        right = F.when(found, F.btrim(F.get(halves, F.lit(1)), F.lit(strip))).otherwise(right)
    return left, right


def parse_authors(text: Column) -> Column:
    """Names as "Family, I. I." where written so, else what stands between semicolons, "&" and "and"; at most MOST_AUTHORS."""
    plain = F.regexp_replace(text, r"(?i)\bet\s+al\.?", "")
    names = F.zip_with(F.regexp_extract_all(plain, F.lit(FAMILY), F.lit(1)), F.regexp_extract_all(plain, F.lit(FAMILY), F.lit(2)), lambda a, b: collapse(F.concat(a, F.lit(", "), b)))
    other = F.filter(F.transform(F.split(plain, BETWEEN), lambda x: collapse(F.btrim(x, F.lit(" ,.;")))), lambda x: x != "")
    return F.slice(F.when(F.size(names) > 0, names).otherwise(other), 1, MOST_AUTHORS)


def title_and_venue(rest: Column, doi: Column) -> tuple[Column, Column]:
    """Title and venue of what follows the year: a quoted title, one before "arXiv preprint", else the first two sentences, else parts between commas."""
    lead = F.lit(r"(?i)(?:https?://(?:dx\.)?doi\.org/|doi\s*:\s*)?\Q")
    text = F.when(doi != "", F.regexp_replace(rest, F.concat(lead, doi, F.lit(r"\E")), F.lit(""))).otherwise(rest)
    text = F.btrim(collapse(F.regexp_replace(text, "(?i)https?://.*$", "")), F.lit(AROUND))
    return _title(text), _venue(text)


_QUOTED = r"^[“\"](.+?)[”\"]\s*(.*)$"
_ARXIV = r"(?i)^(.+?)\.\s+(arXiv\s+preprint\b.*)$"


def _sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, rf"\.\s+(?=[{P.UPPER}])"), lambda x: F.btrim(x, F.lit(AROUND)))
    return F.filter(parts, lambda x: x != "")


def _commas(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")


def _title(text: Column) -> Column:
    one = F.coalesce(F.get(_commas(text), F.lit(0)), text)
    return (
        F.when(text == "", "")
        .when(text.rlike(_QUOTED), F.btrim(F.regexp_extract(text, _QUOTED, 1), F.lit(AROUND + '"“”')))
        .when(text.rlike(_ARXIV), F.btrim(F.regexp_extract(text, _ARXIV, 1), F.lit(AROUND)))
        .otherwise(F.when(F.size(_sentences(text)) == 1, one).otherwise(F.coalesce(F.get(_sentences(text), F.lit(0)), F.lit(""))))
    )


def _venue(text: Column) -> Column:
    one = F.array_join(F.slice(_commas(text), 2, 2), ", ")
    return (
        F.when(text == "", "")
        .when(text.rlike(_QUOTED), venue_head(F.regexp_extract(text, _QUOTED, 2)))
        .when(text.rlike(_ARXIV), venue_head(F.regexp_extract(text, _ARXIV, 2)))
        .otherwise(F.when(F.size(_sentences(text)) == 1, one).otherwise(F.coalesce(F.get(_sentences(text), F.lit(1)), F.lit(""))))
    )


def citation_kind(raw: Column, doi: Column, url: Column) -> Column:
    known = {"doi": doi != "", "url": url != ""}
    out = None
    for kind, words, field in KINDS:
        told = raw.rlike(words) if field is None else known[field] | raw.rlike(words)
        out = F.when(told, kind) if out is None else out.when(told, kind)
    return out.otherwise("unknown")


def parse_confidence(raw: Column, title: Column, authors: Column, year: Column, doi: Column, url: Column, kind: Column, flags: Column) -> Column:
    """1 less what is missing, doubtful or repaired; 0 with a fatal flag."""
    off = lambda c, k: F.when(c, F.lit(PENALTY[k])).otherwise(0.0)
    scholarly = kind == "scholarly"
    lost = (
        off(F.length(title) < 8, "title") + off(scholarly & (F.size(authors) == 0), "authors") + off(scholarly & year.isNull(), "year")
        + off((kind == "unknown") & (doi == "") & (url == ""), "unknown") + off(F.array_contains(flags, "MULTIPLE_URLS"), "urls")
        + off(F.array_contains(flags, "MERGED_CITATION_REPAIRED"), "merged") + off(F.array_contains(flags, "SPLIT_CITATION_REPAIRED"), "split")
        + F.when(F.length(raw) > 1200, PENALTY["very_long"]).when(F.length(raw) > 700, PENALTY["long"]).otherwise(0.0)
    )
    return F.when(P.has_fatal_flag(flags), 0.0).otherwise(F.round(F.greatest(F.lit(0.0), 1 - lost), 4))


def parse_citations(df: DataFrame, raw: str, flags: str | None = None, document_doi: str | None = None) -> DataFrame:
    """df with raw_citation, doi, url, year, authors, title, venue, parse_flags, citation_type and parse_confidence of the reference in column raw.

    flags: a column of flags known before; document_doi: one with the DOI of the document the reference stands in.
    Null and empty references give empty fields and low confidence. Columns of df by these names are replaced.
    """
    known = F.coalesce(F.col(flags), F.array().cast("array<string>")) if flags else F.array().cast("array<string>")
    own = F.coalesce(F.col(document_doi), F.lit("")) if document_doi else F.lit("")
    rows = df.withColumns({"known_": known, "own_": own, "fixed_": repair_identifiers(F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), P.NUMBERED, ""))})
    rows = rows.withColumn("raw_citation", F.regexp_replace("fixed_", r"(?U)(?<=\w)-\s+(?=\w)", ""))
    # joining words can put an identifier together that was parted at a hyphen
    text = F.col("raw_citation")
    rows = rows.withColumns({"doi": doi_in(text), "url": url_in(text), "year": publication_year(text)})
    left, right = split_at_year(text)
    rows = rows.withColumns({"left_": left, "right_": right})
    by_title = F.col("year").isNotNull() & (F.col("left_") != "") & ~F.col("left_").rlike(rf",\s*[{P.UPPER}](?:\.|$)") & ~text.rlike(P.BODY)
    title, venue = title_and_venue(F.col("right_"), F.col("doi"))
    rows = rows.withColumns({"by_title_": by_title, "title_": title, "venue_": venue})
    rows = rows.withColumns(
        {
            "authors": F.when(F.col("by_title_"), F.array().cast("array<string>")).otherwise(parse_authors(F.col("left_"))),
            "title": F.when(F.col("by_title_"), F.btrim(F.col("left_"), F.lit(" ."))).otherwise(F.col("title_")),
            "venue": F.when(F.col("by_title_"), F.coalesce(F.nullif("title_", F.lit("")), F.col("venue_"))).otherwise(F.col("venue_")),
            "parse_flags": F.array_distinct(F.concat("known_", P.diagnose(text), F.when((F.col("own_") != "") & (F.col("doi") == F.lower("own_")), F.array(F.lit("SELF_DOI_CONTAMINATION"))).otherwise(F.array().cast("array<string>")))),
            "citation_type": citation_kind(text, F.col("doi"), F.col("url")),
        }
    )
    c = {k: F.col(k) for k in ("title", "authors", "year", "doi", "url")}
    rows = rows.withColumn("parse_confidence", parse_confidence(text, **c, kind=F.col("citation_type"), flags=F.col("parse_flags")))
    return rows.drop("known_", "own_", "fixed_", "left_", "right_", "by_title_", "title_", "venue_")
