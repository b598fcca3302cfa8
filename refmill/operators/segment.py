"""From text to reference entries: section, entries, pieces. A text is worked on where it lies, as an array of lines; nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refmill.functions import predicates as P
from refmill.functions.text import DOI, collapse, extract_year, resolve

#: Marks put before a line while lines are joined: an entry begins; the line goes on with one; the line was lost from one.
START, GOES_ON = "\x01", "\x02"
_NEXT = "|".join(p.removeprefix("^") for p in P.STARTS)
#: Where an entry may begin within a line: after a closing mark, or after a DOI and what closes it.
_INSIDE = rf"(?=\s+(?:{_NEXT}))(?:(?<=[.;)\]])|(?<=10\.[0-9]{{4,9}}/[-._;()/:A-Za-z0-9]{{1,200}}[,\]}}]{{0,3}}))\s+"


def lines_of(text: Column) -> Column:
    """The lines of a text, each cleaned; [] for null. Works on a column that resolve() gave."""
    return F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), collapse)


def _first_at(flags: Column) -> Column:
    """The place, from 1, of the first true; 0 if there is none."""
    return F.coalesce(F.array_position(flags, True), F.lit(0))


def with_section(df: DataFrame, text: str) -> DataFrame:
    """df with lines (those of the reference list, up to its end), first_pos (the place of the first) and has_heading.

    A text without a heading is taken whole, and end headings don't count in it. Blank lines stay in place, so that
    places are those of the text; null and empty texts have no lines that aren't blank.
    """
    rows = df.withColumn("text_", resolve(F.col(text))).withColumn("all_", lines_of(F.col("text_")))
    rows = rows.withColumn("head_", _first_at(F.transform("all_", P.is_heading)))
    rows = rows.withColumn("after_", F.when(F.col("head_") > 0, F.slice("all_", F.col("head_") + 1, F.greatest(F.size("all_") - F.col("head_"), F.lit(0)))).otherwise(F.col("all_")))
    rows = rows.withColumn("kept_", F.when(F.col("head_") > 0, F.transform("after_", P.before_end)).otherwise(F.col("after_")))
    rows = rows.withColumn("end_", _first_at(F.zip_with("kept_", "after_", lambda a, b: a != b)))
    lines = F.when(F.col("end_") > 0, F.slice("kept_", F.lit(1), F.col("end_"))).otherwise(F.col("kept_"))
    return rows.withColumns({"lines": lines, "first_pos": F.col("head_") + 1, "has_heading": F.col("head_") > 0}).drop("text_", "all_", "head_", "after_", "kept_", "end_")


def entries(df: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, entry, raw, repaired, lost): the entries of with_section()'s lines, each from a line that begins one to the next.

    repaired: a line in it goes on with an entry begun before; lost: it is the first and such a line itself.
    Entries are numbered in their order from 1, those that don't look like a reference included.
    """
    mark = lambda x: F.concat(F.when(P.is_start(x), F.lit(START)).when(P.is_fragment(x), F.lit(" " + GOES_ON)).otherwise(F.lit(" ")), x)
    full = F.filter("lines", lambda x: x != "")
    joined = F.trim(F.array_join(F.transform(full, mark), ""))
    # a first line that begins an entry leaves an empty piece before it
    pieces = F.filter(F.split(joined, START), lambda x: x != "")
    rows = df.select(*keys, F.posexplode(pieces).alias("p", "x"))
    lost = (F.col("p") == 0) & F.col("x").startswith(GOES_ON)
    repaired = F.col("x").contains(" " + GOES_ON)
    return rows.select(*keys, (F.col("p") + 1).alias("entry"), F.trim(F.replace("x", F.lit(GOES_ON), F.lit(""))).alias("raw"), repaired.alias("repaired"), lost.alias("lost"))


def inline_pieces(raw: Column) -> Column:
    """The entries within one: cut where another begins after a DOI, or after a closing mark once a year has been read."""
    cut = F.split(raw, _INSIDE)
    ends_in_doi = lambda a: a.rlike(DOI + r"[ .;,)\]}]*$")
    complete = lambda a: ends_in_doi(a) | ((F.length(a) >= 24) & P.has_bibliographic_year(a))

    # what was read before a piece is all pieces before it; START keeps them apart
    def put(a: Column, b: Column) -> Column:
        return F.concat(a, F.when(complete(F.replace(a, F.lit(START), F.lit(" "))), F.lit(START)).otherwise(F.lit(" ")), b)

    return F.split(F.aggregate(F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0))), F.element_at(cut, 1), put), START)


def references(df: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, ordinal, raw, flags): the references of entries(), those merged in one cut apart, with what is wrong with each. Pieces that don't look like one are left out."""
    rows = df.withColumn("pieces", inline_pieces(F.col("raw"))).select(*keys, "entry", "repaired", "lost", F.size("pieces").alias("n"), F.posexplode("pieces").alias("piece", "raw"))
    rows = rows.where(P.looks_like_reference(F.col("raw")))
    own = F.array_compact(F.array(F.when(F.col("lost"), F.lit("SPLIT_CITATION")), F.when(F.col("repaired"), F.lit("SPLIT_CITATION_REPAIRED")), F.when(F.col("n") > 1, F.lit("MERGED_CITATION_REPAIRED"))))
    return rows.select(*keys, "entry", "piece", "raw", F.array_distinct(F.concat(own, P.diagnose(F.col("raw")))).alias("flags"))


# Pages ------------------------------------------------------------------------------------------------------------


def boundary_lines(pages: DataFrame, doc: str, page: str, lines: str) -> DataFrame:
    """(doc, line_key, n_pages): lines among the first or last two of a page that stand so on two pages or more, but for case.

    Lines with a year or DOI, headings, and those over 100 characters aren't counted; page numbers are handled apart.
    """
    n = F.size(lines)
    at_edge = F.filter(F.transform(lines, lambda x, i: F.when((i < 2) | (i >= n - 2), x)), lambda x: x.isNotNull())
    plain = lambda x: (x != "") & (F.length(x) <= 100) & extract_year(x).isNull() & ~x.rlike(DOI) & ~P.is_heading(x) & ~P.is_end_heading(x)
    keys = F.array_distinct(F.transform(F.filter(at_edge, plain), lambda x: F.lower(x)))
    return pages.select(doc, page, F.explode(keys).alias("line_key")).groupBy(doc, "line_key").agg(F.count(F.lit(1)).alias("n_pages")).where("n_pages >= 2")


def strip_boundaries(pages: DataFrame, doc: str, page: str, lines: str) -> DataFrame:
    """pages (doc, page, lines) without repeated headers and footers at the edges, and without page numbers anywhere."""
    found = boundary_lines(pages, doc, page, lines).groupBy(doc).agg(F.collect_set("line_key").alias("repeated_"))
    n = F.size(lines)
    known = F.coalesce("repeated_", F.array().cast("array<string>"))
    kept = F.filter(F.transform(lines, lambda x, i: F.when(((i < 2) | (i >= n - 2)) & F.array_contains(known, F.lower(x)) | P.is_page_number(x), None).otherwise(x)), lambda x: x.isNotNull())
    return pages.join(found, doc, "left").withColumn(lines, kept).drop("repeated_")


def page_section(pages: DataFrame, doc: str, page: str, lines: str) -> DataFrame:
    """(doc, page, pos, line): the reference list over pages: after the first heading, else from the start, up to an end heading, which counts either way.

    Repeated headings and page numbers are dropped. pages holds one row per page with its lines.
    """
    rows = pages.select(doc, page, F.posexplode(lines).alias("pos", "line")).where("line <> ''")
    rows = rows.withColumn("kept", P.before_end(F.col("line")))
    at = F.struct(page, "pos")
    every = Window.partitionBy(doc)
    rows = rows.withColumn("head", F.min(F.when(P.is_heading(F.col("line")), at)).over(every))
    after = F.col("head").isNull() | (at > F.col("head"))
    rows = rows.withColumn("end", F.min(F.when(after & (F.col("kept") != F.col("line")), at)).over(every)).where(after & (F.col("end").isNull() | (at <= F.col("end"))))
    return rows.where((F.col("kept") != "") & ~P.is_heading(F.col("kept")) & ~P.is_page_number(F.col("kept"))).select(doc, page, "pos", F.col("kept").alias("line"))


def late_pages(pages: DataFrame, doc: str, page: str, has_heading: Column) -> DataFrame:
    """The pages to read of documents without a reference heading: from the place of two thirds (0.67) on; all pages of the others."""
    every = Window.partitionBy(doc)
    rows = pages.withColumns({"n_": F.count(F.lit(1)).over(every), "any_": F.max(has_heading).over(every), "at_": F.row_number().over(every.orderBy(page)) - 1})
    return rows.where(F.col("any_") | (F.col("at_") >= F.floor(F.col("n_") * 0.67))).drop("n_", "any_", "at_")


def hinted_entries(lines: DataFrame, doc: str) -> DataFrame:
    """(doc, entry, raw, first_page, last_page, flags) of page lines (doc, page, pos, line, hint), hint telling that a line stands at the margin where entries begin.

    A hinted line begins an entry; on a new page it must also look like a start, or be dated after a complete text, else
    the entry is one split over pages. What came before is known only by reading on, so each document is folded in
    its order, as an array of its lines; its text is bounded by its reference list.
    """
    item = F.struct("page", "pos", F.col("line"), "hint", P.is_start(F.col("line")).alias("start"), P.is_fragment(F.col("line")).alias("fragment"))
    rows = lines.where("line <> ''").groupBy(doc).agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.lit(None).cast("int")
    empty = F.struct(F.array().cast("array<struct<raw:string,first_page:int,last_page:int,flags:array<string>>>").alias("done"), F.lit("").alias("raw"), none.alias("first_page"), none.alias("last_page"), F.array().cast("array<string>").alias("flags"))
    hinted = F.exists("items", lambda x: x["hint"])

    def close(a: Column) -> Column:
        return F.concat(a["done"], F.array(F.struct(a["raw"].alias("raw"), a["first_page"].alias("first_page"), a["last_page"].alias("last_page"), F.array_distinct(a["flags"]).alias("flags"))))

    def step(a: Column, x: Column) -> Column:
        page, open_ = x["page"].cast("int"), a["raw"] != ""
        split = open_ & (page != a["last_page"]) & x["hint"] & ~x["start"] & ~P.is_titled_start(x["line"], a["raw"])
        begins = open_ & F.when(hinted, x["hint"] & ~split).otherwise(x["start"])
        flag = F.when(split | (open_ & ~begins & x["fragment"]), F.array(F.lit("SPLIT_CITATION_REPAIRED"))).when(~open_ & x["fragment"], F.array(F.lit("SPLIT_CITATION"))).otherwise(F.array().cast("array<string>"))
        fresh = F.struct(close(a).alias("done"), x["line"].alias("raw"), page.alias("first_page"), page.alias("last_page"), F.array().cast("array<string>").alias("flags"))
        more = F.struct(a["done"].alias("done"), F.trim(F.concat_ws(" ", a["raw"], x["line"])).alias("raw"), F.coalesce(a["first_page"], page).alias("first_page"), page.alias("last_page"), F.concat(a["flags"], flag).alias("flags"))
        return F.when(begins, fresh).otherwise(more)

    out = rows.select(doc, F.posexplode(F.aggregate("items", empty, step, close)).alias("p", "e")).where("e.raw <> ''")
    return out.select(doc, (F.col("p") + 1).alias("entry"), "e.raw", "e.first_page", "e.last_page", "e.flags")
