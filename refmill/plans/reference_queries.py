"""Queries of the core over whole tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refmill.functions import predicates as P
from refmill.functions import text as X
from refmill.operators import decide, fields, layout, metrics, review, scoring, segment
from refmill.plans import audit as A
from refmill.plans import sql as Q
from refmill.session import table
from refmill.sources import files, payloads, web

QUERIES, ORACLES = {}, {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return table(spark, d, name)


# Text functions ---------------------------------------------------------------------------------------------------

_CLEANED = f"WITH r AS (SELECT citation_id, {Q.clean('raw')} AS c, {Q.clean('doi')} AS d FROM citations), f AS (SELECT *, {Q.repaired('c')} AS fixed FROM r)"


@_query(f"{_CLEANED} SELECT citation_id, {Q.doi('d')} AS doi_norm FROM r")
def doi_normalize(spark, d):
    return _t(spark, d, "citations").select("citation_id", X.normalize_doi(F.col("doi")).alias("doi_norm"))


@_query(f"{_CLEANED} SELECT citation_id, {Q.doi('fixed')} AS doi_found FROM f")
def doi_extract(spark, d):
    return _t(spark, d, "citations").select("citation_id", X.extract_doi(F.col("raw")).alias("doi_found"))


@_query(f"{_CLEANED} SELECT citation_id, {Q.url('fixed')} AS url_found FROM f")
def url_extract(spark, d):
    return _t(spark, d, "citations").select("citation_id", X.extract_url(F.col("raw")).alias("url_found"))


@_query(f"SELECT citation_id, {Q.year('raw')} AS year_found FROM citations")
def year_extract(spark, d):
    return _t(spark, d, "citations").select("citation_id", X.extract_year(F.col("raw")).alias("year_found"))


@_query(f"{_CLEANED} SELECT citation_id, fixed AS raw_repaired FROM f")
def identifier_repair(spark, d):
    return _t(spark, d, "citations").select("citation_id", X.repair_identifiers(F.col("raw")).alias("raw_repaired"))


@_query(f"SELECT 'citation' AS kind, citation_id AS id, {Q.normal('raw')} AS words FROM citations UNION ALL SELECT 'candidate', candidate_id, {Q.normal('title')} FROM provider_candidates")
def text_normalize(spark, d):
    c = _t(spark, d, "citations").select(F.lit("citation").alias("kind"), F.col("citation_id").alias("id"), X.normalize_text(F.col("raw")).alias("words"))
    return c.unionByName(_t(spark, d, "provider_candidates").select(F.lit("candidate").alias("kind"), F.col("candidate_id").alias("id"), X.normalize_text(F.col("title")).alias("words")))


_NAMES = "list_filter(list_transform(list_transform(coalesce(authors, []), lambda a: " + Q.clean("a") + "), lambda a: " + Q.surname("a") + "), lambda s: s <> '')"


@_query(f"SELECT candidate_id, array_to_string({_NAMES}, '|') AS surnames FROM provider_candidates")
def author_surnames(spark, d):
    return _t(spark, d, "provider_candidates").select("candidate_id", F.array_join(X.surnames(F.col("authors")), "|").alias("surnames"))


_IDENTITY = "coalesce(nullif(doi, ''), nullif(url, ''), nullif(title, ''), nullif(raw, ''), '')"


@_query(f"SELECT cache_key, count(*) AS n, min(citation_id) AS first_id FROM (SELECT citation_id, 'crossref:' || sha256({Q.normal(_IDENTITY)}) AS cache_key FROM citations) GROUP BY cache_key")
def lookup_keys(spark, d):
    """One row per distinct look-up, with the number of citations it answers."""
    rows = _t(spark, d, "citations").select("citation_id", X.cache_key(F.lit("crossref"), *(F.col(c) for c in ("doi", "url", "title", "raw"))).alias("cache_key"))
    return rows.groupBy("cache_key").agg(F.count(F.lit(1)).alias("n"), F.min("citation_id").alias("first_id"))


@_query("SELECT result_id, array_to_string(list_filter(list_transform(string_split(coalesce(reasons, ''), '|'), lambda x: " + Q.collapse("x") + "), lambda x: x <> ''), '~') AS by_bar, len(list_filter(list_transform(string_split(coalesce(parsed_authors, ''), ';'), lambda x: " + Q.collapse("x") + "), lambda x: x <> '')) AS n_names FROM verification_results")
def list_splits(spark, d):
    rows = _t(spark, d, "verification_results")
    return rows.select("result_id", F.array_join(X.split_list(F.col("reasons"), "|"), "~").alias("by_bar"), F.size(X.split_list(F.col("parsed_authors"), ";")).cast("bigint").alias("n_names"))


@_query("SELECT result_id, TRY_CAST(nullif(trim(CAST(parsed_year AS VARCHAR)), '') AS INTEGER) AS year, TRY_CAST(nullif(trim(CAST(score AS VARCHAR)), '') AS DOUBLE) AS score, CASE WHEN doi_exact IS NULL THEN NULL ELSE lower(CAST(doi_exact AS VARCHAR)) IN ('true', '1', 'yes') END AS doi_exact, round(title_score, 4) AS title_score, CASE WHEN parsed_year BETWEEN 1800 AND 2100 THEN parsed_year END AS bounded FROM verification_results")
def optional_values(spark, d):
    rows, s = _t(spark, d, "verification_results"), lambda c: F.col(c).cast("string")
    return rows.select("result_id", X.optional_int(s("parsed_year")).alias("year"), X.optional_double(s("score")).alias("score"), X.optional_bool(s("doi_exact")).alias("doi_exact"), X.round4(F.col("title_score")).alias("title_score"), X.bounded_year(s("parsed_year")).alias("bounded"))


# Predicates -------------------------------------------------------------------------------------------------------


@_query(f"WITH r AS (SELECT citation_id, {Q.clean('raw')} AS c, coalesce(doi, '') AS d FROM citations) SELECT citation_id, {Q.starts('c')} AS begins, {Q.fragment('c')} AS goes_on, {Q.has_bibliographic_year('c')} AS has_year, length(c) >= 25 AND ({Q.year('c')} IS NOT NULL OR regexp_matches(c, {Q.quoted(P.DOI)}) OR regexp_matches(c, {Q.quoted(P.NO_DATE)})) AS is_reference, regexp_matches(c, {Q.quoted(P.PUBLISHER)}) AS noise, regexp_matches(c, '[\\x{{3400}}-\\x{{9fff}}]') OR regexp_matches(c, '(?i)\\b(?:thesis|dissertation|report|white\\s+paper|working\\s+paper|cnki|cctv)\\b') OR (regexp_matches(c, '(?i)https?://') AND d = '') AS gap FROM r")
def entry_predicates(spark, d):
    rows = _t(spark, d, "citations").select("citation_id", X.clean_text(F.col("raw")).alias("c"), F.coalesce("doi", F.lit("")).alias("d"))
    c = F.col("c")
    return rows.select("citation_id", P.is_start(c).alias("begins"), P.is_fragment(c).alias("goes_on"), P.has_bibliographic_year(c).alias("has_year"), P.looks_like_reference(c).alias("is_reference"), P.is_publisher_noise(c).alias("noise"), P.is_coverage_gap(c, F.col("d")).alias("gap"))


@_query(f"SELECT citation_id, coalesce(list_has_any(parse_flags, {list(P.FATAL)}), false) AS fatal FROM citations")
def fatal_flags(spark, d):
    return _t(spark, d, "citations").select("citation_id", P.has_fatal_flag(F.col("parse_flags")).alias("fatal"))


# Lines, sections, entries -----------------------------------------------------------------------------------------

_LINES = f"lines AS (SELECT doc_id, unnest(l) AS raw_line, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, string_split(regexp_replace({Q.resolve('text')}, '\\r\\n?', chr(10), 'g'), chr(10)) AS l FROM documents WHERE text IS NOT NULL)), cl AS (SELECT doc_id, pos, {Q.collapse('raw_line')} AS line FROM lines)"
_AT = "coalesce(nullif(length(regexp_extract(line, '(?s)^(.*?)' || {p}, 1)), 0), CASE WHEN regexp_matches(line, '^' || {p}) THEN 0 END)"


def _before(pattern: str) -> str:
    """What stands before an end inside the line; the letter before it, which the pattern takes in, is kept."""
    lead, rest = r"(?:^|[^\p{L}\p{N}_])", pattern.removeprefix(r"(?i)(?:^|[^\p{L}\p{N}_])")
    return f"trim(regexp_replace(line, {Q.quoted('(?is)(' + lead + ')' + rest + '.*$')}, '\\1'))"


_KEPT = f"CASE WHEN {Q.IS_END_HEADING.format('line')} THEN '' WHEN {_before(Q.END_INLINE[0])} <> line THEN {_before(Q.END_INLINE[0])} ELSE {_before(Q.END_INLINE[1])} END"
_SECTION = f"sec AS (SELECT doc_id, pos, head, CASE WHEN head IS NULL THEN line ELSE kept END AS line FROM (SELECT *, min(CASE WHEN pos > head AND kept <> line THEN pos END) OVER (PARTITION BY doc_id) AS stop FROM (SELECT *, min(CASE WHEN {Q.IS_HEADING.format('line')} THEN pos END) OVER (PARTITION BY doc_id) AS head, {_KEPT} AS kept FROM cl)) WHERE head IS NULL OR (pos > head AND (stop IS NULL OR pos <= stop)))"


def _sections(spark, d):
    return segment.with_section(_t(spark, d, "documents").where("text is not null").select("doc_id", "text"), "text")


@_query(f"WITH {_LINES}, {_SECTION} SELECT doc_id, count(*) FILTER (WHERE line <> '') AS n_lines, bool_or(head IS NOT NULL) AS has_heading, min(head) + 1 AS first_pos, md5(string_agg(line, '|' ORDER BY pos) FILTER (WHERE line <> '')) AS lines_md5 FROM sec GROUP BY doc_id")
def reference_sections(spark, d):
    full = F.filter("lines", lambda x: x != "")
    # sections without any line give no row; a filter would be pushed down and work everything out twice
    section = F.explode(F.filter(F.array(F.struct(full.alias("full"), (F.size("lines") > 0).alias("some"))), lambda x: x["some"])).alias("x")
    out = _sections(spark, d).select("doc_id", "has_heading", "first_pos", section)
    return out.select("doc_id", F.size("x.full").cast("bigint").alias("n_lines"), "has_heading", F.when(F.col("has_heading"), F.col("first_pos")).cast("bigint").alias("first_pos"), F.when(F.size("x.full") > 0, F.md5(F.array_join("x.full", "|"))).alias("lines_md5"))


_ENTRIES = f"marked AS (SELECT *, sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM (SELECT doc_id, pos, line, {Q.starts('line')} AS s, {Q.fragment('line')} AS f FROM sec WHERE line <> '')), ent AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS entry, raw, repaired, lost FROM (SELECT doc_id, g, string_agg(line, ' ' ORDER BY pos) AS raw, coalesce(bool_or(f AND n > 1), false) AS repaired, coalesce(bool_or(f AND n = 1), false) AS lost FROM marked GROUP BY doc_id, g))"


@_query(f"WITH {_LINES}, {_SECTION}, {_ENTRIES} SELECT doc_id, entry, raw, repaired, lost FROM ent")
def segment_entries(spark, d):
    """Entries before those merged in one are cut apart."""
    return segment.entries(_sections(spark, d), ["doc_id"]).withColumn("entry", F.col("entry").cast("bigint"))


@_query()
def reference_entries(spark, d):
    """The references of all documents, merged ones cut apart, with their flags. What may follow decides where one is cut, which SQL's patterns can't look at."""
    refs = segment.references(segment.entries(_sections(spark, d), ["doc_id"]), ["doc_id"])
    return refs.select("doc_id", "entry", "piece", "raw", F.array_join("flags", "|").alias("flags"))


@_query(f"WITH {_LINES}, {_SECTION}, {_ENTRIES} SELECT doc_id, entry, array_to_string({Q.flags('raw')}, '|') AS flags FROM ent")
def entry_flags(spark, d):
    return segment.entries(_sections(spark, d), ["doc_id"]).select("doc_id", F.col("entry").cast("bigint").alias("entry"), F.array_join(P.diagnose(F.col("raw")), "|").alias("flags"))


#: Lines of a page in the queries that need pages: documents are cut as a print-out would be, with the repository's key
#: above and the page's number below.
PAGE_LINES = 12
_PAGES = f"""pg AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page) AS n FROM (SELECT doc_id, (pos - 1) // {PAGE_LINES} + 1 AS page, (pos - 1) % {PAGE_LINES} + 1 AS i, line FROM cl
 UNION ALL SELECT c.doc_id, page, 0, coalesce(d.repository_key, '') FROM (SELECT DISTINCT doc_id, (pos - 1) // {PAGE_LINES} + 1 AS page FROM cl) c JOIN documents d USING (doc_id)
 UNION ALL SELECT DISTINCT doc_id, (pos - 1) // {PAGE_LINES} + 1 AS page, {PAGE_LINES} + 1, CAST((pos - 1) // {PAGE_LINES} + 1 AS VARCHAR) FROM cl)),
pgi AS (SELECT doc_id, page, line, n, row_number() OVER (PARTITION BY doc_id, page ORDER BY i) - 1 AS i FROM pg)"""


def _pages(spark, d):
    rows = _t(spark, d, "documents").where("text is not null").select("doc_id", F.coalesce("repository_key", F.lit("")).alias("top"), segment.lines_of(X.resolve(F.col("text"))).alias("all"))
    at = F.posexplode(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / PAGE_LINES)))
    rows = rows.select("doc_id", "top", "all", at.alias("p", "k"))
    body = F.slice("all", (F.col("k") * PAGE_LINES + 1).cast("int"), F.lit(PAGE_LINES))
    return rows.select("doc_id", (F.col("p") + 1).alias("page"), F.concat(F.array("top"), body, F.array((F.col("p") + 1).cast("string"))).alias("lines"))


_EDGE = "(i < 2 OR i >= n - 2)"
_BOUNDARY = f"bound AS (SELECT doc_id, lower(line) AS line_key, count(DISTINCT page) AS n_pages FROM pgi WHERE {_EDGE} AND line <> '' AND length(line) <= 100 AND {Q.year('line')} IS NULL AND NOT regexp_matches(line, {Q.quoted(P.DOI)}) AND NOT {Q.IS_HEADING.format('line')} AND NOT {Q.IS_END_HEADING.format('line')} GROUP BY doc_id, lower(line) HAVING count(DISTINCT page) >= 2)"


@_query(f"WITH {_LINES}, {_PAGES}, {_BOUNDARY} SELECT doc_id, line_key, n_pages FROM bound")
def repeated_boundary_lines(spark, d):
    return segment.boundary_lines(_pages(spark, d), "doc_id", "page", "lines")


@_query(f"WITH {_LINES}, {_PAGES}, {_BOUNDARY} SELECT pg.doc_id, page, count(*) FILTER (WHERE NOT ({_EDGE} AND b.line_key IS NOT NULL) AND NOT regexp_matches(line, '^\\s*[0-9]{{1,4}}\\s*$')) AS n_lines FROM pgi pg LEFT JOIN bound b ON pg.doc_id = b.doc_id AND lower(line) = b.line_key GROUP BY pg.doc_id, page")
def strip_boundaries(spark, d):
    return segment.strip_boundaries(_pages(spark, d), "doc_id", "page", "lines").select("doc_id", F.col("page").cast("bigint").alias("page"), F.size("lines").cast("bigint").alias("n_lines"))


_PAGE_SECTION = f"ps AS (SELECT doc_id, page, i, kept FROM (SELECT *, min(CASE WHEN (head IS NULL OR (page * 1000 + i) > head) AND kept <> line THEN page * 1000 + i END) OVER (PARTITION BY doc_id) AS stop FROM (SELECT *, min(CASE WHEN {Q.IS_HEADING.format('line')} THEN page * 1000 + i END) OVER (PARTITION BY doc_id) AS head, {_KEPT} AS kept FROM pgi WHERE line <> '')) WHERE (head IS NULL OR page * 1000 + i > head) AND (stop IS NULL OR page * 1000 + i <= stop) AND kept <> '' AND NOT {Q.IS_HEADING.format('kept')} AND NOT regexp_matches(kept, '^\\s*[0-9]{{1,4}}\\s*$'))"


@_query(f"WITH {_LINES}, {_PAGES}, {_PAGE_SECTION} SELECT doc_id, page, count(*) AS n_lines, md5(string_agg(kept, '|' ORDER BY i)) AS lines_md5 FROM ps GROUP BY doc_id, page")
def page_sections(spark, d):
    rows = segment.page_section(_pages(spark, d), "doc_id", "page", "lines").groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
    return rows.select("doc_id", F.col("page").cast("bigint").alias("page"), "n_lines", F.md5(F.array_join(F.transform("l", lambda x: x["line"]), "|")).alias("lines_md5"))


@_query(f"WITH {_LINES}, {_PAGES}, pp AS (SELECT doc_id, page, bool_or({Q.IS_HEADING.format('line')}) AS h FROM pgi GROUP BY doc_id, page) SELECT doc_id, page FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, bool_or(h) OVER (PARTITION BY doc_id) AS any_h, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS k FROM pp) WHERE any_h OR k >= floor(n * 0.67)")
def late_pages(spark, d):
    rows = _pages(spark, d).withColumn("h", F.exists("lines", P.is_heading))
    return segment.late_pages(rows, "doc_id", "page", F.col("h")).select("doc_id", F.col("page").cast("bigint").alias("page"))


@_query(f"WITH {_LINES} SELECT doc_id, doi, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_at) AS r FROM (SELECT doc_id, doi, count(*) AS n, min(place) AS first_at FROM (SELECT doc_id, lower(rtrim(x, {Q.quoted('.,;:)]}' + chr(34))})) AS doi, place FROM (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS place FROM (SELECT doc_id, regexp_extract_all(string_agg(line, chr(10) ORDER BY pos), {Q.quoted(P.DOI)}) AS l FROM cl WHERE pos <= {2 * PAGE_LINES} GROUP BY doc_id))) GROUP BY doc_id, doi)) WHERE r = 1")
def document_mode_doi(spark, d):
    """A document's own DOI: the most frequent of its first two pages, the one met first if several are. Counted in the row, nothing is shuffled."""
    rows = _t(spark, d, "documents").where("text is not null").select("doc_id", segment.lines_of(X.resolve(F.col("text"))).alias("all"))
    found = F.regexp_extract_all(F.array_join(F.slice("all", 1, 2 * PAGE_LINES), "\n"), F.lit("(" + X.DOI + ")"), F.lit(1))
    rows = rows.withColumn("all", F.transform(found, lambda x: F.lower(X.shut(x)))).where(F.size("all") > 0)
    counted = F.transform(F.array_distinct("all"), lambda x, i: F.struct(F.size(F.filter("all", lambda y: y == x)).alias("n"), (-i).alias("i"), x.alias("doi")))
    return rows.select("doc_id", F.array_max(counted).alias("b")).select("doc_id", "b.doi", F.col("b.n").cast("bigint").alias("n"))


@_query("SELECT source, median(n_chars) AS median_chars, count(n_chars) AS n FROM documents GROUP BY source")
def median_chars(spark, d):
    return _t(spark, d, "documents").groupBy("source").agg(F.median("n_chars").alias("median_chars"), F.count("n_chars").alias("n"))


@_query()
def hinted_entries(spark, d):
    """Entries over pages, begun where a line stands at the margin: here every line that begins one, or whose number in its page is divisible by five. Folded in order, so there is no SQL."""
    rows = segment.page_section(_pages(spark, d), "doc_id", "page", "lines").withColumn("hint", P.is_start(F.col("line")) | (F.col("pos") % 5 == 0))
    return segment.hinted_entries(rows, "doc_id").withColumn("flags", F.array_join("flags", "|"))


# Layout: lines of pages with places made of part, 16 a page, some with numbered margins ----------------------------

_LAY = """lay AS (SELECT p_partkey // 64 AS doc, (p_partkey % 64) // 16 AS page, CAST(p_partkey % 16 AS BIGINT) AS line_no,
 CASE WHEN (p_partkey // 16) % 3 = 0 THEN CASE WHEN p_partkey % 16 >= 11 THEN 10.0 ELSE 72.0 + (p_partkey % 2) * 5 END WHEN p_partkey % 16 IN (0, 15) THEN 60.0 WHEN p_partkey % 16 < 8 THEN 45.5 ELSE 306.7 + (p_partkey % 16 = 9)::INT * 12 END AS x0,
 CASE WHEN (p_partkey // 16) % 3 = 0 AND p_partkey % 16 >= 11 THEN 100.0 + (p_partkey % 16 - 11) * 14 WHEN (p_partkey // 16) % 3 = 0 THEN 100.0 + (p_partkey % 16) * 14 WHEN p_partkey % 16 = 0 THEN 60.0 WHEN p_partkey % 16 = 15 THEN 700.0 ELSE 100.0 + ((p_partkey - 1) % 7) * 14 END AS y0,
 CASE WHEN (p_partkey // 16) % 3 = 0 AND p_partkey % 16 >= 11 THEN CAST(p_partkey % 16 AS VARCHAR) ELSE p_name END AS text FROM part),
layout_lines AS (SELECT doc, page, line_no, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x0 + CASE WHEN length(text) <= 2 THEN 8 WHEN (line_no = 0 OR line_no = 15) AND x0 = 60.0 THEN 480 ELSE 230 END AS DOUBLE) AS x1, CAST(y0 + 10 AS DOUBLE) AS y1, text FROM lay)"""


def _layout(spark, d):
    k = F.col("p_partkey")
    n, single = k % 16, (F.floor(k / 16) % 3) == 0
    x0 = F.when(single, F.when(n >= 11, 10.0).otherwise(72.0 + (k % 2) * 5)).when(n.isin(0, 15), 60.0).when(n < 8, 45.5).otherwise(306.7 + F.when(n == 9, 12).otherwise(0))
    y0 = F.when(single & (n >= 11), 100.0 + (n - 11) * 14).when(single, 100.0 + n * 14).when(n == 0, 60.0).when(n == 15, 700.0).otherwise(100.0 + ((k - 1) % 7) * 14)
    rows = _t(spark, d, "part").select(F.floor(k / 64).alias("doc"), F.floor((k % 64) / 16).alias("page"), n.cast("bigint").alias("line_no"), x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), F.when(single & (n >= 11), n.cast("string")).otherwise(F.col("p_name")).alias("text"))
    wide = F.when(F.length("text") <= 2, 8).when(F.col("line_no").isin(0, 15) & (F.col("x0") == 60.0), 480).otherwise(230)
    return rows.select("doc", "page", "line_no", "x0", "y0", (F.col("x0") + wide).alias("x1"), (F.col("y0") + 10).alias("y1"), "text", F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"))


_SIDES = "sides AS (SELECT *, CASE WHEN regexp_matches(text, '^[0-9]{1,6}$') AND x1 <= 612 * 0.18 THEN 'left' WHEN regexp_matches(text, '^[0-9]{1,6}$') AND x0 >= 612 * 0.82 THEN 'right' END AS side FROM layout_lines), steps AS (SELECT *, CAST(text AS INT) - lag(CAST(text AS INT)) OVER w AS step, y0 - lag(y0) OVER w AS gap FROM sides WHERE side IS NOT NULL WINDOW w AS (PARTITION BY doc, page, side ORDER BY y0, line_no)), margins AS (SELECT doc, page, side FROM steps GROUP BY doc, page, side HAVING count(*) >= 4 AND avg(CASE WHEN step IS NOT NULL THEN CASE WHEN step BETWEEN 1 AND 10 THEN 1.0 ELSE 0.0 END END) >= 0.8 AND median(CASE WHEN gap > 0 THEN gap END) <= median(greatest(1.0, y1 - y0)) * 3.2 AND max(x0) - min(x0) <= 12)"


@_query(f"WITH {_LAY}, {_SIDES} SELECT doc, page, side FROM margins")
def layout_line_numbers(spark, d):
    return layout.numbered_margins(_layout(spark, d))


_COLS = "cols AS (SELECT *, count(*) FILTER (WHERE col = 'left') OVER (PARTITION BY doc, page) AS nl, count(*) FILTER (WHERE col = 'right') OVER (PARTITION BY doc, page) AS nr, count(*) FILTER (WHERE col = 'span') OVER (PARTITION BY doc, page) AS ns, min(CASE WHEN col <> 'span' THEN y0 END) OVER (PARTITION BY doc, page) AS top, max(CASE WHEN col <> 'span' THEN y1 END) OVER (PARTITION BY doc, page) AS bottom FROM (SELECT s.*, CASE WHEN x1 <= 314 AND x0 < 298 THEN 'left' WHEN x0 >= 298 THEN 'right' ELSE 'span' END AS col FROM sides s ANTI JOIN margins m ON s.doc = m.doc AND s.page = m.page AND s.side = m.side WHERE NOT (y0 >= 722 AND regexp_matches(text, '^[0-9]{1,4}$')) AND text <> '')), two AS (SELECT *, nl >= 4 AND nr >= 4 AND ns < greatest(nl, nr) AS tc FROM cols), placed AS (SELECT *, row_number() OVER (PARTITION BY doc, page ORDER BY CASE WHEN NOT tc THEN 0 WHEN col = 'left' THEN 1 WHEN col = 'right' THEN 3 WHEN y1 <= top + 4 THEN 0 WHEN y0 >= bottom - 4 THEN 4 ELSE 2 END, CASE WHEN tc THEN y0 ELSE round(y0, 1) END, x0, line_no) AS place FROM two)"


@_query(f"WITH {_LAY}, {_SIDES}, {_COLS} SELECT doc, page, place, line_no, text FROM placed")
def layout_order(spark, d):
    return layout.reading_order(_layout(spark, d)).select("doc", "page", F.col("place").cast("bigint").alias("place"), "line_no", "text")


@_query(f"WITH {_LAY}, {_SIDES}, {_COLS} SELECT doc, page, place, abs(x0 - m) <= 2.8 AS hint FROM (SELECT *, min(CASE WHEN length(text) >= 3 THEN round(x0, 1) END) OVER (PARTITION BY doc, page, x0 < 306) AS m FROM placed)")
def layout_hints(spark, d):
    return layout.with_start_hints(layout.reading_order(_layout(spark, d))).select("doc", "page", F.col("place").cast("bigint").alias("place"), "hint")


@_query(f"WITH {_LAY} SELECT doc, page, line_no FROM layout_lines WHERE NOT (x1 - x0 < 612 * 0.04 AND y1 - y0 > 792 * 0.45) AND NOT regexp_matches(text, {Q.quoted(P.PUBLISHER)})")
def layout_blocks(spark, d):
    return layout.kept_blocks(_layout(spark, d)).select("doc", "page", "line_no")


# Fields of references ---------------------------------------------------------------------------------------------

_BR, _BY = "(?i)" + fields.IN_BRACKETS, "(?i)" + fields.BARE_YEAR
_U = P.UPPER


def _half(pattern: str, after: bool, strip: str, x: str = "raw") -> str:
    body = pattern.removeprefix("(?i)")
    flag = "(?is)" if pattern.startswith("(?i)") else "(?s)"
    group = body.count("(") - body.count("(?") - body.count("\\(") + 2
    return f"trim(regexp_extract({x}, {Q.quoted(flag + '^(.*?)' + body + '(.*)$')}, {group if after else 1}), {Q.quoted(strip)})"


_LEFT = f"CASE WHEN regexp_matches(raw, {Q.quoted(_BR)}) THEN {_half(_BR, False, fields.BEFORE_YEAR)} WHEN regexp_matches(raw, {Q.quoted(_BY)}) THEN {_half(_BY, False, fields.BEFORE_YEAR)} WHEN regexp_matches(raw, {Q.quoted(P.NO_DATE)}) THEN {_half(P.NO_DATE, False, fields.BEFORE_YEAR)} ELSE split_part(raw, '.', 1) END"
_RIGHT = f"CASE WHEN regexp_matches(raw, {Q.quoted(_BR)}) THEN {_half(_BR, True, ' ')} WHEN regexp_matches(raw, {Q.quoted(_BY)}) THEN {_half(_BY, True, ' ')} WHEN regexp_matches(raw, {Q.quoted(P.NO_DATE)}) THEN {_half(P.NO_DATE, True, fields.AFTER_NO_DATE)} ELSE raw END"
_AROUND = Q.quoted(fields.AROUND)
_VHEAD = r"(?is)^(.*?)(?:,?\s+)(?:[0-9]+(?:\s*\([0-9]+\))?\s*(?::|,)|(?:vol\.?|volume)\s+[0-9]+)"


def _venue_head(x: str) -> str:
    t = f"trim({Q.collapse(x)}, {_AROUND})"
    return f"trim(CASE WHEN regexp_matches({t}, {Q.quoted(_VHEAD)}) THEN regexp_extract({t}, {Q.quoted(_VHEAD)}, 1) ELSE {t} END, {_AROUND})"


_REST = f"trim({Q.collapse('regexp_replace(CASE WHEN doi <> ' + Q.quoted('') + ' THEN regexp_replace(rt, ' + Q.quoted('(?i)(?:https?://(?:dx' + chr(92) + '.)?doi' + chr(92) + '.org/|doi' + chr(92) + 's*:' + chr(92) + 's*)?' + chr(92) + 'Q') + ' || doi || ' + Q.quoted(chr(92) + 'E') + ', ' + Q.quoted('') + ', ' + Q.quoted('g') + ') ELSE rt END, ' + Q.quoted('(?i)https?://.*$') + ', ' + Q.quoted('') + ')')}, {_AROUND})"
_QT, _AX = fields._QUOTED, fields._ARXIV
_STOPS = "list_filter(list_transform(string_split(regexp_replace(rest, " + Q.quoted(rf"\.\s+([{_U}])") + ", chr(1) || '\\1', 'g'), chr(1)), lambda x: trim(x, " + _AROUND + ")), lambda x: x <> '')"
_COMMAS = "list_filter(list_transform(string_split(rest, ','), lambda x: trim(x)), lambda x: x <> '')"
_TITLE = f"CASE WHEN rest = '' THEN '' WHEN regexp_matches(rest, {Q.quoted(_QT)}) THEN trim(regexp_extract(rest, {Q.quoted(_QT)}, 1), {Q.quoted(fields.AROUND + chr(34) + '“”')}) WHEN regexp_matches(rest, {Q.quoted(_AX)}) THEN trim(regexp_extract(rest, {Q.quoted(_AX)}, 1), {_AROUND}) WHEN len({_STOPS}) = 1 THEN coalesce({_COMMAS}[1], rest) ELSE coalesce({_STOPS}[1], '') END"
_VENUE = f"CASE WHEN rest = '' THEN '' WHEN regexp_matches(rest, {Q.quoted(_QT)}) THEN {_venue_head(f'regexp_extract(rest, {Q.quoted(_QT)}, 2)')} WHEN regexp_matches(rest, {Q.quoted(_AX)}) THEN {_venue_head(f'regexp_extract(rest, {Q.quoted(_AX)}, 2)')} WHEN len({_STOPS}) = 1 THEN array_to_string({_COMMAS}[2:3], ', ') ELSE coalesce({_STOPS}[2], '') END"
_NO_ETAL = "regexp_replace(lt, '(?i)\\bet\\s+al\\.?', '', 'g')"
_APA = Q.quoted(fields.FAMILY)
_AUTHORS = f"CASE WHEN len(regexp_extract_all({_NO_ETAL}, {_APA})) > 0 THEN list_transform(list_zip(regexp_extract_all({_NO_ETAL}, {_APA}, 1), regexp_extract_all({_NO_ETAL}, {_APA}, 2)), lambda z: {Q.collapse('z[1] || ' + Q.quoted(', ') + ' || z[2]')}) ELSE list_filter(list_transform(string_split_regex({_NO_ETAL}, {Q.quoted(fields.BETWEEN)}), lambda x: {Q.collapse('trim(x, ' + Q.quoted(' ,.;') + ')')}), lambda x: x <> '') END"
_KIND = f"CASE WHEN regexp_matches(raw, {Q.quoted(fields.KINDS[0][1])}) THEN 'book_thesis' WHEN doi <> '' OR regexp_matches(raw, {Q.quoted(fields.KINDS[1][1])}) THEN 'scholarly' WHEN url <> '' OR regexp_matches(raw, {Q.quoted(fields.KINDS[2][1])}) THEN 'web_policy' ELSE 'unknown' END"
_JOINED = r"regexp_replace(regexp_replace(f, '([\p{L}\p{N}_])-\s+([\p{L}\p{N}_])', '\1\2', 'g'), '([\p{L}\p{N}_])-\s+([\p{L}\p{N}_])', '\1\2', 'g')"
_STRIPPED = f"regexp_replace(coalesce(raw, {Q.quoted('')}), {Q.quoted(P.NUMBERED)}, {Q.quoted('')})"
_PARSED = f"""a0 AS (SELECT citation_id, {Q.clean(_STRIPPED)} AS c FROM citations),
a1 AS (SELECT citation_id, {Q.repaired('c')} AS f FROM a0), a2 AS (SELECT citation_id, {_JOINED} AS raw FROM a1),
a3 AS (SELECT *, {Q.doi('raw')} AS doi, {Q.url('raw')} AS url, CAST(coalesce(nullif(regexp_extract(raw, {Q.quoted(_BR)}, 1), ''), nullif(regexp_extract(raw, {Q.quoted(_BY)}, 1), '')) AS INTEGER) AS year, {_LEFT} AS lt, {_RIGHT} AS rt FROM a2),
a4 AS (SELECT *, year IS NOT NULL AND lt <> '' AND NOT regexp_matches(lt, {Q.quoted(rf',\s*[{_U}](?:\.|$)')}) AND NOT regexp_matches(raw, {Q.quoted(P.BODY)}) AS by_title, {_REST} AS rest FROM a3),
a5 AS (SELECT *, {_TITLE} AS t1, {_VENUE} AS v1 FROM a4),
a6 AS (SELECT citation_id, raw, doi, url, year, CASE WHEN by_title THEN [] ELSE ({_AUTHORS})[1:12] END AS authors, CASE WHEN by_title THEN trim(lt, ' .') ELSE t1 END AS title, CASE WHEN by_title THEN coalesce(nullif(t1, ''), v1) ELSE v1 END AS venue, {_KIND} AS kind, {Q.flags('raw')} AS flags FROM a5),
parsed AS (SELECT *, CASE WHEN len(list_filter(flags, lambda f: f IN {Q.FATAL})) > 0 THEN 0.0 ELSE round(greatest(0.0, 1 - (CASE WHEN length(title) < 8 THEN 0.35 ELSE 0 END + CASE WHEN kind = 'scholarly' AND len(authors) = 0 THEN 0.18 ELSE 0 END + CASE WHEN kind = 'scholarly' AND year IS NULL THEN 0.12 ELSE 0 END + CASE WHEN kind = 'unknown' AND doi = '' AND url = '' THEN 0.18 ELSE 0 END + CASE WHEN list_contains(flags, 'MULTIPLE_URLS') THEN 0.30 ELSE 0 END + CASE WHEN length(raw) > 1200 THEN 0.35 WHEN length(raw) > 700 THEN 0.18 ELSE 0 END)), 4) END AS confidence FROM a6)"""


def _parsed(spark, d):
    return fields.parse_citations(_t(spark, d, "citations").select("citation_id", "raw"), "raw")


@_query(f"WITH {_PARSED} SELECT citation_id, raw AS raw_citation, doi, url, year FROM parsed")
def parse_identifiers(spark, d):
    return _parsed(spark, d).select("citation_id", "raw_citation", "doi", "url", "year")


@_query(f"WITH {_PARSED} SELECT citation_id, lt AS before_year, rt AS after_year FROM a3")
def year_split(spark, d):
    rows = _parsed(spark, d).select("citation_id", "raw_citation")
    left, right = fields.split_at_year(F.col("raw_citation"))
    return rows.select("citation_id", left.alias("before_year"), right.alias("after_year"))


@_query(f"WITH {_PARSED} SELECT citation_id, array_to_string(authors, '|') AS authors FROM parsed")
def parse_author_lists(spark, d):
    return _parsed(spark, d).select("citation_id", F.array_join("authors", "|").alias("authors"))


@_query(f"WITH {_PARSED} SELECT citation_id, title, venue FROM parsed")
def parse_title_venue(spark, d):
    return _parsed(spark, d).select("citation_id", "title", "venue")


@_query(f"WITH {_PARSED} SELECT kind AS citation_type, count(*) AS n FROM parsed GROUP BY kind")
def citation_types(spark, d):
    return _parsed(spark, d).groupBy("citation_type").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_PARSED} SELECT citation_id, CAST(confidence AS DOUBLE) AS parse_confidence, array_to_string(flags, '|') AS parse_flags FROM parsed")
def parse_confidence(spark, d):
    return _parsed(spark, d).select("citation_id", F.col("parse_confidence").cast("double").alias("parse_confidence"), F.array_join("parse_flags", "|").alias("parse_flags"))


@_query()
def document_citations(spark, d):
    """From text to fields: the references of every document, parsed, against its own DOI."""
    docs = _t(spark, d, "documents").where("text is not null").select("doc_id", "text")
    rows = files.citations_of(docs, "doc_id", "text")
    return rows.select("doc_id", "ordinal", "title", F.array_join("authors", "|").alias("authors"), "year", "venue", "doi", "citation_type", "parse_confidence")


# Look-up, scores, decisions ---------------------------------------------------------------------------------------


def _side(table: str, key: str, p: str, extra: str) -> str:
    return f"SELECT {key}, {extra}, CASE WHEN coalesce(title, '') <> '' THEN {Q.normal('title')} END AS {p}_title, CASE WHEN coalesce(venue, '') <> '' THEN {Q.normal('venue')} END AS {p}_venue, {_NAMES} AS {p}_names, year AS {p}_year, {Q.doi(Q.clean('doi'))} AS {p}_doi FROM {table}"


_ROUTE = "CASE citation_type WHEN 'web_policy' THEN ['web'] WHEN 'scholarly' THEN ['crossref', 'openalex', 'pubmed'] ELSE CASE WHEN coalesce(url, '') <> '' THEN ['crossref', 'openalex', 'web'] ELSE ['crossref', 'openalex'] END END"
_C = "c AS MATERIALIZED (" + _side("citations", "citation_id", "c", f"coalesce(raw, '') AS raw, {Q.normal('raw')} AS raw_norm, coalesce(url, '') AS url, coalesce(citation_type, 'unknown') AS citation_type, coalesce(parse_confidence, 0) AS parse_confidence, coalesce(parse_flags, []) AS parse_flags, {_ROUTE} AS route") + ")"
_P = "p AS MATERIALIZED (" + _side("provider_candidates", "candidate_id", "p", "provider") + ")"
_BEST = f"list_transform(c_names, lambda e: list_max(list_transform(p_names, lambda a: {Q.similarity('e', 'a')})))"
_SCORED = f"""s0 AS (SELECT *, CASE WHEN c_title IS NULL OR p_title IS NULL THEN NULL ELSE {Q.similarity('c_title', 'p_title')} END AS title_score,
 CASE WHEN len(c_names) > 0 AND len(p_names) > 0 THEN {_BEST} END AS best,
 CAST(CASE WHEN c_year IS NULL OR p_year IS NULL THEN NULL WHEN c_year = p_year THEN 1.0 WHEN abs(c_year - p_year) = 1 THEN 0.55 ELSE 0.0 END AS DOUBLE) AS year_score,
 CASE WHEN c_venue IS NULL OR p_venue IS NULL THEN NULL ELSE {Q.similarity('c_venue', 'p_venue')} END AS venue_score, CASE WHEN c_doi <> '' THEN c_doi = p_doi END AS doi_exact FROM pairs),
s1 AS (SELECT *, CASE WHEN best IS NOT NULL THEN least(1.0, 0.6 * best[1] + 0.4 * (list_sum(best) / len(best))) END AS author_score FROM s0),
s2 AS (SELECT *, CASE WHEN doi_exact AND (coalesce(title_score < 0.72, false) OR coalesce(author_score < 0.45, false)) THEN 'DOI_METADATA_MISMATCH' WHEN doi_exact THEN 'DOI_EXACT_MATCH' WHEN NOT doi_exact AND p_doi <> '' THEN 'DOI_MISMATCH' END AS match_reason,
 coalesce(title_score, 0) * 0.65 + coalesce(author_score, 0) * 0.2 + coalesce(year_score, 0) * 0.1 + coalesce(venue_score, 0) * 0.05 AS sum_ FROM s1),
scored AS (SELECT *, round(CASE match_reason WHEN 'DOI_METADATA_MISMATCH' THEN least(sum_, 0.7) WHEN 'DOI_EXACT_MATCH' THEN greatest(sum_, 0.95) WHEN 'DOI_MISMATCH' THEN least(sum_, 0.75) ELSE sum_ END, 6) AS overall, list_position(route, provider) - 1 AS provider_rank FROM s2)"""
_DOI_PAIRS = "pairs AS (SELECT * FROM c JOIN p ON c_doi = p_doi WHERE c_doi <> '')"
_SEARCH = """ct AS (SELECT DISTINCT c_title AS t, list_distinct(string_split(c_title, ' ')) AS w FROM c WHERE coalesce(c_title, '') <> ''), pt AS (SELECT DISTINCT p_title AS t, list_distinct(string_split(p_title, ' ')) AS w FROM p WHERE coalesce(p_title, '') <> ''),
shared AS (SELECT a.t AS ct, b.t AS pt, a.n AS n, b.n AS m, count(*) AS k FROM (SELECT t, len(w) AS n, unnest(w) AS x FROM ct) a JOIN (SELECT t, len(w) AS n, unnest(w) AS x FROM pt) b USING (x) GROUP BY ALL),
alike AS (SELECT ct, pt, round(k / CAST(n + m - k AS DOUBLE), 6) AS jaccard FROM shared WHERE round(k / CAST(n + m - k AS DOUBLE), 6) >= 0.5),
search AS (SELECT * FROM (SELECT citation_id, provider, candidate_id, jaccard, row_number() OVER (PARTITION BY citation_id, provider ORDER BY jaccard DESC, candidate_id) AS place FROM c JOIN alike ON c_title = ct JOIN p ON p_title = pt) WHERE place <= 5)"""


def _compared(spark, d):
    return A.compared(_t(spark, d, "citations"), _t(spark, d, "provider_candidates"))


@_query(f"WITH c AS (SELECT citation_id, {Q.doi(Q.clean('doi'))} AS k FROM citations), p AS (SELECT candidate_id, {Q.doi(Q.clean('doi'))} AS k FROM provider_candidates) SELECT citation_id, count(*) AS n_candidates FROM c JOIN p USING (k) WHERE k <> '' GROUP BY citation_id")
def doi_equijoin(spark, d):
    key = lambda name, i: _t(spark, d, name).select(i, X.normalize_doi(F.col("doi")).alias("k")).where("k <> ''")
    return key("citations", "citation_id").join(key("provider_candidates", "candidate_id"), "k").groupBy("citation_id").agg(F.count(F.lit(1)).alias("n_candidates"))


@_query(f"SELECT citation_id, array_to_string({_ROUTE}, '|') AS route FROM citations")
def route_providers(spark, d):
    return scoring.with_route(_t(spark, d, "citations")).select("citation_id", F.array_join("route", "|").alias("route"))


@_query(f"WITH {_C}, {_P}, {_DOI_PAIRS}, {_SCORED} SELECT citation_id, candidate_id, round(title_score, 6) AS title_score, round(author_score, 6) AS author_score, year_score, round(venue_score, 6) AS venue_score, doi_exact, match_reason, overall FROM scored")
def score_components(spark, d):
    """Scores of all pairs with one DOI, in any script."""
    c, p = _compared(spark, d)
    rows = scoring.score_pairs(scoring.doi_pairs(c, p))
    return rows.select("citation_id", "candidate_id", *(F.round(f"{k}_score", 6).alias(f"{k}_score") for k in ("title", "author")), "year_score", F.round("venue_score", 6).alias("venue_score"), "doi_exact", "match_reason", "overall")


@_query(f"WITH {_C}, {_P}, {_SEARCH} SELECT citation_id, provider, candidate_id, jaccard, place FROM search")
def title_search(spark, d):
    c, p = _compared(spark, d)
    return scoring.title_search(c, p, "citation_id", "candidate_id", ["provider"]).withColumn("place", F.col("place").cast("bigint"))


_RANKED = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY citation_id ORDER BY CASE WHEN early THEN provider_rank ELSE 0 END, overall DESC, provider_rank, candidate_id) AS r FROM (SELECT *, max(CASE WHEN provider_rank = 0 THEN overall END) OVER (PARTITION BY citation_id) >= 0.85 AS early FROM scored WHERE provider_rank IS NOT NULL AND provider_rank >= 0)) WHERE r = 1)"


@_query(f"WITH {_C}, {_P}, {_DOI_PAIRS}, {_SCORED}, {_RANKED} SELECT citation_id, candidate_id, provider, overall, coalesce(early, false) AS early FROM best")
def best_evidence(spark, d):
    """The best record with a citation's DOI among the providers asked; the first one asked decides alone if it is sure."""
    c, p = _compared(spark, d)
    pairs = scoring.doi_pairs(c, p).where(F.array_contains("route", F.col("provider")))
    return scoring.best_evidence(A.scored_pairs(c, p, pairs), "citation_id", ["provider"]).select("citation_id", "candidate_id", "provider", "overall", "early")


_FATAL = f"len(list_filter(parse_flags, lambda f: f IN {Q.FATAL})) > 0"
_LOOKUPS = "hit AS (SELECT citation_id, candidate_id, provider FROM c JOIN p ON c_doi = p_doi WHERE c_doi <> '' AND list_contains(route, provider)), look AS (SELECT citation_id, candidate_id FROM hit UNION ALL SELECT s.citation_id, s.candidate_id FROM search s JOIN c USING (citation_id) WHERE list_contains(route, s.provider) AND NOT EXISTS (SELECT 1 FROM hit WHERE hit.citation_id = s.citation_id AND hit.provider = s.provider)), pairs AS (SELECT c.*, p.* FROM look JOIN c USING (citation_id) JOIN p USING (candidate_id) WHERE NOT (" + _FATAL + "))"
_DOUBTFUL = "(c_doi = '' AND url = '' AND parse_confidence >= 0.85 AND citation_type IN ('scholarly', 'unknown'))"
_EXACT = "CASE WHEN coalesce(p_title, '') <> '' AND contains(raw_norm, p_title) THEN 'verified:DOI_EXACT_RAW_TITLE_CORROBORATED' WHEN title_score >= 0.72 AND (coalesce(author_score >= 0.55, false) OR coalesce(year_score >= 0.55, false)) THEN 'verified:VERIFIED_IDENTIFIER_AND_METADATA' WHEN parse_confidence >= 0.85 AND coalesce(title_score < 0.35, false)::INT + coalesce(author_score < 0.35, false)::INT + coalesce(year_score = 0, false)::INT >= 2 THEN 'metadata_mismatch:DOI_EXACT_METADATA_CONFLICT' WHEN title_score < 0.45 AND parse_confidence >= 0.85 THEN 'metadata_mismatch:DOI_EXACT_TITLE_CONFLICT' WHEN title_score IS NULL AND author_score >= 0.75 AND year_score >= 0.55 THEN 'verified:DOI_EXACT_AUTHOR_YEAR_CORROBORATED' ELSE 'identifier_verified_parse_uncertain:DOI_EXACT_PARSE_UNCERTAIN' END"
_PAGE_FITS = "(coalesce(title_score >= 0.6, false) OR (coalesce(c_title, '') <> '' AND coalesce(p_title, '') <> '' AND contains(p_title, c_title))) AND parse_confidence >= 0.7"
_MATCH = f"CASE WHEN provider = 'web_restricted' THEN 'web_access_restricted:WEB_SERVER_ACCESS_RESTRICTED' WHEN provider = 'web' AND {_PAGE_FITS} AND citation_type = 'book_thesis' THEN 'grey_literature_validated:OFFICIAL_URL_AND_TITLE_MATCH' WHEN provider = 'web' AND {_PAGE_FITS} THEN 'web_validated:WEB_URL_AND_TITLE_MATCH' WHEN provider = 'web' THEN 'web_reachable:URL_REACHABLE_METADATA_UNAVAILABLE' WHEN match_reason = 'DOI_MISMATCH' THEN 'metadata_mismatch:DOI_CONFLICT' WHEN doi_exact THEN {_EXACT} WHEN title_score IS NULL OR (title_score IS NOT NULL)::INT + (author_score IS NOT NULL)::INT + (year_score IS NOT NULL)::INT + (venue_score IS NOT NULL)::INT < 2 THEN 'review:INSUFFICIENT_METADATA' WHEN title_score >= 0.85 AND (coalesce(author_score >= 0.55, false) OR coalesce(year_score >= 0.55, false)) AND overall >= 0.85 THEN 'verified:VERIFIED_METADATA' WHEN overall >= 0.77 THEN 'review:BORDERLINE_MATCH' WHEN title_score < 0.45 AND author_score < 0.45 THEN 'review:WEAK_REGISTRY_CANDIDATE' ELSE 'review:SCORE_BELOW_THRESHOLD' END"
_GAP = "(regexp_matches(raw, '[\\x{3400}-\\x{9fff}]') OR regexp_matches(raw, '(?i)\\b(?:thesis|dissertation|report|white\\s+paper|working\\s+paper|cnki|cctv)\\b') OR (regexp_matches(raw, '(?i)https?://') AND c_doi = ''))"


@_query(f"WITH {_C}, {_P}, {_DOI_PAIRS}, {_SCORED} SELECT citation_id, candidate_id, split_part(x, ':', 1) AS status, split_part(x, ':', 2) AS reason FROM (SELECT *, {_EXACT} AS x FROM scored)")
def classify_exact_doi(spark, d):
    c, p = _compared(spark, d)
    return scoring.score_pairs(scoring.doi_pairs(c, p)).withColumn("x", decide.by_exact_doi()).select("citation_id", "candidate_id", "x.status", "x.reason")


@_query(f"WITH {_C}, {_P}, {_SEARCH}, pairs AS (SELECT c.*, p.* FROM search s JOIN c ON s.citation_id = c.citation_id JOIN p ON s.candidate_id = p.candidate_id), {_SCORED} SELECT citation_id, candidate_id, split_part(x, ':', 1) AS status, split_part(x, ':', 2) AS reason FROM (SELECT *, {_MATCH} AS x FROM scored)")
def classify_match(spark, d):
    c, p = _compared(spark, d)
    rows = scoring.title_search(c, p, "citation_id", "candidate_id", ["provider"])
    return A.scored_pairs(c, p, rows).withColumn("x", decide.by_match()).select("citation_id", "candidate_id", "x.status", "x.reason")


_NO_MATCH = f"CASE WHEN len(route) >= 2 AND {_DOUBTFUL} THEN 'potential_hallucination' ELSE 'not_found' END"
_NO_REASON = f"array_to_string(list_filter(['NO_REGISTRY_MATCH', CASE WHEN c_doi <> '' THEN 'DOI_NOT_FOUND' WHEN url <> '' THEN 'URL_NOT_VALIDATED' WHEN {_GAP} THEN 'COVERAGE_GAP' END, CASE WHEN {_NO_MATCH} = 'potential_hallucination' THEN 'MULTI_REGISTRY_NO_MATCH' END], lambda x: x IS NOT NULL), ' | ')"


@_query(f"WITH {_C} SELECT citation_id, {_NO_MATCH} AS status, {_NO_REASON} AS reasons FROM c")
def classify_no_match(spark, d):
    """What each citation would be told if no registry had anything."""
    c, _ = _compared(spark, d)
    rows = c.withColumns({"queried": F.size("route"), "n_providers": F.size("route"), "n_errors": F.lit(0)})
    return rows.select("citation_id", decide.no_match_status().alias("status"), F.array_join(decide.no_match_reasons(), " | ").alias("reasons"))


_DOUBT = f"CASE WHEN {_DOUBTFUL} AND coalesce(title_score < 0.45, true) AND coalesce(author_score < 0.45, true) THEN CASE WHEN {{0}} >= 2 THEN 'MULTI_REGISTRY_NO_MEANINGFUL_MATCH' WHEN {{0}} >= 1 AND len(route) >= 2 AND {{1}} >= 1 AND parse_confidence >= 0.9 THEN 'NO_MEANINGFUL_MATCH_PARTIAL_REGISTRY_OUTAGE' ELSE '' END ELSE '' END"
_OUTAGE = "candidate_id % 3 = 0"


@_query(f"WITH {_C}, {_P}, pairs AS (SELECT c.*, p.* FROM c JOIN p ON c_year = p_year AND p_names[1] = c_names[1]), {_SCORED} SELECT citation_id, candidate_id, CASE WHEN {_OUTAGE} THEN {_DOUBT.format('1', '1')} ELSE {_DOUBT.format('len(route)', '0')} END AS reason FROM scored")
def hallucination_escalation(spark, d):
    """Pairs of one year and first surname; every third record stands for a registry that was asked alone while another failed."""
    c, p = _compared(spark, d)
    pairs = c.withColumn("n", F.get("c_names", F.lit(0))).join(p.withColumn("n", F.get("p_names", F.lit(0))), ["n"]).where("c_year = p_year").select("citation_id", "candidate_id")
    failed = F.col("candidate_id") % 3 == 0
    rows = A.scored_pairs(c, p, pairs).withColumns({"queried": F.when(failed, 1).otherwise(F.size("route")), "n_providers": F.size("route"), "n_errors": F.when(failed, 1).otherwise(0)})
    return rows.select("citation_id", "candidate_id", decide.doubt_reason().alias("reason"))


_AUDIT = f"""WITH {_C}, {_P}, {_SEARCH}, {_LOOKUPS}, {_SCORED}, {_RANKED},
f0 AS (SELECT c.citation_id, c.raw, c.url, c.citation_type, c.parse_confidence, c.parse_flags, c.route, c.c_doi, c.c_title, c.raw_norm, b.candidate_id, b.provider, b.p_title, b.title_score, b.author_score, b.year_score, b.venue_score, b.doi_exact, b.match_reason, b.overall, CASE WHEN coalesce(b.early, false) THEN 1 ELSE len(c.route) END AS queried FROM c LEFT JOIN best b ON c.citation_id = b.citation_id),
f1 AS (SELECT *, {_FATAL} AS fatal, {_DOUBT.format('queried', '0')} AS doubt, {_MATCH} AS m FROM f0),
f2 AS (SELECT *, CASE WHEN fatal THEN 'parse_error' WHEN provider IS NULL THEN {_NO_MATCH} WHEN doubt <> '' THEN 'potential_hallucination' ELSE split_part(m, ':', 1) END AS status FROM f1),
f3 AS (SELECT *, NOT fatal AND provider IS NOT NULL AND status = 'verified' AND coalesce(doi_exact, false) AS lifted FROM f2)
SELECT citation_id, status, CASE WHEN fatal THEN array_to_string(list_filter(parse_flags, lambda f: NOT regexp_matches(f, '_REPAIRED$')), ' | ') WHEN provider IS NULL THEN {_NO_REASON} ELSE array_to_string(list_filter([CASE WHEN NOT (lifted AND coalesce(match_reason = 'DOI_METADATA_MISMATCH', false)) THEN match_reason END, CASE WHEN doubt <> '' THEN doubt ELSE split_part(m, ':', 2) END], lambda x: x IS NOT NULL), ' | ') END AS reasons,
round(CASE WHEN fatal OR provider IS NULL THEN 0.0 WHEN lifted THEN greatest(overall, 0.95) ELSE overall END, 6) AS score, candidate_id, provider, round(title_score, 6) AS title_score, round(author_score, 6) AS author_score, round(year_score, 6) AS year_score, round(venue_score, 6) AS venue_score, doi_exact FROM f3"""


@_query(_AUDIT)
def audit(spark, d):
    """The whole audit of all citations against all records."""
    return A.audit(_t(spark, d, "citations"), _t(spark, d, "provider_candidates"))


# Summaries and measures -------------------------------------------------------------------------------------------

_VR = "verification_results"
_COUNTS = ", ".join(f"count(*) FILTER (WHERE status = '{s}') AS {s}" for s in metrics.STATUSES)


@_query(f"SELECT *, total - auto_confirmed AS needs_action, round(coalesce(auto_confirmed / nullif(total, 0)::DOUBLE, 0), 4) AS verified_rate FROM (SELECT count(*) AS total, count(*) FILTER (WHERE {Q.ACCEPTED}) AS auto_confirmed, {_COUNTS} FROM {_VR})")
def summary_counts(spark, d):
    return metrics.summarize(_t(spark, d, _VR))


@_query(f"SELECT count(*) AS total, count(*) FILTER (WHERE {Q.ACCEPTED}) AS confirmed, count(*) FILTER (WHERE NOT ({Q.ACCEPTED})) AS review, count(*) FILTER (WHERE status IN ('metadata_mismatch', 'potential_hallucination')) AS conflict, count(*) FILTER (WHERE status IN ('parse_error', 'error')) AS technical FROM {_VR}")
def overview_metrics(spark, d):
    return metrics.overview(_t(spark, d, _VR))


@_query("SELECT status_group, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN status IN {m} THEN '{g}'" for g, m in metrics.GROUPS.items()) + f" END AS status_group FROM {_VR}) GROUP BY status_group")
def status_groups(spark, d):
    return _t(spark, d, _VR).groupBy(metrics.status_group(F.col("status")).alias("status_group")).agg(F.count(F.lit(1)).alias("n"))


_TRUTH = "CASE WHEN reviewer_decision IN ('accept_valid', 'override_valid') THEN true WHEN reviewer_decision = 'confirm_flag' THEN false END"
_JUDGED = f"judged AS (SELECT label, status, mutation_type FROM (SELECT row_id, {Q.LABEL} AS label, mutation_type FROM benchmark_records) b JOIN (SELECT citation_id, arg_max(status, checked_at::VARCHAR || lpad(CAST(1000000000 - result_id AS VARCHAR), 12, '0')) AS status FROM {_VR} GROUP BY citation_id) v ON b.row_id = v.citation_id)"


def _judged(spark, d):
    """Gold rows with the latest status of the result of the same number: the tables share no gold key, so the pairing is by place, as in a benchmark file."""
    gold = _t(spark, d, "benchmark_records").select(F.col("row_id").alias("citation_id"), metrics.gold_label(F.col("label")).alias("label"), "mutation_type", "record_id", "target_class", "human_validation_status", "benchmark_split")
    return gold.join(latest_result(spark, d).select("citation_id", "status"), "citation_id")


@_query(f"SELECT citation_id, arg_max(result_id, checked_at::VARCHAR || lpad(CAST(1000000000 - result_id AS VARCHAR), 12, '0')) AS result_id, arg_max(status, checked_at::VARCHAR || lpad(CAST(1000000000 - result_id AS VARCHAR), 12, '0')) AS status FROM {_VR} GROUP BY citation_id")
def latest_result(spark, d):
    """The latest check of each citation, the first of those of one time."""
    rows = _t(spark, d, _VR).select("citation_id", "result_id", "status", "checked_at")
    return scoring.first_per(rows, "citation_id", F.struct("checked_at", (-F.col("result_id")).alias("r")), ["result_id", "status"])


_MEASURES = """m0 AS (SELECT count(*) AS n, count(*) FILTER (WHERE label = 'valid') AS v, count(*) FILTER (WHERE label = 'valid' AND a AND NOT e) AS tp, count(*) FILTER (WHERE label <> 'valid' AND a AND NOT e) AS fp, count(*) FILTER (WHERE label <> 'valid' AND NOT a AND NOT e) AS tn, count(*) FILTER (WHERE label = 'valid' AND NOT a AND NOT e) AS fn, count(*) FILTER (WHERE e) AS ex FROM (SELECT label, """ + Q.ACCEPTED + """ AS a, status = 'error' AS e FROM judged)),
m1 AS (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS r, coalesce(tn / nullif(tn + fn, 0)::DOUBLE, 0) AS gp, coalesce(tn / nullif(tn + fp, 0)::DOUBLE, 0) AS gr FROM m0)"""


@_query(f"WITH {_JUDGED}, {_MEASURES} SELECT n AS dataset_total, v AS dataset_valid, tp AS tp_valid, fp AS fp_invalid_accepted, tn AS tn_invalid_flagged, fn AS fn_valid_flagged, ex AS excluded_errors, n - v AS dataset_invalid, round(p, 6) AS precision_valid, round(r, 6) AS recall_valid, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1_valid, round(gp, 6) AS precision_ghost_detection, round(gr, 6) AS recall_ghost_detection, round(coalesce(2 * gp * gr / nullif(gp + gr, 0), 0), 6) AS f1_ghost_detection, round(coalesce((n - v) / nullif(n, 0)::DOUBLE, 0), 6) AS invalid_prevalence, round(coalesce(tn / nullif(n - ex, 0)::DOUBLE, 0), 6) AS hallucination_rate, round(coalesce(tn / nullif(n - ex, 0)::DOUBLE, 0), 6) AS correctly_flagged_invalid_share FROM m1")
def quality_metrics(spark, d):
    return metrics.quality(_judged(spark, d))


@_query(f"WITH {_JUDGED} SELECT label, status, count(*) AS n FROM judged GROUP BY label, status")
def status_by_truth(spark, d):
    return metrics.status_by_truth(_judged(spark, d))


@_query(f"WITH {_JUDGED} SELECT mutation_type, total, auto_accepted, needs_review, errors, round(coalesce(auto_accepted / nullif(total - errors, 0)::DOUBLE, 0), 6) AS auto_accept_rate, round(coalesce(needs_review / nullif(total - errors, 0)::DOUBLE, 0), 6) AS review_rate FROM (SELECT coalesce(nullif(trim(mutation_type), ''), CASE WHEN label = 'valid' THEN 'none' ELSE 'unspecified' END) AS mutation_type, count(*) AS total, count(*) FILTER (WHERE {Q.ACCEPTED} AND status <> 'error') AS auto_accepted, count(*) FILTER (WHERE NOT ({Q.ACCEPTED}) AND status <> 'error') AS needs_review, count(*) FILTER (WHERE status = 'error') AS errors FROM judged GROUP BY 1)")
def mutation_rates(spark, d):
    return metrics.by_mutation(_judged(spark, d))


_CC = "count(*) FILTER (WHERE {}) AS {}"


@_query("SELECT provider, tp, fp, tn, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM (SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS r FROM (SELECT provider, " + ", ".join((_CC.format("t AND a", "tp"), _CC.format("NOT t AND a", "fp"), _CC.format("NOT t AND NOT a", "tn"), _CC.format("t AND NOT a", "fn"))) + f" FROM (SELECT provider, {_TRUTH} AS t, coalesce({Q.ACCEPTED}, false) AS a FROM {_VR}) WHERE t IS NOT NULL GROUP BY provider))")
def confusion_metrics(spark, d):
    rows = _t(spark, d, _VR).select("provider", "status", "reviewer_decision")
    return metrics.confusion(rows, F.expr(_TRUTH), P.is_accepted(F.col("status")), ["provider"])


@_query(f"SELECT row_id, trim(citation) AS citation, {Q.LABEL} AS label, trim(coalesce(record_id, '')) AS record_id, trim(coalesce(target_class, '')) AS target_class, trim(coalesce(mutation_type, '')) AS mutation_type, trim(coalesce(human_validation_status, '')) AS human_validation_status, trim(coalesce(benchmark_split, '')) AS benchmark_split FROM benchmark_records WHERE {Q.LABEL} IS NOT NULL AND trim(coalesce(citation, '')) <> ''")
def gold_records(spark, d):
    rows = _t(spark, d, "benchmark_records").where(metrics.gold_label(F.col("label")).isNotNull() & (F.trim(F.coalesce("citation", F.lit(""))) != ""))
    return files.gold_records(rows)


# Review and replay ------------------------------------------------------------------------------------------------

_SEARCHED = ("parsed_title", "parsed_doi", "reasons", "status")


@_query("SELECT result_id, status FROM verification_results WHERE contains(lower(concat_ws(' ', coalesce(parsed_title, ''), coalesce(parsed_doi, ''), coalesce(reasons, ''), coalesce(status, ''))), 'province') AND citation_type = 'scholarly' AND status IN ('verified', 'review')")
def result_search(spark, d):
    rows = review.search(_t(spark, d, _VR), "Province", ["verified", "review"], "scholarly", _SEARCHED)
    return rows.select("result_id", "status")


@_query("SELECT status, count(*) AS n FROM verification_results WHERE contains(lower(concat_ws(' ', coalesce(parsed_title, ''), coalesce(parsed_doi, ''), coalesce(reasons, ''), coalesce(status, ''))), 'doi_exact') GROUP BY status")
def reason_search(spark, d):
    return review.search(_t(spark, d, _VR), " DOI_EXACT ", None, "All", _SEARCHED).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT DISTINCT 'status' AS field, status AS value FROM verification_results UNION ALL SELECT DISTINCT 'citation_type', citation_type FROM verification_results")
def filter_options(spark, d):
    rows = _t(spark, d, _VR)
    one = lambda c: review.options(rows, c).select(F.lit(c).alias("field"), F.col(c).alias("value"))
    return one("status").unionByName(one("citation_type"))


@_query("SELECT result_id, CASE WHEN result_id % 7 = 0 THEN 'confirm_flag' ELSE reviewer_decision END AS reviewer_decision, CASE WHEN result_id % 14 = 0 THEN 'seen ' || result_id WHEN result_id % 7 = 0 THEN '' ELSE reviewer_note END AS reviewer_note FROM verification_results")
def review_merge(spark, d):
    """Edits to every seventh result, half of them without a note."""
    rows = _t(spark, d, _VR).select("result_id", "reviewer_decision", "reviewer_note")
    edits = rows.where("result_id % 7 = 0").select("result_id", F.lit("confirm_flag").alias("reviewer_decision"), F.when(F.col("result_id") % 14 == 0, F.concat(F.lit("seen "), F.col("result_id").cast("string"))).alias("reviewer_note"))
    return review.apply_edits(rows, edits, "result_id")


@_query(f"WITH v AS (SELECT citation_id, arg_max(result_id, checked_at::VARCHAR || lpad(CAST(1000000000 - result_id AS VARCHAR), 12, '0')) AS result_id FROM {_VR} GROUP BY citation_id) SELECT b.row_id AS ordinal, b.record_id, {Q.LABEL} AS label, status, coalesce({Q.ACCEPTED}, false) AS auto_accepted, coalesce({Q.ACCEPTED}, false) = ({Q.LABEL} = 'valid') AS correct_binary_decision, score, parsed_title, parsed_doi, title_score, reasons FROM benchmark_records b JOIN v ON b.row_id = v.citation_id JOIN {_VR} r USING (result_id)")
def predictions_export(spark, d):
    gold = _t(spark, d, "benchmark_records").withColumn("label", metrics.gold_label(F.col("label"))).withColumnRenamed("row_id", "ordinal")
    last = latest_result(spark, d).select("result_id")
    results = _t(spark, d, _VR).join(last, "result_id", "left_semi").drop("ordinal").withColumnRenamed("citation_id", "ordinal")
    rows = review.predictions(gold, results)
    return rows.select("ordinal", "record_id", "label", "status", "auto_accepted", "correct_binary_decision", "score", "parsed_title", "parsed_doi", "title_score", "reasons")


def _saved(spark, d):
    """Saved flat rows made of results, each with the best record that has its DOI; results without one have no match."""
    rows = _t(spark, d, _VR)
    held = _t(spark, d, "provider_candidates").withColumn("k", X.normalize_doi(F.col("doi"))).where("k <> ''")
    first = held.groupBy("k").agg(F.min_by(F.struct("title", "authors", "year", "venue", "doi", "url"), "candidate_id").alias("m"))
    out = rows.withColumn("k", F.nullif(X.normalize_doi(F.col("parsed_doi")), F.lit(""))).join(first, "k", "left").join(_t(spark, d, "citations").select("citation_id", F.col("raw").alias("raw_citation"), F.col("venue").alias("v")), "citation_id", "left")
    matched = {"matched_title": "m.title", "matched_year": "m.year", "matched_venue": "m.venue", "matched_doi": "m.doi", "matched_url": "m.url"}
    made = {k: F.col(v) for k, v in matched.items()} | {"matched_authors": F.array_join("m.authors", "; "), "parsed_url": F.lit(""), "venue_score": F.lit(None).cast("double"), "source_page": F.lit(None).cast("int"), "source_end_page": F.lit(None).cast("int")}
    return out.withColumns(made).drop("m", "k", "v")


def _joined_names(c: str) -> str:
    return f"list_filter(list_transform(list_transform(list_filter(list_transform(string_split(coalesce({c}, ''), ';'), lambda x: {Q.collapse('x')}), lambda x: x <> ''), lambda a: {Q.clean('a')}), lambda a: {Q.surname('a')}), lambda s: s <> '')"


_REPLAY = f"""WITH first AS (SELECT k, arg_min(candidate_id, candidate_id) AS candidate_id FROM (SELECT candidate_id, {Q.doi(Q.clean('doi'))} AS k FROM provider_candidates) WHERE k <> '' GROUP BY k),
pairs AS (SELECT v.result_id AS citation_id, v.result_id, v.status, v.score, v.doi_exact AS saved_exact, coalesce(v.provider, '') AS saved_provider, coalesce(v.parse_confidence, 0) AS parse_confidence, v.title_score AS saved_title, {Q.normal('ci.raw')} AS raw_norm, [v.provider] AS route, v.provider AS provider,
 CASE WHEN coalesce(v.parsed_title, '') <> '' THEN {Q.normal('v.parsed_title')} END AS c_title, CASE WHEN coalesce(v.parsed_venue, '') <> '' THEN {Q.normal('v.parsed_venue')} END AS c_venue, {_joined_names('v.parsed_authors')} AS c_names, v.parsed_year AS c_year, {Q.doi(Q.clean('v.parsed_doi'))} AS c_doi,
 CASE WHEN coalesce(p.title, '') <> '' THEN {Q.normal('p.title')} END AS p_title, CASE WHEN coalesce(p.venue, '') <> '' THEN {Q.normal('p.venue')} END AS p_venue, {_joined_names("array_to_string(p.authors, '; ')")} AS p_names, p.year AS p_year, {Q.doi(Q.clean('p.doi'))} AS p_doi, p.candidate_id
 FROM {_VR} v LEFT JOIN citations ci ON v.citation_id = ci.citation_id LEFT JOIN first f ON {Q.doi(Q.clean('v.parsed_doi'))} = f.k AND f.k <> '' LEFT JOIN provider_candidates p ON f.candidate_id = p.candidate_id),
{_SCORED}, x AS (SELECT *, coalesce(saved_exact, false) AND saved_provider <> '' AS again, {_EXACT} AS e FROM scored)
SELECT result_id, CASE WHEN again THEN split_part(e, ':', 1) ELSE status END AS status, round(CASE WHEN again THEN CASE WHEN split_part(e, ':', 1) = 'verified' THEN greatest(overall, 0.95) ELSE overall END ELSE score END, 6) AS score, round(CASE WHEN again THEN title_score ELSE saved_title END, 6) AS title_score FROM x"""


@_query(_REPLAY)
def replay_reclassify(spark, d):
    """Decisions on saved evidence: results of an exact DOI are scored and decided anew, all others stay."""
    out = review.rescore(review.from_flat(_saved(spark, d)))
    return out.select("result_id", "status", F.round("score", 6).alias("score"), F.round("title_score", 6).alias("title_score"))


# Provider answers and pages, made of the tables' own fields -------------------------------------------------------

_CROSS = "SELECT candidate_id, 'crossref' AS provider, {d} AS doi, {t} AS title, year, {v} AS venue, coalesce(len(list_filter(authors, lambda a: trim(coalesce(a, '')) <> '')), 0) AS n_authors FROM provider_candidates"


def _clean_sql(c: str) -> str:
    return Q.clean(f"coalesce({c}, '')")


@_query(_CROSS.format(d=f"lower({_clean_sql('doi')})", t=_clean_sql("title"), v=_clean_sql("venue")))
def crossref_map(spark, d):
    """Records written as one registry answers and read back."""
    date = F.when(F.col("year").isNotNull(), F.struct(F.array(F.array("year")).alias("date-parts")))
    item = F.to_json(F.struct(F.col("doi").alias("DOI"), F.array(F.coalesce("title", F.lit(""))).alias("title"), F.array(F.coalesce("venue", F.lit(""))).alias("container-title"), date.alias("issued"), F.transform("authors", lambda a: F.struct(a.alias("family"))).alias("author")))
    rows = payloads.from_crossref(_t(spark, d, "provider_candidates").select("candidate_id", item.alias("item")), ["candidate_id"], "item")
    return rows.select("candidate_id", "provider", "doi", "title", "year", "venue", F.size("authors").cast("bigint").alias("n_authors"))


@_query(f"SELECT candidate_id, {Q.doi(Q.clean('doi'))} AS doi, {_clean_sql('title')} AS title, CASE WHEN year BETWEEN 1800 AND 2100 THEN year END AS year, {_clean_sql('venue')} AS venue, coalesce(nullif({_clean_sql('identifier')}, ''), {Q.doi(Q.clean('doi'))}) AS identifier FROM provider_candidates")
def openalex_map(spark, d):
    item = F.to_json(F.struct(F.col("identifier").alias("id"), F.col("doi"), F.col("title").alias("display_name"), F.col("year").alias("publication_year"), F.struct(F.struct(F.col("venue").alias("display_name")).alias("source")).alias("primary_location"), F.transform("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author"))).alias("authorships")))
    return payloads.from_openalex(_t(spark, d, "provider_candidates").select("candidate_id", item.alias("item")), ["candidate_id"], "item").select("candidate_id", "doi", "title", "year", "venue", "identifier")


@_query(f"SELECT candidate_id, lower({_clean_sql('doi')}) AS doi, rtrim({_clean_sql('title')}, '.') AS title, {Q.year('CAST(year AS VARCHAR)')} AS year, 'https://pubmed.ncbi.nlm.nih.gov/' || candidate_id || '/' AS url FROM provider_candidates")
def pubmed_map(spark, d):
    item = F.to_json(F.struct(F.col("title"), F.col("venue").alias("fulljournalname"), F.col("year").cast("string").alias("pubdate"), F.array(F.struct(F.lit("doi").alias("idtype"), F.col("doi").alias("value"))).alias("articleids"), F.transform("authors", lambda a: F.struct(a.alias("name"))).alias("authors")))
    return payloads.from_pubmed(_t(spark, d, "provider_candidates").select("candidate_id", item.alias("item")), ["candidate_id"], "candidate_id", "item").select("candidate_id", "doi", "title", "year", "url")


@_query("SELECT citation_id, '\"' || coalesce(nullif(title, ''), nullif(raw, ''), '') || '\"[Title]' || CASE WHEN s <> '' THEN ' AND ' || s || '[Author]' ELSE '' END AS term FROM (SELECT citation_id, title, raw, coalesce(" + Q.surname(Q.clean("coalesce(authors[1], '')")) + ", '') AS s FROM citations)")
def pubmed_terms(spark, d):
    rows = _t(spark, d, "citations").withColumn("s", X.surname(F.coalesce(F.get("authors", F.lit(0)), F.lit(""))))
    return rows.select("citation_id", payloads.pubmed_term(F.col("title"), F.col("raw"), F.col("s")).alias("term"))


_HOST = "lower(regexp_extract(coalesce(u, ''), '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)', 1))"
_URLS = "u AS (SELECT citation_id AS id, CASE citation_id % 9 WHEN 1 THEN 'http://localhost/' || citation_id WHEN 2 THEN 'http://10.' || citation_id % 250 || '.0.1/x' WHEN 3 THEN 'ftp://example.org/' || citation_id WHEN 4 THEN 'https://192.168.0.' || citation_id % 250 WHEN 5 THEN 'https://user@example.org:8080/a?b=' || citation_id WHEN 6 THEN 'http://8.8.8.' || citation_id % 250 || '/' ELSE url END AS u FROM citations)"


@_query(f"WITH {_URLS} SELECT id, {_HOST} AS host, regexp_matches(coalesce(u, ''), '(?i)^https?://') AND {_HOST} <> '' AND NOT regexp_matches({_HOST}, '(?:^|\\.)localhost$') AND NOT (regexp_matches({_HOST}, '^[0-9.]+$') AND regexp_matches({_HOST}, {Q.quoted(web._PRIVATE)})) AND {_HOST} NOT LIKE '[%' AS public FROM u")
def url_guard(spark, d):
    k, s = F.col("citation_id"), lambda x: x.cast("string")
    u = F.when(k % 9 == 1, F.concat(F.lit("http://localhost/"), s(k))).when(k % 9 == 2, F.concat(F.lit("http://10."), s(k % 250), F.lit(".0.1/x"))).when(k % 9 == 3, F.concat(F.lit("ftp://example.org/"), s(k)))
    u = u.when(k % 9 == 4, F.concat(F.lit("https://192.168.0."), s(k % 250))).when(k % 9 == 5, F.concat(F.lit("https://user@example.org:8080/a?b="), s(k))).when(k % 9 == 6, F.concat(F.lit("http://8.8.8."), s(k % 250), F.lit("/"))).otherwise(F.col("url"))
    rows = _t(spark, d, "citations").select(k.alias("id"), u.alias("u"))
    return rows.select("id", web.host_of(F.col("u")).alias("host"), web.is_public_url(F.col("u")).alias("public"))


_ANSWERS = "ans AS (SELECT doc_id, CASE doc_id % 10 WHEN 1 THEN 404 WHEN 2 THEN 403 WHEN 3 THEN 410 ELSE 200 END AS status_code, CASE WHEN doc_id % 10 = 4 THEN 'Page not found' ELSE 'Document ' || doc_id END AS t, coalesce(text, '') AS body FROM documents)"
_MISSING = f"regexp_matches({Q.clean('t || chr(32) || substr(page, 1, 4000)')}, '(?i)\\b(?:404|page not found|content not found|page does not exist)\\b')"


@_query(f"WITH {_ANSWERS}, w AS (SELECT *, '<html><head><title>' || t || '</title></head><body>' || replace(replace(body, '&', '&amp;'), '<', '&lt;') || '</body></html>' AS page FROM ans) SELECT doc_id, CASE WHEN status_code = 403 THEN 'web_restricted' ELSE 'web' END AS provider, CASE WHEN status_code = 403 THEN '' ELSE t END AS title, 'docs.example' AS venue FROM w WHERE status_code NOT IN (404, 410) AND (status_code = 403 OR NOT {_MISSING})")
def web_candidates(spark, d):
    """Documents delivered as pages, some gone, refused, or saying that they are missing."""
    k = F.col("doc_id")
    status = F.when(k % 10 == 1, 404).when(k % 10 == 2, 403).when(k % 10 == 3, 410).otherwise(200)
    title = F.when(k % 10 == 4, "Page not found").otherwise(F.concat(F.lit("Document "), k.cast("string")))
    body = F.concat(F.lit("<html><head><title>"), title, F.lit("</title></head><body>"), F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</body></html>"))
    rows = _t(spark, d, "documents").select("doc_id", F.concat(F.lit("https://docs.example/"), k.cast("string")).alias("url"), status.alias("status_code"), body.alias("body"))
    return web.candidates_of_answers(rows, ["doc_id"]).select("doc_id", "provider", "title", "venue")


@_query()
def provider_payload(spark, d):
    """Fields of the payload stored with a record; broken payloads give nulls."""
    got = F.from_json("raw", "type string, score double, is_referenced_by int")
    return _t(spark, d, "provider_candidates").select("candidate_id", got.alias("j")).select("candidate_id", "j.type", "j.score", "j.is_referenced_by")
