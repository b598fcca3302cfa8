"""Text functions, segmentation and fields against cases stated by hand."""

import html
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from refmill.functions import predicates as P
from refmill.functions import text as X
from refmill.operators import fields, layout, segment
from refmill.sources import files


def one(spark, c, value):
    return spark.createDataFrame([(value,)], "v string").select(c(F.col("v")).alias("r")).first().r


def test_text_functions(spark):
    assert one(spark, X.normalize_doi, "see https://doi.org/10.1234/AbC.9).") == "10.1234/abc.9"
    assert one(spark, X.normalize_doi, None) == ""
    assert one(spark, X.repair_identifiers, "doi. org doi 10.1234/ abc- def. Next https://a.b/ c_ d end") == "doi.org doi 10.1234/abc-def.Next https://a.b/c_d end"
    assert one(spark, X.repair_identifiers, "a- b / c. d") == "a- b / c. d"
    assert one(spark, X.extract_year, "in 12019 and 2021a.") == 2021
    assert one(spark, X.extract_year, "") is None
    assert one(spark, X.surname, "van Dyk, A.") == "van dyk"
    assert one(spark, X.surname, "Ann Lée") == "lee"
    assert one(spark, X.clean_text, "ﬁne&amp;\xa0 so­ft\n") == "fine& soft"
    assert one(spark, X.normalize_text, "Straße—ÉTÉ &lt;b&gt; x_y") == "strasse ete b x_y"
    assert one(spark, X.normalize_text, None) == ""
    assert one(spark, X.venue_head, "Nature, 12(3), 4-5") == "Nature"


def test_normalize_against_plain_python(spark):
    cases = ["", "Ａbc　é", "é Ǆ", "Ω & &lt;i&gt;", "naïve ﬂow №5", "العربية 漢字 ｶﾞ", "a​b", "İstanbul ẞ"]

    def plain(v):
        v = unicodedata.normalize("NFKC", html.unescape(v)).replace("­", "").replace("\xa0", " ")
        v = unicodedata.normalize("NFKD", re.sub(r"\s+", " ", v).strip().casefold())
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", "".join(c for c in v if not unicodedata.combining(c)))).strip()

    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, v string").withColumn("n", X.normalize_text(F.col("v")))
    assert [r.n for r in df.orderBy("i").collect()] == [plain(c) for c in cases]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text("abé 漢", max_size=8), min_size=2, max_size=6))
def test_similarity_is_symmetric_and_bounded(spark, words):
    df = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for r in df.select(X.similarity(F.col("a"), F.col("b")).alias("x"), X.similarity(F.col("b"), F.col("a")).alias("y"), (F.col("a") == F.col("b")).alias("e")).collect():
        assert r.x == r.y and 0 <= r.x <= 1 and (not r.e or r.x == 1)


def test_surnames_keep_order_and_drop_empty(spark):
    df = spark.createDataFrame([(["Smith, J.", "", None, "Ana Núñez", "，", "O'Neil, P"],), (None,), ([],)], "a array<string>")
    assert [r.s for r in df.select(X.surnames(F.col("a")).alias("s")).collect()] == [["smith", "nunez", "o neil"], [], []]


TEXT = """Intro
2. References
Smith, J. (2020). One title about things. Journal A, 1(2), 3-4.
continued here
Green, B. A. (2019). Two titles. Journal B. 10.1234/abc Brown, C. (2018). Three titles. Journal C, 4, 5-6.
Example Institute. (n.d.). A policy of some length. https://example.org/policy
[4] White, D. 2017. Four. Journal D.
Appendix A
Black, E. (2000). Not a reference of this list.
"""


def references_of(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    return segment.references(segment.entries(segment.with_section(df, "t"), ["id"]), ["id"]).orderBy("id", "entry", "piece").collect()


def test_sections_entries_and_pieces(spark):
    got = references_of(spark, TEXT, None, "", "No list here", "Grey, F. (2011). A text without a heading is taken whole. Funding\nFunding agencies")
    of = [r.raw for r in got if r.id == 0]
    assert [x.split(",")[0].split(".")[0] for x in of] == ["Smith", "Green", "Brown", "Example Institute", "[4] White"]
    assert of[0].endswith("continued here")
    assert [r.flags for r in got if r.id == 0][1:3] == [["MERGED_CITATION_REPAIRED"]] * 2
    assert [r.id for r in got if r.id > 0] == [4] and "agencies" in got[-1].raw


def test_lines_and_flags(spark):
    assert one(spark, P.before_end, "text Appendix B: more") == "text"
    assert one(spark, P.before_end, "Acknowledgements and more") == ""
    assert one(spark, P.is_fragment, "https://doi.org/10.1234/x") and one(spark, P.is_fragment, "Journal of Things, 12(3)")
    assert not one(spark, P.is_fragment, "Smith, J. (2020). A.")
    assert one(spark, P.is_heading, "7 REFERENCES") and not one(spark, P.is_heading, "references to others")
    assert one(spark, P.diagnose, "See 2020 Appendix. https://a.b https://c.d 10.1234/a 10.1234/b") == ["MERGED_CITATION", "MULTIPLE_URLS", "APPENDIX_CONTAMINATION"]


def test_hinted_entries_over_pages(spark):
    rows = [
        (1, 1, 0, "Smith, J. (2020). A first title that runs", True), (1, 1, 1, "on a second line.", False),
        (1, 2, 0, "A report led by its title (2021). Publisher.", True), (1, 2, 1, "Green, B. (2019). Split over pages without", True),
        (1, 3, 0, "any sign of an end", True), (1, 3, 1, "https://doi.org/10.1234/x", False),
    ]
    got = segment.hinted_entries(spark.createDataFrame(rows, "doc long, page int, pos int, line string, hint boolean"), "doc").orderBy("entry").collect()
    assert [(r.first_page, r.last_page, r.flags) for r in got] == [(1, 1, []), (2, 2, []), (2, 3, ["SPLIT_CITATION_REPAIRED"])]
    assert got[2].raw.endswith("any sign of an end https://doi.org/10.1234/x")


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Smith, J. A., & Green, B. (2020). A title of note. Journal of Things, 12(3), 4-5. https://doi.org/10.1234/ab.", (["Smith, J. A.", "Green, B"], "A title of note", "Journal of Things, 12(3), 4-5", 2020, "10.1234/ab", "scholarly", 1.0)),
        ("1. Smith, John. 2023. “Commas, and quotes.” Review 9 (2): 1-2.", ([], "Smith, John", "Commas, and quotes", 2023, "", "scholarly", 0.82)),
        ("Vaswani, A. (2017). Attention is all. arXiv preprint arXiv:1706.", (["Vaswani, A"], "Attention is all", "arXiv preprint arXiv:1706", 2017, "", "unknown", 0.82)),
        ("Example Institute. (n.d.). A policy of some length. https://example.org/policy", (["Example Institute"], "A policy of some length", "", None, "", "web_policy", 1.0)),
        ("2021 China report on things (2022). Press.", ([], "2021 China report on things", "Press", 2022, "", "web_policy", 1.0)),
        ("", ([], "", "", None, "", "unknown", 0.47)),
        (None, ([], "", "", None, "", "unknown", 0.47)),
    ],
)
def test_fields(spark, raw, want):
    r = fields.parse_citations(spark.createDataFrame([(raw,)], "raw string"), "raw").first()
    assert (r.authors, r.title, r.venue, r.year, r.doi, r.citation_type, float(r.parse_confidence)) == want


def test_fields_flags_and_own_doi(spark):
    df = spark.createDataFrame([("Smith, J. (2020). A title. J. 10.1234/ab", ["SPLIT_CITATION_REPAIRED"], "10.1234/AB")], "raw string, f array<string>, own string")
    r = fields.parse_citations(df, "raw", "f", "own").first()
    assert r.parse_flags == ["SPLIT_CITATION_REPAIRED", "SELF_DOI_CONTAMINATION"] and r.parse_confidence == 0


def test_layout_merges_fragments_and_orders_columns(spark):
    page = [("d", 1, n, x0, y, x1, y + 10, t, 612.0, 792.0) for n, (x0, y, x1, t) in enumerate([(45.0, 100.0, 90.0, "Left"), (93.0, 100.0, 200.0, "one"), (310.0, 100.0, 500.0, "Right one"), (45.0, 700.0, 560.0, "Spanning foot of the page"), *((45.0, 112.0 + 12 * k, 250.0, f"left {k}") for k in range(4)), *((310.0, 112.0 + 12 * k, 500.0, f"right {k}") for k in range(4)), (300.0, 750.0, 310.0, "12")])]
    df = spark.createDataFrame(page, "doc string, page int, line_no long, x0 double, y0 double, x1 double, y1 double, text string, page_width double, page_height double")
    got = [r.text for r in layout.reading_order(df).orderBy("place").collect()]
    assert got == ["Left one", "left 0", "left 1", "left 2", "left 3", "Right one", "right 0", "right 1", "right 2", "right 3", "Spanning foot of the page"]
    spans = spark.createDataFrame([("d", 1, 0, 10.0, 20.0, "Two "), ("d", 1, 0, 25.0, 30.0, "words"), ("d", 1, 0, 30.5, 33.0, "!"), ("d", 1, 1, 0.0, 1.0, " ")], "doc string, page int, line_no long, x0 double, x1 double, text string")
    assert [r.text for r in layout.lines_from_spans(spans).collect()] == ["Two words!"]


def test_reading_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("﻿" + TEXT, encoding="utf-8")
    rows = files.citations_of(files.read_texts(spark, str(tmp_path)), "path", "text").orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == [1, 2, 3, 4, 5] and rows[1].doi == "10.1234/abc" and rows[1].parse_confidence == 0.92
    (tmp_path / "g.csv").write_text('﻿citation_text,ground_truth\n"Smith, J. ""x""\n(2020)",Genuine\nB. 2021,ghost\n', encoding="utf-8")
    gold = files.read_gold_csv(spark, str(tmp_path / "g.csv")).orderBy("ordinal").collect()
    assert [(r.ordinal, r.label) for r in gold] == [(1, "valid"), (2, "invalid")] and '"x"\n' in gold[0].citation
    (tmp_path / "bad.csv").write_text("citation,label\nx,perhaps\n", encoding="utf-8")
    with pytest.raises(Exception, match="gold row"):
        files.read_gold_csv(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "b.rtf").write_text("x")
    with pytest.raises(Exception, match="unsupported"):
        files.read_texts(spark, str(tmp_path / "b.rtf")).collect()
