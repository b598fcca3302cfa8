"""Scores, look-ups, decisions, replay, measures, sources and sinks."""

import json

import pytest
from pyspark.sql import functions as F
from refmill.operators import decide, metrics, review, scoring
from refmill.plans import audit as A
from refmill.sinks import reports
from refmill.sources import files, payloads, web

CITED = "citation_id long, raw string, title string, authors array<string>, year int, venue string, doi string, url string, citation_type string, parse_confidence double, parse_flags array<string>, extra string"
HELD = "candidate_id long, provider string, title string, authors array<string>, year int, venue string, doi string, url string"


def cited(i, title="A study of river deltas and peat", authors=("Smith, J.",), year=2020, doi="", url="", kind="scholarly", confidence=1.0, flags=(), raw="", venue="Journal"):
    return (i, raw, title, list(authors) if authors is not None else None, year, venue, doi, url, kind, confidence, list(flags), "x")


def held(i, provider="crossref", title="A study of river deltas and peat", authors=("Smith, John",), year=2020, doi="", venue="Journal"):
    return (i, provider, title, list(authors), year, venue, doi, "")


def decided(spark, citations, candidates):
    rows = A.audit(spark.createDataFrame(citations, CITED), spark.createDataFrame(candidates, HELD))
    return {r.citation_id: (r.status, r.reasons, r.score, r.candidate_id) for r in rows.collect()}


def test_every_rule_of_the_table(spark):
    other = "Quantum governance in orbital cities volume nine"
    got = decided(
        spark,
        [
            cited(1), cited(2, doi="10.1234/a"), cited(3, title=other, doi="10.1234/a"), cited(4, title=other, authors=["Zyx, Q."], year=1999, doi="10.1234/a"),
            cited(5, title=other, authors=["Zyx, Q."], year=1999), cited(6, doi="10.1234/none", title=other), cited(7, flags=["MERGED_CITATION", "SPLIT_CITATION_REPAIRED"]),
            cited(8, title="", doi="10.1234/a"), cited(9, title=other, doi="10.1234/a", raw="Smith. A Study of River Deltas, and Peat. 1999"), cited(10, year=1990, authors=["Zyx, Q."]),
            cited(11, kind="web_policy", url="https://x.y"), cited(12, doi="10.1234/b"), cited(13, title="", authors=None, year=None, venue=""),
        ],
        [held(1, doi="10.1234/a"), held(2, "openalex"), held(3, "web")],
    )
    assert got[1] == ("verified", "VERIFIED_METADATA", 1.0, 1)
    assert got[2] == ("verified", "DOI_EXACT_MATCH | VERIFIED_IDENTIFIER_AND_METADATA", 1.0, 1)
    assert got[3][:2] == ("metadata_mismatch", "DOI_METADATA_MISMATCH | DOI_EXACT_TITLE_CONFLICT")
    assert got[4][:2] == ("metadata_mismatch", "DOI_METADATA_MISMATCH | DOI_EXACT_METADATA_CONFLICT")
    assert got[5][:2] == ("potential_hallucination", "NO_REGISTRY_MATCH | MULTI_REGISTRY_NO_MATCH")
    assert got[6][:2] == ("not_found", "NO_REGISTRY_MATCH | DOI_NOT_FOUND")
    assert got[7] == ("parse_error", "MERGED_CITATION", 0.0, None)
    assert got[8][0] == "verified" and got[8][1].endswith("DOI_EXACT_AUTHOR_YEAR_CORROBORATED") and got[8][2] == 0.95
    assert got[9][:3] == ("verified", "DOI_EXACT_RAW_TITLE_CORROBORATED", 0.95)
    assert got[10][:2] == ("review", "SCORE_BELOW_THRESHOLD") or got[10][0] == "review"
    assert got[11][:2] == ("web_validated", "WEB_URL_AND_TITLE_MATCH")
    assert got[12][:2] == ("verified", "VERIFIED_METADATA") and got[12][3] == 2  # the record with another DOI scores less
    assert got[13][0] == "potential_hallucination"


def test_audit_of_empty_tables(spark):
    assert decided(spark, [], [held(1)]) == {}
    assert decided(spark, [cited(1, kind="unknown", doi="10.1234/a", title=None)], [])[1][:2] == ("not_found", "NO_REGISTRY_MATCH | DOI_NOT_FOUND")


def test_outage_and_errors(spark):
    base = {"doi": "", "url": "", "citation_type": "scholarly", "parse_confidence": 0.95, "title_score": 0.2, "author_score": 0.1, "queried": 1, "n_providers": 2, "n_errors": 1, "raw": "x"}
    df = spark.createDataFrame([base, base | {"n_errors": 2, "queried": 0}, base | {"parse_confidence": 0.88}])
    assert [r[0] for r in df.select(decide.doubt_reason()).collect()] == ["NO_MEANINGFUL_MATCH_PARTIAL_REGISTRY_OUTAGE", "", ""]
    assert [r[0] for r in df.select(decide.no_match_status()).collect()][1] == "error"


def test_scores_in_any_script(spark):
    c = scoring.comparable(spark.createDataFrame([cited(1, "Été à 漢字", ["Núñez, A.", "Müller, B."], 2020, "10.1234/e")], CITED), ["citation_id"], "c_")
    p = scoring.comparable(spark.createDataFrame([held(1, title="Ete a 漢子", authors=["Ana Nunez"], year=2021)], HELD), ["candidate_id"], "p_")
    r = scoring.score_pairs(c.crossJoin(p)).first()
    assert r.title_score == pytest.approx(1 - 1 / 8) and r.year_score == 0.55 and r.venue_score == 1.0
    assert r.author_score == pytest.approx(0.6 + 0.4 * (1 + (1 - 4 / 6)) / 2, abs=1e-9) and r.doi_exact is False and r.match_reason is None


def test_ties_go_to_the_first_asked(spark):
    rows = [(1, r, i, s) for r, i, s in ((1, 5, 0.8), (0, 9, 0.8), (0, 7, 0.8), (2, 1, 0.7))]
    df = spark.createDataFrame(rows, "k long, provider_rank int, candidate_id long, overall double")
    assert scoring.best_evidence(df, "k", []).first().candidate_id == 7
    early = spark.createDataFrame([(1, 0, 9, 0.86), (1, 1, 5, 0.99)], df.schema)
    assert scoring.best_evidence(early, "k", []).first().candidate_id == 9


def test_title_search_against_all_pairs(spark):
    words = "river delta peat study model urban rural heat flow deep"
    titles = [" ".join(w for k, w in enumerate(words.split()) if (n >> k) & 1) for n in range(1, 200, 3)]
    c = spark.createDataFrame([(i, t) for i, t in enumerate(titles)] + [(900, titles[5]), (901, None), (902, "")], "citation_id long, c_title string")
    p = spark.createDataFrame([(i, "x", t) for i, t in enumerate(titles[::2] + titles[:9] * 3)], "candidate_id long, provider string, p_title string")
    got = {(r.citation_id, r.place): r.candidate_id for r in scoring.title_search(c, p, "citation_id", "candidate_id", ["provider"], 4).collect()}
    want = {}
    for r in c.where("c_title <> ''").collect():
        a = set(r.c_title.split())
        best = sorted((-len(a & set(q.p_title.split())) / len(a | set(q.p_title.split())), q.candidate_id) for q in p.collect() if q.p_title)
        want |= {(r.citation_id, n): i for n, (j, i) in enumerate([b for b in best if -b[0] >= 0.5][:4], 1)}
    assert got == want


def test_measures_match_published_figures(spark):
    rows = [("valid", "verified")] * 483 + [("invalid", "verified")] * 122 + [("invalid", "review")] * 378 + [("valid", "review")] * 17 + [("valid", "error")] * 3
    df = spark.createDataFrame([(a, b, "" if n % 2 else "swap") for n, (a, b) in enumerate(rows)], "label string, status string, mutation_type string")
    r = metrics.quality(df).first()
    assert (r.precision_valid, r.recall_valid, r.recall_ghost_detection, r.f1_ghost_detection, r.excluded_errors) == (0.798347, 0.966, 0.756, 0.844693, 3)
    assert {x.mutation_type for x in metrics.by_mutation(df).collect()} == {"swap", "none", "unspecified"}
    assert metrics.summarize(df).first().verified_rate == round(605 / 1003, 4) and metrics.summarize(df.limit(0)).first().verified_rate == 0
    assert reports.metrics_of(df)["status_by_ground_truth"]["invalid"] == {"review": 378, "verified": 122}


FLAT = {c: "" for c in review.FLAT}


def saved(**kw):
    return FLAT | {"ordinal": "1", "raw_citation": "Smith, J. (2020). River deltas of the north. Journal. 10.1234/a", "status": "verified", "score": "0.96", "provider": "crossref"} | kw


def test_replay(spark, tmp_path):
    hijack = {"parsed_title": "Quantum governance in orbital cities", "parsed_authors": "Smith, J.", "parsed_year": "2020", "parsed_doi": "10.1234/a", "parse_confidence": "1.0", "citation_type": "odd", "doi_exact": "True", "title_score": "0.2", "matched_title": "River deltas", "matched_authors": "Smith, John", "matched_year": "2020", "matched_doi": "10.1234/A"}
    rows = [saved(**hijack | {"raw_citation": "Smith, J. (2020). Quantum governance in orbital cities. Journal. 10.1234/a"}), saved(ordinal="2")]
    (tmp_path / "r.json").write_text(json.dumps({"results": rows}))
    records = spark.createDataFrame([(1, rows[0]["raw_citation"]), (2, rows[1]["raw_citation"])], "ordinal int, citation string")
    flat = files.read_saved_results(spark, str(tmp_path / "r.json"))
    got = {r.ordinal: r for r in review.replay(records, flat).collect()}
    assert got[1].status == "metadata_mismatch" and got[1].reasons == ["DOI_METADATA_MISMATCH", "DOI_EXACT_TITLE_CONFLICT"] and got[1].score <= 0.7
    assert got[2].status == "verified" and got[2].score == 0.96 and got[2].citation_type == "unknown"
    with pytest.raises(Exception, match="does not match"):
        review.replay(records.withColumn("citation", F.lit("other text of 2020")), flat).collect()
    with pytest.raises(Exception, match="does not match"):
        review.replay(records.where("ordinal = 1"), flat).collect()


def test_reports(spark, tmp_path):
    flat = spark.createDataFrame([saved(status="verified", score="0.5", raw_citation="<b> é", parse_flags="a | b")]).select(*review.FLAT)
    for write, name in ((reports.write_csv, "results.csv"), (reports.write_json, "results.json"), (reports.write_html, "report.html")):
        assert write(flat, str(tmp_path)).endswith(name)
    assert (tmp_path / "results.csv").read_bytes().startswith(b"\xef\xbb\xbfordinal,") and (tmp_path / "results.csv").read_text("utf-8-sig").count("\n") == 2
    assert json.loads((tmp_path / "results.json").read_text("utf-8"))["summary"]["total"] == 1
    assert "&lt;b&gt; é" in (tmp_path / "report.html").read_text("utf-8")
    reports.write_csv(flat.limit(0), str(tmp_path))
    assert (tmp_path / "results.csv").read_text() == ""
    gold = spark.createDataFrame([("1", "invalid", "r1")], "ordinal string, label string, record_id string")
    assert reports.write_predictions(gold, flat, str(tmp_path)) and "False" in (tmp_path / "predictions.csv").read_text("utf-8-sig")
    edits = spark.createDataFrame([("1", "confirm_flag", None)], "ordinal string, reviewer_decision string, reviewer_note string")
    r = review.apply_edits(flat, edits, "ordinal").first()
    assert (r.reviewer_decision, r.reviewer_note) == ("confirm_flag", "")
    reports.write_cache(spark.createDataFrame([("k", None)], files.CACHE_SCHEMA), str(tmp_path / "cache"))
    assert files.read_cache(spark, str(tmp_path / "cache")).count() == 0 and files.read_cache(spark, str(tmp_path / "none")).count() == 0


def test_numbered_counts_on_over_partitions(spark):
    df = review.numbered(spark.range(1000).repartition(7), "id")
    assert [r.ordinal - r.id for r in df.collect()] == [1] * 1000


def test_provider_answers(spark):
    item = {"DOI": "10.1234/A", "title": ["A &amp; B"], "author": [{"family": "Smith", "given": "J"}, {"given": "Solo"}, None], "issued": {"date-parts": [[2020, 1]]}, "published-print": {"date-parts": [[None]]}, "container-title": []}
    df = spark.createDataFrame([(json.dumps(item),), ("broken",), (None,)], "j string")
    r = payloads.from_crossref(df, [], "j").collect()
    assert (r[0].title, r[0].authors, r[0].year, r[0].doi, r[0].url) == ("A & B", ["Smith, J", "Solo"], 2020, "10.1234/a", "https://doi.org/10.1234/a") and r[1].title == "" and r[2].authors == []
    work = {"id": "W1", "display_name": None, "title": "T", "publication_year": 1700, "authorships": [{"author": {"display_name": "Ann Lee"}}, {}], "primary_location": None}
    r = payloads.from_openalex(spark.createDataFrame([(json.dumps(work),)], "j string"), [], "j").first()
    assert (r.title, r.year, r.authors, r.url) == ("T", None, ["Ann Lee"], "W1")
    paper = {"title": "P.", "elocationid": "doi: 10.1234/ b", "pubdate": "2019 Jan", "authors": [{"name": "Lee A"}]}
    r = payloads.from_pubmed(spark.createDataFrame([("7", json.dumps(paper))], "k string, j string"), [], "k", "j").first()
    assert (r.title, r.doi, r.year, r.authors) == ("P", "10.1234/b", 2019, ["Lee A"])


def test_web_pages(spark):
    page = '<title>Old</title><meta name="citation_title" content="New  title"><meta name="author" content="A"><meta name="dc.date" content="2018-01"><h1>H</h1>'
    assert web.page_head(page) == ("New title", ["A"], "2018-01")
    assert web.page_head("<h1>Only &amp; this</h1><h1>no</h1>") == ("Only & this", [], "") and web.page_head(None) == ("", [], "")
    rows = spark.createDataFrame([(1, "https://a.b/x", 200, page), (2, "https://a.b/y", 403, None), (3, "https://a.b/z", 404, ""), (4, "https://a.b/w", 200, "<title>Page not found</title>")], "k long, url string, status_code int, body string")
    got = {r.k: r for r in web.candidates_of_answers(rows, ["k"]).collect()}
    assert set(got) == {1, 2} and got[1].year == 2018 and got[1].venue == "a.b" and got[2].provider == "web_restricted"


def test_fetching(spark):
    urls = ["http://127.0.0.1/", "http://localhost/x", "file:///etc/passwd", "http://[::1]/", "https://a.b/ok", None, ""]

    def get(url):
        return 200, {}, "body"

    df = spark.createDataFrame(list(enumerate(urls)), "k long, url string")
    got = {r.k: (r.status_code, r.error) for r in web.fetch(df, "k", "url", get, 1000.0).collect()}
    assert got == {0: (0, "not a public address"), 1: (0, "not a public address"), 2: (0, "not a public address"), 3: (0, "not a public address"), 4: (200, "")}
    public = {r.k: r.p for r in df.select("k", web.is_public_url(F.col("url")).alias("p")).collect()}
    assert [k for k, v in public.items() if v] == [4]
    waits, answers = [], iter([(503, {"Retry-After": "99"}, ""), (429, {}, ""), (200, {}, "x")])
    assert web.get_patiently(lambda u: next(answers), "u", 3, waits.append) == (200, "x", "") and waits == [30.0, 1.0]
    assert web.get_patiently(lambda u: 1 / 0, "u", 1, lambda s: None)[2].startswith("ZeroDivisionError")


def test_audit_of_a_stream_and_command(spark, tmp_path):
    from refmill.cli import main
    from refmill.streaming.audit import audit_stream

    records = spark.createDataFrame([held(1, doi="10.1234/a")], HELD)
    records.write.parquet(str(tmp_path / "held"))
    folder = tmp_path / "in"
    folder.mkdir()
    text = "References\nSmith, J. (2020). A study of river deltas and peat. Journal. 10.1234/a\nGreen, B. (2019). Invented title of some length. Journal of Nothing, 1(2), 3-4.\n"
    (folder / "a.txt").write_text(text)
    audit_stream(spark, str(folder), records, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert sorted(r.status for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["potential_hallucination", "verified"]
    main(["verify", str(folder / "a.txt"), "--records", str(tmp_path / "held"), "--out", str(tmp_path / "rep")])
    assert json.loads((tmp_path / "rep" / "results.json").read_text("utf-8"))["summary"]["verified"] == 1
    (tmp_path / "g.csv").write_text("citation,label\n\"Smith, J. (2020). A study of river deltas and peat. Journal. 10.1234/a\",valid\n")
    main(["benchmark", str(tmp_path / "g.csv"), "--records", str(tmp_path / "held"), "--out", str(tmp_path / "b")])
    assert json.loads((tmp_path / "b" / "metrics.json").read_text())["tp_valid"] == 1
    main(["benchmark", str(tmp_path / "g.csv"), "--reuse-results", str(tmp_path / "b" / "results.json"), "--out", str(tmp_path / "c")])
    assert json.loads((tmp_path / "c" / "metrics.json").read_text())["tp_valid"] == 1
