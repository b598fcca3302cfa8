"""What evidence says about a citation: a decision table in one pass over columns, first rule that holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refmill.functions import predicates as P

#: Default threshold of a sure match, and how far below it a match is still near.
THRESHOLD, MARGIN = 0.85, 0.08
_REPAIRED = r"_REPAIRED$"


def _below(c: str, x: float) -> Column:
    return F.coalesce(F.col(c) < x, F.lit(False))


def _at_least(c: str, x: float) -> Column:
    return F.coalesce(F.col(c) >= x, F.lit(False))


def _table(rules: list[tuple[Column, str, str]]) -> Column:
    out = None
    for holds, status, reason in rules:
        value = F.struct(F.lit(status).alias("status"), F.lit(reason).alias("reason"))
        out = F.when(holds, value) if out is None else out.when(holds, value)
    return out


def _open_to_doubt(confidence: float = 0.85) -> Column:
    """Works a registry should hold, without an identifier, read with confidence."""
    return (F.col("doi") == "") & (F.col("url") == "") & (F.col("parse_confidence") >= confidence) & F.col("citation_type").isin("scholarly", "unknown")


def by_exact_doi() -> Column:
    """(status, reason) of a pair with one DOI."""
    sure = F.col("parse_confidence") >= 0.85
    supported = _at_least("author_score", 0.55) | _at_least("year_score", 0.55)
    against = sum(c.cast("int") for c in (_below("title_score", 0.35), _below("author_score", 0.35), F.coalesce(F.col("year_score") == 0, F.lit(False))))
    in_raw = (F.coalesce(F.col("p_title"), F.lit("")) != "") & F.contains(F.col("raw_norm"), F.coalesce(F.col("p_title"), F.lit("")))
    return _table(
        [
            (in_raw, "verified", "DOI_EXACT_RAW_TITLE_CORROBORATED"),
            (_at_least("title_score", 0.72) & supported, "verified", "VERIFIED_IDENTIFIER_AND_METADATA"),
            (sure & (against >= 2), "metadata_mismatch", "DOI_EXACT_METADATA_CONFLICT"),
            (_below("title_score", 0.45) & sure, "metadata_mismatch", "DOI_EXACT_TITLE_CONFLICT"),
            (F.col("title_score").isNull() & _at_least("author_score", 0.75) & _at_least("year_score", 0.55), "verified", "DOI_EXACT_AUTHOR_YEAR_CORROBORATED"),
            (F.lit(True), "identifier_verified_parse_uncertain", "DOI_EXACT_PARSE_UNCERTAIN"),
        ]
    )


def by_match(threshold: float = THRESHOLD, margin: float = MARGIN) -> Column:
    """(status, reason) of the best pair of a citation, whatever the provider."""
    web = F.col("provider") == "web"
    page = (F.coalesce("c_title", F.lit("")) != "") & (F.coalesce("p_title", F.lit("")) != "") & F.contains(F.coalesce("p_title", F.lit("")), F.coalesce("c_title", F.lit("")))
    page_fits = (_at_least("title_score", 0.60) | page) & (F.col("parse_confidence") >= 0.70)
    exact = F.coalesce(F.col("doi_exact"), F.lit(False))
    known = sum(F.col(f"{k}_score").isNotNull().cast("int") for k in ("title", "author", "year", "venue"))
    supported = _at_least("author_score", 0.55) | _at_least("year_score", 0.55)
    near = F.col("overall") >= threshold - margin
    before = _table(
        [
            (F.col("provider") == "web_restricted", "web_access_restricted", "WEB_SERVER_ACCESS_RESTRICTED"),
            (web & page_fits & (F.col("citation_type") == "book_thesis"), "grey_literature_validated", "OFFICIAL_URL_AND_TITLE_MATCH"),
            (web & page_fits, "web_validated", "WEB_URL_AND_TITLE_MATCH"),
            (web, "web_reachable", "URL_REACHABLE_METADATA_UNAVAILABLE"),
            ((F.coalesce(F.col("match_reason"), F.lit("")) == "DOI_MISMATCH") & ~exact, "metadata_mismatch", "DOI_CONFLICT"),
        ]
    )
    after = _table(
        [
            (F.col("title_score").isNull() | (known < 2), "review", "INSUFFICIENT_METADATA"),
            (_at_least("title_score", 0.85) & supported & (F.col("overall") >= threshold), "verified", "VERIFIED_METADATA"),
            (near, "review", "BORDERLINE_MATCH"),
            (_below("title_score", 0.45) & _below("author_score", 0.45), "review", "WEAK_REGISTRY_CANDIDATE"),
            (F.lit(True), "review", "SCORE_BELOW_THRESHOLD"),
        ]
    )
    return F.coalesce(before, F.when(exact, by_exact_doi()), after)


def doubt_reason() -> Column:
    """Why a citation with none but meaningless matches may be invented, "" if it may not."""
    empty = (F.col("title_score").isNull() | _below("title_score", 0.45)) & (F.col("author_score").isNull() | _below("author_score", 0.45))
    outage = (F.col("queried") >= 1) & (F.col("n_providers") >= 2) & (F.col("n_errors") >= 1) & (F.col("parse_confidence") >= 0.90)
    return (
        F.when(~(_open_to_doubt() & empty), "")
        .when(F.col("queried") >= 2, "MULTI_REGISTRY_NO_MEANINGFUL_MATCH")
        .when(outage, "NO_MEANINGFUL_MATCH_PARTIAL_REGISTRY_OUTAGE")
        .otherwise("")
    )


def no_match_status() -> Column:
    all_failed = (F.col("n_providers") > 0) & (F.col("n_errors") == F.col("n_providers"))
    return F.when(all_failed, "error").when((F.col("queried") >= 2) & _open_to_doubt(), "potential_hallucination").otherwise("not_found")


def no_match_reasons() -> Column:
    status = no_match_status()
    why = F.when(F.col("doi") != "", "DOI_NOT_FOUND").when(F.col("url") != "", "URL_NOT_VALIDATED").when(P.is_coverage_gap(F.col("raw"), F.col("doi")), "COVERAGE_GAP")
    return F.array_compact(F.array(F.when(status == "error", "PROVIDER_ERROR").otherwise("NO_REGISTRY_MATCH"), why, F.when(status == "potential_hallucination", "MULTI_REGISTRY_NO_MATCH")))


def decide(rows: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """rows with status, reasons and score.

    rows has one row per citation: raw, raw_norm, doi, url, citation_type, parse_confidence, parse_flags, c_title; the best
    pair's provider (null if there is none), p_title, scores, doi_exact, match_reason, overall; and queried,
    n_providers, n_errors. Fatal flags end it before any look-up counts; a verified DOI lifts the score and drops the mismatch.
    """
    fatal = P.has_fatal_flag(F.col("parse_flags"))
    found = F.col("provider").isNotNull()
    rows = rows.withColumns({"doubt_": doubt_reason(), "match_": by_match(threshold, margin)})
    doubted = F.col("doubt_") != ""
    status = F.when(fatal, "parse_error").when(~found, no_match_status()).when(doubted, "potential_hallucination").otherwise(F.col("match_.status"))
    rows = rows.withColumn("status", status)
    lifted = found & ~fatal & (F.col("status") == "verified") & F.coalesce(F.col("doi_exact"), F.lit(False))
    of_match = F.array_compact(F.array(F.when(~(lifted & (F.col("match_reason") == "DOI_METADATA_MISMATCH")), F.col("match_reason")), F.when(doubted, F.col("doubt_")).otherwise(F.col("match_.reason"))))
    reasons = F.when(fatal, F.filter("parse_flags", lambda f: ~f.rlike(_REPAIRED))).when(~found, no_match_reasons()).otherwise(of_match)
    score = F.when(fatal | ~found, 0.0).when(lifted, F.greatest("overall", F.lit(0.95))).otherwise(F.col("overall"))
    return rows.withColumns({"reasons": reasons, "score": score}).drop("doubt_", "match_")
