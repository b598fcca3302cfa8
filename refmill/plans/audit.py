"""The whole audit: citations looked up in registries, scored, and decided, as one declarative plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refmill.functions import predicates as P
from refmill.functions.text import normalize_text
from refmill.operators import decide, scoring
from refmill.operators.review import flatten
from refmill.session import cut

#: What of a citation the decision needs, and of the best pair.
ABOUT = ["raw", "raw_norm", "doi", "url", "citation_type", "parse_confidence", "parse_flags"]
EVIDENCE = ["provider", "c_title", "p_title", "title_score", "author_score", "year_score", "venue_score", "doi_exact", "match_reason"]


def compared(citations: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Citations and candidates with their fields as they are compared, each normalized once and written, as both are read more than once."""
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    empty = F.array().cast("array<string>")
    rows = scoring.with_route(citations).withColumns({"raw_norm": normalize_text(F.col("raw")), "parse_confidence": F.coalesce("parse_confidence", F.lit(0.0)), "parse_flags": F.coalesce("parse_flags", empty)})
    rows = rows.withColumns({"venue": text("venue"), "title": text("title"), "url": text("url"), "raw": text("raw"), "citation_type": F.coalesce("citation_type", F.lit("unknown"))})
    kept = ["citation_id", "route", "raw", "raw_norm", "url", "citation_type", "parse_confidence", "parse_flags"]
    c = cut(scoring.comparable(rows, kept, "c_").withColumn("doi", F.col("c_doi")))
    return c, cut(scoring.comparable(candidates, ["candidate_id", "provider"], "p_"))


def lookups(c: DataFrame, p: DataFrame, k: int = 5) -> DataFrame:
    """(citation_id, candidate_id) of every provider asked: records with the citation's DOI, where a provider has none the k most alike by title."""
    by_doi = scoring.doi_pairs(c, p).where(F.array_contains("route", F.col("provider"))).select("citation_id", "candidate_id", "provider")
    found = scoring.title_search(c.where("size(route) > 0"), p, "citation_id", "candidate_id", ["provider"], k)
    asked = found.join(c.select("citation_id", "route"), "citation_id").where(F.array_contains("route", F.col("provider"))).select("citation_id", "candidate_id", "provider")
    return by_doi.unionByName(asked.join(by_doi.select("citation_id", "provider").distinct(), ["citation_id", "provider"], "left_anti"))


def scored_pairs(c: DataFrame, p: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs with scores and provider_rank, the place of the provider among those asked, from 0."""
    rows = pairs.select("citation_id", "candidate_id").join(c, "citation_id").join(p, "candidate_id")
    return scoring.score_pairs(rows).withColumn("provider_rank", F.array_position("route", F.col("provider")) - 1)


def audit(citations: DataFrame, candidates: DataFrame, threshold: float = decide.THRESHOLD, margin: float = decide.MARGIN) -> DataFrame:
    """One row per citation: citation_id, status, reasons, score, candidate_id, provider and the scores of the best pair.

    Citations with a fatal flag aren't looked up. Candidates stand for what providers answered, so none has failed.
    """
    c, p = compared(citations, candidates)
    sound = c.where(~P.has_fatal_flag(F.col("parse_flags")))
    best = scoring.best_evidence(scored_pairs(sound, p, lookups(sound, p)), "citation_id", EVIDENCE, threshold)
    rows = c.drop("c_title").join(best, "citation_id", "left")
    rows = rows.withColumns({"queried": F.when(F.coalesce("early", F.lit(False)), 1).otherwise(F.size("route")), "n_providers": F.size("route"), "n_errors": F.lit(0)})
    return decide.decide(rows, threshold, margin).select("citation_id", "status", F.array_join("reasons", " | ").alias("reasons"), F.round("score", 6).alias("score"), "candidate_id", "provider", *(F.round(f"{x}_score", 6).alias(f"{x}_score") for x in ("title", "author", "year", "venue")), "doi_exact")


def audit_parsed(parsed: DataFrame, candidates: DataFrame, key: str, **settings: float) -> DataFrame:
    """The flat results of parsed references (key unique, fields of parse_citations()) against candidates."""
    # written first: it is read for the look-up and for the result
    rows = cut(parsed.drop("raw").withColumnRenamed(key, "citation_id").withColumnRenamed("raw_citation", "raw"))
    said = audit(rows, candidates, **settings).withColumnRenamed("provider", "provider_")
    c, p = rows.alias("c"), candidates.alias("p")
    joined = said.alias("s").join(c, "citation_id").join(p, F.col("s.candidate_id") == F.col("p.candidate_id"), "left")
    fields = {"raw_citation": "c.raw", "parsed_title": "c.title", "parsed_authors": "c.authors", "parsed_year": "c.year", "parsed_venue": "c.venue", "parsed_doi": "c.doi", "parsed_url": "c.url", "matched_title": "p.title", "matched_authors": "p.authors", "matched_year": "p.year", "matched_venue": "p.venue", "matched_doi": "p.doi", "matched_url": "p.url", "provider": "s.provider_"}
    kept = [F.col(f"c.{x}") for x in ("citation_type", "parse_confidence", "parse_flags")] + [F.col("c.ordinal") if "ordinal" in rows.columns else F.col("citation_id").alias("ordinal")]
    scores = [F.col(f"s.{x}") for x in ("status", "reasons", "score", "title_score", "author_score", "year_score", "venue_score", "doi_exact")]
    return flatten(joined.select(*(F.col(v).alias(k) for k, v in fields.items()), *kept, *scores, F.current_timestamp().cast("string").alias("checked_at")))
