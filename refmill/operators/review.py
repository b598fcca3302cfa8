"""Saved results: the flat form, search, reviewers' edits, and replay of decisions on saved evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refmill.functions import text as T
from refmill.functions.predicates import is_accepted
from refmill.operators import decide, scoring
from refmill.operators.fields import parse_citations
from refmill.session import cut

#: The columns of a saved result, in order; those shown in a review; those of a table of predictions.
FLAT = (
    "ordinal", "source_page", "source_end_page", "parse_flags", "raw_citation", "parsed_title", "parsed_authors", "parsed_year", "parsed_venue", "parsed_doi", "parsed_url", "citation_type",
    "parse_confidence", "status", "score", "provider", "matched_title", "matched_authors", "matched_year", "matched_venue", "matched_doi", "matched_url", "title_score", "author_score",
    "year_score", "venue_score", "doi_exact", "reasons", "provider_errors", "checked_at", "reviewer_decision", "reviewer_note",
)
VISIBLE = ("ordinal", "source_page", "citation_type", "status", "score", "raw_citation", "matched_title", "matched_doi", "reasons", "reviewer_decision", "reviewer_note")
PREDICTION = (
    "record_id", "label", "target_class", "mutation_type", "human_validation_status", "benchmark_split", "ordinal", "status", "auto_accepted", "correct_binary_decision", "score", "parsed_title",
    "parsed_doi", "matched_title", "matched_doi", "title_score", "author_score", "year_score", "doi_exact", "reasons", "provider_errors", "raw_citation",
)
SEARCHED = ("raw_citation", "parsed_title", "matched_title", "matched_doi", "reasons")
DECISIONS = ("pending", "accept_valid", "confirm_flag", "override_valid")


def flatten(results: DataFrame) -> DataFrame:
    """Results in the flat form: lists joined, scores rounded to 4, columns it lacks null ("" for text)."""
    def one(name: str) -> Column:
        if name not in results.columns:
            return F.lit(None).cast("string").alias(name) if name not in ("reviewer_decision",) else F.lit("pending").alias(name)
        kind = results.schema[name].dataType.simpleString()
        mark = " | " if name in ("parse_flags", "reasons", "provider_errors") else "; "
        return F.array_join(F.col(name), mark).alias(name) if kind.startswith("array") else T.round4(F.col(name)).alias(name) if kind == "double" else F.col(name)

    return results.select(*(one(c) for c in FLAT))


def search(results: DataFrame, words: str = "", statuses: list[str] | None = None, kind: str | None = None, fields: tuple[str, ...] = SEARCHED) -> DataFrame:
    """Results that hold words in one of the fields, joined by blanks, without regard to case; of the statuses and kind asked for, where any are."""
    out = results
    if kind and kind != "All":
        out = out.where(F.col("citation_type") == kind)
    if statuses:
        out = out.where(F.col("status").isin(*statuses))
    if words.strip():
        out = out.where(F.contains(F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in fields))), F.lit(words.strip().lower())))
    return out


def options(results: DataFrame, column: str) -> DataFrame:
    return results.select(column).distinct().orderBy(column)


def apply_edits(results: DataFrame, edits: DataFrame, key: str) -> DataFrame:
    """results with reviewer_decision and reviewer_note of edits (key, reviewer_decision, reviewer_note), one row per key, where there are any; a null note is ""."""
    new = edits.select(key, F.col("reviewer_decision").alias("d_"), F.coalesce("reviewer_note", F.lit("")).alias("n_"), F.lit(True).alias("e_"))
    out = results.join(new, key, "left")
    return out.withColumns({"reviewer_decision": F.coalesce("d_", "reviewer_decision"), "reviewer_note": F.when(F.col("e_"), F.col("n_")).otherwise(F.col("reviewer_note"))}).drop("d_", "n_", "e_")


def predictions(records: DataFrame, results: DataFrame, on: str = "ordinal") -> DataFrame:
    """One row per gold record with its result: whether it was accepted and whether that is right."""
    accepted = F.coalesce(is_accepted(F.col("status")), F.lit(False))
    rows = records.join(results, on).withColumns({"auto_accepted": accepted, "correct_binary_decision": accepted == (F.col("label") == "valid")})
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in PREDICTION))


def from_flat(rows: DataFrame) -> DataFrame:
    """Flat rows as typed fields: numbers and lists read, an unknown kind as unknown, an empty status as error; has_candidate and has_scores tell what was saved."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    numbers = {c: T.optional_int(s(c)) for c in ("ordinal", "source_page", "source_end_page", "parsed_year", "matched_year")}
    numbers |= {c: T.optional_double(s(c)) for c in ("title_score", "author_score", "year_score", "venue_score")}
    numbers |= {c: F.coalesce(T.optional_double(s(c)), F.lit(0.0)) for c in ("score", "parse_confidence")}
    lists = {c: T.split_list(s(c), "|") for c in ("parse_flags", "reasons", "provider_errors")} | {c: T.split_list(s(c), ";") for c in ("parsed_authors", "matched_authors")}
    kinds = {"citation_type": F.when(s("citation_type").isin(*scoring.ROUTES), s("citation_type")).otherwise("unknown"), "status": T.first_of(s("status"), F.lit("error")), "doi_exact": T.optional_bool(s("doi_exact")), "reviewer_decision": T.first_of(s("reviewer_decision"), F.lit("pending"))}
    saved = F.lit(False)
    for c in ("title_score", "author_score", "year_score", "venue_score", "doi_exact"):
        saved = saved | (s(c) != "")
    rows = rows.withColumns({"has_scores": saved, "has_candidate": s("provider") != ""})
    plain = {c: s(c) for c in ("raw_citation", "parsed_title", "parsed_venue", "parsed_doi", "parsed_url", "provider", "matched_title", "matched_venue", "matched_doi", "matched_url")}
    return rows.withColumns(numbers | lists | kinds | plain)


def rescore(rows: DataFrame) -> DataFrame:
    """from_flat() rows with those of an exact DOI and a candidate scored and decided anew; all others as saved. The mismatch is dropped and the score lifted where the DOI is verified."""
    side = lambda p, names: {p + "title": F.when(F.col(names[0]) != "", T.normalize_text(F.col(names[0]))), p + "names": T.surnames(F.col(names[1])), p + "year": F.col(names[2]), p + "venue": F.when(F.col(names[3]) != "", T.normalize_text(F.col(names[3]))), p + "doi": T.normalize_doi(F.col(names[4]))}
    made = side("c_", [f"parsed_{x}" for x in ("title", "authors", "year", "venue", "doi")]) | side("p_", [f"matched_{x}" for x in ("title", "authors", "year", "venue", "doi")])
    parts = ("title_score", "author_score", "year_score", "venue_score", "doi_exact")
    old = {f"old_{c}": F.col(c) for c in parts}
    again = F.col("has_scores") & F.col("has_candidate") & F.coalesce(F.col("old_doi_exact"), F.lit(False))
    new = scoring.score_pairs(rows.withColumns(old | made | {"raw_norm": T.normalize_text(F.col("raw_citation"))}))
    new = new.withColumn("said_", decide.by_exact_doi())
    sure = F.col("said_.status") == "verified"
    reasons = F.array_compact(F.array(F.when(~(sure & (F.col("match_reason") == "DOI_METADATA_MISMATCH")), F.col("match_reason")), F.col("said_.reason")))
    out = new.withColumns(
        {
            "status": F.when(again, F.col("said_.status")).otherwise(F.col("status")),
            "score": F.when(again, F.when(sure, F.greatest("overall", F.lit(0.95))).otherwise(F.col("overall"))).otherwise(F.col("score")),
            "reasons": F.when(again, reasons).otherwise(F.col("reasons")),
        }
        | {c: F.when(again, F.col(c)).otherwise(F.col(f"old_{c}")) for c in parts}
    )
    return out.drop(*old, *made, "raw_norm", "said_", "match_reason", "overall")


def replay(records: DataFrame, saved: DataFrame) -> DataFrame:
    """rescore() of saved flat rows that belong to gold records (ordinal, citation), one to one by ordinal; any row without its partner, or with another text, raises an error."""
    expected = parse_citations(records.select("ordinal", "citation"), "citation").select("ordinal", F.trim("raw_citation").alias("expected_"))
    rows = from_flat(saved).join(expected, "ordinal", "full")
    bad = F.coalesce(F.col("expected_") != F.trim("raw_citation"), F.lit(True))
    rows = rows.withColumn("ordinal", F.when(bad, F.raise_error(F.lit("a saved result does not match its gold record")).cast("int")).otherwise(F.col("ordinal")))
    return rescore(rows.drop("expected_"))


def numbered(df: DataFrame, key: str) -> DataFrame:
    """df with ordinal, the place of each row by key from 1: rows are sorted in ranges, and each range adds the sizes of those before it."""
    sorted_ = cut(df.repartitionByRange(key).withColumn("range_", F.spark_partition_id()))
    sizes = sorted_.groupBy("range_").agg(F.count(F.lit(1)).alias("n_"))
    # one row per range: their number doesn't grow with the rows
    before = sizes.withColumn("before_", F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_")
    place = F.row_number().over(Window.partitionBy("range_").orderBy(key))
    return sorted_.withColumn("place_", place).join(F.broadcast(before), "range_").withColumn("ordinal", (F.col("before_") + F.col("place_")).cast("int")).drop("range_", "place_", "before_")
