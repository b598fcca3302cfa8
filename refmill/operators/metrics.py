"""Counts and quality measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refmill.functions.predicates import is_accepted
from refmill.functions.text import safe_divide

#: Spellings of gold labels, and the statuses a summary counts, in its order.
VALID, INVALID = ("valid", "true", "1", "genuine", "verified"), ("invalid", "false", "0", "fake", "ghost", "hallucinated")
STATUSES = (
    "verified", "web_validated", "grey_literature_validated", "web_reachable", "web_access_restricted", "identifier_verified_parse_uncertain", "review", "not_found", "metadata_mismatch",
    "potential_hallucination", "conflict", "parse_error", "flagged", "error",
)
#: Groups in which statuses are shown.
GROUPS = {
    "Confirmed": ("verified", "web_validated", "grey_literature_validated"),
    "Review": ("review", "identifier_verified_parse_uncertain", "web_reachable", "web_access_restricted", "not_found"),
    "Conflict": ("metadata_mismatch", "potential_hallucination", "conflict", "flagged"),
    "Technical": ("parse_error", "error"),
}


def gold_label(c: Column) -> Column:
    """valid or invalid, null for any other spelling."""
    word = F.lower(F.trim(c))
    return F.when(word.isin(*VALID), "valid").when(word.isin(*INVALID), "invalid")


def summarize(results: DataFrame) -> DataFrame:
    """One row: total, auto_confirmed, a count of each status, needs_action and verified_rate; zeros for no rows. One aggregate."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    rows = results.agg(F.count(F.lit(1)).alias("total"), F.count_if(is_accepted(F.col("status"))).alias("auto_confirmed"), *counts)
    return rows.withColumns({"needs_action": F.col("total") - F.col("auto_confirmed"), "verified_rate": F.round(safe_divide(F.col("auto_confirmed"), F.col("total")), 4)})


def overview(results: DataFrame) -> DataFrame:
    """One row: total, confirmed, review, conflict and technical, the figures at the head of a review."""
    s = summarize(results)
    return s.select(
        "total", F.col("auto_confirmed").alias("confirmed"), F.col("needs_action").alias("review"),
        (F.col("metadata_mismatch") + F.col("potential_hallucination")).alias("conflict"), (F.col("parse_error") + F.col("error")).alias("technical"),
    )


def status_group(status: Column) -> Column:
    out = None
    for name, members in GROUPS.items():
        out = F.when(status.isin(*members), name) if out is None else out.when(status.isin(*members), name)
    return out


def confusion(df: DataFrame, truth: Column, accepted: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, tn, fn of accepted against truth, with precision, recall and f1 rounded to 6, 0 where they aren't defined; rows with a null truth don't count."""
    rows = df.withColumns({"t_": truth, "a_": F.coalesce(accepted, F.lit(False))}).where("t_ is not null")
    t, a = F.col("t_"), F.col("a_")
    out = rows.groupBy(*(by or [])).agg(F.count_if(t & a).alias("tp"), F.count_if(~t & a).alias("fp"), F.count_if(~t & ~a).alias("tn"), F.count_if(t & ~a).alias("fn"))
    return out.withColumns({k: F.round(v, 6) for k, v in zip(("precision", "recall", "f1"), _prf("tp", "fp", "fn"))})


def _prf(hit: str, wrong: str, missed: str) -> tuple[Column, Column, Column]:
    p, r = safe_divide(F.col(hit), F.col(hit) + F.col(wrong)), safe_divide(F.col(hit), F.col(hit) + F.col(missed))
    return p, r, safe_divide(2 * p * r, p + r)


def quality(judged: DataFrame) -> DataFrame:
    """One row of measures of judged rows (label, status): counts, precision, recall and F1 of valid rows and of invalid ones found, rates. Rows of status error stand aside."""
    t, a, e = F.col("label") == "valid", is_accepted(F.col("status")), F.col("status") == "error"
    n = judged.agg(
        F.count(F.lit(1)).alias("dataset_total"), F.count_if(t).alias("dataset_valid"), F.count_if(t & a & ~e).alias("tp_valid"), F.count_if(~t & a & ~e).alias("fp_invalid_accepted"),
        F.count_if(~t & ~a & ~e).alias("tn_invalid_flagged"), F.count_if(t & ~a & ~e).alias("fn_valid_flagged"), F.count_if(e).alias("excluded_errors"),
    )
    tn, total = F.col("tn_invalid_flagged"), F.col("dataset_total")
    made = dict(zip(("precision_valid", "recall_valid", "f1_valid"), _prf("tp_valid", "fp_invalid_accepted", "fn_valid_flagged")))
    made |= zip(("precision_ghost_detection", "recall_ghost_detection", "f1_ghost_detection"), _prf("tn_invalid_flagged", "fn_valid_flagged", "fp_invalid_accepted"))
    made |= {"invalid_prevalence": safe_divide(total - F.col("dataset_valid"), total), "hallucination_rate": safe_divide(tn, total - F.col("excluded_errors")), "correctly_flagged_invalid_share": safe_divide(tn, total - F.col("excluded_errors"))}
    return n.withColumn("dataset_invalid", total - F.col("dataset_valid")).withColumns({k: F.round(v, 6) for k, v in made.items()})


def status_by_truth(judged: DataFrame) -> DataFrame:
    return judged.groupBy("label", "status").agg(F.count(F.lit(1)).alias("n"))


def by_mutation(judged: DataFrame) -> DataFrame:
    """Per kind of change: total, auto_accepted, needs_review, errors and the rates of the first two among those without error. An unnamed kind is none of valid rows, else unspecified."""
    kind = F.coalesce(F.nullif(F.trim("mutation_type"), F.lit("")), F.when(F.col("label") == "valid", "none").otherwise("unspecified"))
    error, ok = F.col("status") == "error", is_accepted(F.col("status"))
    out = judged.groupBy(kind.alias("mutation_type")).agg(F.count(F.lit(1)).alias("total"), F.count_if(ok & ~error).alias("auto_accepted"), F.count_if(~ok & ~error).alias("needs_review"), F.count_if(error).alias("errors"))
    rest = F.col("total") - F.col("errors")
    return out.withColumns({"auto_accept_rate": F.round(safe_divide(F.col("auto_accepted"), rest), 6), "review_rate": F.round(safe_divide(F.col("needs_review"), rest), 6)})
