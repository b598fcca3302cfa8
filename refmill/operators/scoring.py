"""Scores of citation and candidate pairs, look-up of candidates, and the best of each citation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refmill.functions.text import normalize_doi, normalize_text, similarity, surnames
from refmill.session import cut

#: Weights of the parts of a score, caps and floor by DOI, and where title and authors contradict one.
WEIGHTS = {"title": 0.65, "author": 0.20, "year": 0.10, "venue": 0.05}
CONTRADICTED, CONFIRMED, OTHER_DOI = 0.70, 0.95, 0.75
LOW_TITLE, LOW_AUTHOR = 0.72, 0.45
#: Which providers are asked for which kind of work, in order; web only for works with a URL.
ROUTES = {"web_policy": ("web",), "book_thesis": ("crossref", "openalex", "web"), "scholarly": ("crossref", "openalex", "pubmed"), "unknown": ("crossref", "openalex", "web")}


def year_score(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), None).when(a == b, 1.0).when(F.abs(a - b) == 1, 0.55).otherwise(0.0)


def text_score(a: Column, b: Column) -> Column:
    """Similarity of two normalized texts, null if either is null: the field was empty."""
    return F.when(a.isNull() | b.isNull(), None).otherwise(similarity(a, b))


def author_score(cited: Column, held: Column) -> Column:
    """Of lists of surnames: each cited one's best similarity, the first's weighing 0.6 and their mean 0.4; null if either list is empty."""
    best = F.transform(cited, lambda e: F.array_max(F.transform(held, lambda a: similarity(e, a))))
    mean = F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(best)
    return F.when((F.size(cited) > 0) & (F.size(held) > 0), F.least(F.lit(1.0), 0.6 * F.get(best, F.lit(0)) + 0.4 * mean))


def comparable(df: DataFrame, keep: list[str], prefix: str) -> DataFrame:
    """keep, with the fields of a citation or candidate as they are compared, each normalized once per row: prefix with title, venue (null if empty), names, year, doi."""
    text = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", normalize_text(F.col(c)))
    made = {"title": text("title"), "venue": text("venue"), "names": surnames(F.col("authors")), "year": F.col("year"), "doi": normalize_doi(F.col("doi"))}
    return df.select(*keep, *(c.alias(prefix + k) for k, c in made.items()))


def score_pairs(pairs: DataFrame) -> DataFrame:
    """pairs of comparable() rows (c_ and p_) with title_score, author_score, year_score, venue_score, doi_exact, match_reason and overall.

    Parts that can't be compared are null and count 0; weights aren't spread over the others. doi_exact is null if the
    citation has no DOI.
    """
    c = lambda k: F.col("c_" + k)
    p = lambda k: F.col("p_" + k)
    rows = pairs.withColumns({"title_score": text_score(c("title"), p("title")), "author_score": author_score(c("names"), p("names")), "year_score": year_score(c("year"), p("year")), "venue_score": text_score(c("venue"), p("venue"))})
    total = sum(F.coalesce(F.col(f"{k}_score"), F.lit(0.0)) * w for k, w in WEIGHTS.items())
    exact = F.when(c("doi") != "", c("doi") == p("doi"))
    against = F.coalesce(F.col("title_score") < LOW_TITLE, F.lit(False)) | F.coalesce(F.col("author_score") < LOW_AUTHOR, F.lit(False))
    rows = rows.withColumn("doi_exact", exact)
    reason = F.when(F.col("doi_exact") & against, "DOI_METADATA_MISMATCH").when(F.col("doi_exact"), "DOI_EXACT_MATCH").when((F.col("doi_exact") == False) & (p("doi") != ""), "DOI_MISMATCH")  # noqa: E712
    rows = rows.withColumns({"match_reason": reason, "sum_": total})
    capped = F.when(F.col("match_reason") == "DOI_METADATA_MISMATCH", F.least("sum_", F.lit(CONTRADICTED))).when(F.col("match_reason") == "DOI_EXACT_MATCH", F.greatest("sum_", F.lit(CONFIRMED))).when(F.col("match_reason") == "DOI_MISMATCH", F.least("sum_", F.lit(OTHER_DOI))).otherwise(F.col("sum_"))
    return rows.withColumn("overall", F.round(capped, 6)).drop("sum_")


def doi_pairs(cited: DataFrame, held: DataFrame) -> DataFrame:
    """Pairs of comparable() rows with one DOI, however written; a plain equi-join, empty DOIs meet nothing."""
    return cited.where("c_doi <> ''").join(held.where("p_doi <> ''"), F.col("c_doi") == F.col("p_doi"))


# Look-up by title -------------------------------------------------------------------------------------------------


def title_search(cited: DataFrame, held: DataFrame, ckey: str, pkey: str, by: list[str], k: int = 5, least: float = 0.5) -> DataFrame:
    """(ckey, *by, pkey, jaccard, place): for each citation and value of the columns `by` of held the k records whose titles share the largest part of all words, at least `least`, ties by pkey.

    Titles are compared once each, however many rows have them. Each title is looked up under every two of its rarest
    words only: of n words the first n - ceil(least * n) + 2, of which two titles of that likeness share two, so nothing is
    lost and frequent words bring no pairs together. Titles so short that they may share but one are looked up under each. Of records with one title the first k are ranked. Empty titles find nothing.
    """
    words = lambda df, side: df.select(F.col(f"{side}_title").alias("t")).where("t is not null and t <> ''").distinct().withColumn("w", F.array_distinct(F.split("t", " ")))
    ct, pt = words(cited, "c"), words(held, "p")
    df = pt.select(F.explode("w").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))

    def keys(titles: DataFrame, name: str) -> DataFrame:
        ranked = titles.select("t", F.size("w").alias("m"), F.explode("w").alias("x")).join(df, "x", "left")
        ordered = ranked.groupBy("t", "m").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "x"))).alias("o"))
        rare = F.transform(F.slice("o", F.lit(1), (F.col("m") - F.ceil(F.col("m") * least) + 2).cast("int")), lambda o: o["x"])
        two = F.flatten(F.transform(rare, lambda x: F.transform(F.filter(rare, lambda y: y > x), lambda y: F.xxhash64(x, y))))
        alone = F.when(F.col("m") <= 1 / least, F.transform(rare, lambda x: F.xxhash64(x))).otherwise(F.array().cast("array<bigint>"))
        return ordered.select(F.col("t").alias(name), F.explode(F.concat(two, alone)).alias("x"))

    # written, lest the likeness be worked out for every key two titles share instead of once
    met = cut(keys(ct, "ct").join(keys(pt, "pt"), "x").select("ct", "pt").distinct())
    shared = F.size(F.array_intersect(F.split("ct", " "), F.split("pt", " ")))
    either = F.size(F.array_union(F.split("ct", " "), F.split("pt", " ")))
    scored = met.withColumn("jaccard", F.round(shared / either, 6)).where(F.col("jaccard") >= least)
    each = Window.partitionBy("pt", *by).orderBy(pkey)
    records = held.select(pkey, *by, F.col("p_title").alias("pt")).where("pt <> ''").withColumn("n", F.row_number().over(each)).where(F.col("n") <= k).drop("n")
    ranked = Window.partitionBy("ct", *by).orderBy(F.col("jaccard").desc(), pkey)
    found = scored.join(records, "pt").withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= k)
    return cited.select(ckey, F.col("c_title").alias("ct")).join(found, "ct").select(ckey, *by, pkey, "jaccard", "place")


# Ranking ----------------------------------------------------------------------------------------------------------


def with_route(df: DataFrame, kind: str = "citation_type", url: str = "url") -> DataFrame:
    """df with route: the providers asked for the row, in order; an unknown kind is taken as unknown."""
    has_url = F.coalesce(F.col(url), F.lit("")) != ""
    out = None
    for name, providers in ROUTES.items():
        asked = F.array(*(F.lit(p) for p in providers))
        asked = asked if name == "web_policy" else F.when(has_url, asked).otherwise(F.array_remove(asked, "web"))
        if name != "unknown":
            out = F.when(F.col(kind) == name, asked) if out is None else out.when(F.col(kind) == name, asked)
        else:
            out = out.otherwise(asked)
    return df.withColumn("route", out)


def best_evidence(scored: DataFrame, key: str, payload: list[str], threshold: float = 0.85) -> DataFrame:
    """(key, payload, early): of scored pairs (key, provider_rank, candidate_id, overall, payload) the best of each citation, ties by the order in which providers and records come.

    The first provider asked (rank 0) decides alone if its best reaches the threshold: early tells so. One aggregate
    with map-side combining over a struct that has no ties, no window.
    """
    order = F.struct("overall", (-F.col("provider_rank")).alias("r"), (-F.col("candidate_id")).alias("i"), *payload)
    got = scored.groupBy(key).agg(F.max(order).alias("any"), F.max(F.when(F.col("provider_rank") == 0, order)).alias("first"))
    early = F.coalesce(F.col("first.overall") >= threshold, F.lit(False))
    out = got.select(key, early.alias("early"), F.when(early, F.col("first")).otherwise(F.col("any")).alias("b"))
    return out.select(key, "early", (-F.col("b.i")).alias("candidate_id"), F.col("b.overall").alias("overall"), *(f"b.{c}" for c in payload))


def first_per(df: DataFrame, key: str, value: Column, payload: list[str]) -> DataFrame:
    """(key, payload): of each key the row whose value, a struct without ties, is the greatest; one aggregate."""
    return df.groupBy(key).agg(F.max_by(F.struct(*payload), value).alias("b")).select(key, "b.*")
