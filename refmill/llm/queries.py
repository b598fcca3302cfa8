"""Queries of the llm subpackage, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from refmill.llm.copies import collapse, copies, copy_counts
from refmill.llm.linkage import SURE, link, records
from refmill.llm.lookalike import lookalike_groups, skeletons, with_standins
from refmill.llm.mixing import mix
from refmill.llm.names import link_names, name_mentions
from refmill.llm.overlap import cross_split_pairs, overlap_report
from refmill.llm.subjects import subjects_of, train
from refmill.llm.tokens import encode_texts, token_counts
from refmill.llm.truncation import truncated, truncation_rates
from refmill.session import table


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = records(table(spark, sf_dir, "citations"), "citation", "citation_id", "title", "raw", "authors", "year", "doi", "venue")
    held = records(table(spark, sf_dir, "provider_candidates"), "candidate", "candidate_id", "title", None, "authors", "year", "doi", "venue")
    return link(cited, held)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).where(f"confidence >= {SURE}").select("citation_id", "candidate_id")


def p1_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair that was judged, those below a match too."""
    return _linked(spark, sf_dir)


def _looks(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = skeletons(table(spark, sf_dir, "citations"), "citation", "citation_id", "raw")
    return raw.unionByName(skeletons(table(spark, sf_dir, "provider_candidates"), "candidate", "candidate_id", "title"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_standins(_looks(spark, sf_dir))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_groups(_looks(spark, sf_dir))


def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(table(spark, sf_dir, "citations"), "citation_id", "source", ["raw", "title"])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cuts(spark, sf_dir).where("reason is not null").selectExpr("id AS citation_id", "field AS field_name")


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation_rates(_cuts(spark, sf_dir))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = name_mentions(table(spark, sf_dir, "citations"), "citation", "citation_id", ["authors"], ["venue"])
    held = name_mentions(table(spark, sf_dir, "provider_candidates"), "candidate", "candidate_id", ["authors"], [])
    return link_names(cited.unionByName(held), table(spark, sf_dir, "name_authority"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).where("name <> preferred_name").select("record_kind", "record_id", "field_name", "pos", "entity_id")


def p5_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entity_id, preferred_name, n_mentions, n_spellings) of each entity met."""
    named = _named(spark, sf_dir)
    spellings = named.groupBy("entity_id", "preferred_name", "name").count()
    return spellings.groupBy("entity_id", "preferred_name").agg({"count": "sum", "name": "count"}).withColumnsRenamed({"sum(count)": "n_mentions", "count(name)": "n_spellings"})


def _collapsed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return collapse(
        {
            "benchmark_records": (table(spark, sf_dir, "benchmark_records"), "row_id", "citation"),
            "citations": (table(spark, sf_dir, "citations"), "citation_id", "raw"),
        }
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(*_collapsed(spark, sf_dir))


def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_counts(_collapsed(spark, sf_dir)[1])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_split_pairs(table(spark, sf_dir, "benchmark_records"), "row_id", "citation", "benchmark_split")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_report(table(spark, sf_dir, "benchmark_records"), p7_found(spark, sf_dir), "row_id", "benchmark_split", ["source", "mutation_type"])


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(table(spark, sf_dir, "documents"), "doc_id", "text")


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = token_counts(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "text")
    return mix(docs, "doc_id", "source", "n_tokens", table(spark, sf_dir, "mix_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    areas = sorted(r.subject for r in table(spark, sf_dir, "subject_areas").select("subject").where("subject is not null").distinct().collect())
    model = train(docs, table(spark, sf_dir, "subject_labels"), areas, "doc_id", "text", "source")
    return subjects_of(docs, model, "doc_id", "text", "source")


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_found(spark, sf_dir).groupBy("subject").count().withColumnRenamed("count", "n_documents")


QUERIES = {"p1_found": p1_found, "p1_confidence": p1_confidence, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_rates": p4_rates, "p5_found": p5_found, "p5_variants": p5_variants, "p6_found": p6_found, "p6_counts": p6_counts, "p7_found": p7_found, "p7_report": p7_report, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_composition": p10_composition}
