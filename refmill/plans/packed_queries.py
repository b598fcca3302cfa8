"""Queries over the packed fields of verification_results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from refmill.operators.packed import packed_flag_counts, split_packed
from refmill.session import table

#: The packed fields and the kind of grammar each needs.
PACKED_FIELDS = {"parsed_authors": "names", "reasons": "codes", "parse_flags": "codes", "provider_errors": "messages"}


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_packed(table(spark, sf_dir, "verification_results"), "result_id", PACKED_FIELDS)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).select("result_id", "field_name", "pos", "item")


def p2_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_flag_counts(_values(spark, sf_dir))


QUERIES = {"p2_found": p2_found, "p2_flags": p2_flags}
ORACLES: dict[str, str] = {}
