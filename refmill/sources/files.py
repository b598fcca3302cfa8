"""Input files: texts, gold sets, saved results, look-up caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refmill.functions.text import first_of
from refmill.operators import segment
from refmill.operators.fields import parse_citations
from refmill.operators.metrics import gold_label
from refmill.operators.review import FLAT, numbered

#: Columns that may hold the text and the label of a gold row, first that isn't empty; columns kept beside them.
TEXT_COLUMNS, LABEL_COLUMNS = ("citation", "citation_text", "reference", "raw_citation"), ("label", "ground_truth")
GOLD = ("record_id", "target_class", "mutation_type", "human_validation_status", "benchmark_split")
#: What a look-up gave: a provider's candidates by cache key.
CANDIDATE = "struct<provider:string,identifier:string,title:string,authors:array<string>,year:int,venue:string,doi:string,url:string>"
CACHE_SCHEMA = f"cache_key string, candidates array<{CANDIDATE}>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of .txt and .md files, one row each, without a byte order mark. Any other ending raises an error; PDF needs read_pdf_pages."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))
    known = F.lower("path").rlike(r"\.(txt|md)$")
    return rows.withColumn("text", F.when(known, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("unsupported input format: "), F.col("path")))))


def read_pdf_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, lines) of PDF files, where a PDF library can be imported; else an error says so."""
    from collections.abc import Iterator

    def pages(batches: Iterator) -> Iterator:
        import pandas as pd

        try:
            import pymupdf
        except ImportError as e:
            raise RuntimeError("reading PDF files needs pymupdf") from e
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"]):
                with pymupdf.open(stream=content, filetype="pdf") as doc:
                    rows += [(p, n, page.get_text("text").split("\n")) for n, page in enumerate(doc, 1)]
            yield pd.DataFrame(rows, columns=["path", "page", "lines"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(pages, "path string, page int, lines array<string>")


def citations_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """The references of texts with their fields and ordinal within each text."""
    refs = segment.references(segment.entries(segment.with_section(texts.select(key, text), text), [key]), [key])
    rows = parse_citations(refs, "raw", "flags")
    from pyspark.sql import Window

    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy("entry", "piece"))).drop("entry", "piece", "flags")


def gold_records(rows: DataFrame) -> DataFrame:
    """(citation, label, record_id, target_class, mutation_type, human_validation_status, benchmark_split) of rows with any of the usual column names. A row without text or known label raises an error."""
    have = lambda names: [F.col(c).cast("string") for c in names if c in rows.columns] or [F.lit("")]
    citation, label = F.trim(first_of(*have(TEXT_COLUMNS))), gold_label(first_of(*have(LABEL_COLUMNS)))
    bad = (citation == "") | label.isNull()
    checked: Column = F.when(bad, F.raise_error(F.concat(F.lit("gold row needs a text and a label valid or invalid: "), citation))).otherwise(label)
    extra = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) if c in rows.columns else F.lit("").alias(c) for c in GOLD]
    keep = [c for c in ("row_id", "ordinal") if c in rows.columns]
    return rows.select(*keep, citation.alias("citation"), checked.alias("label"), *extra)


def read_gold_csv(spark: SparkSession, path: str) -> DataFrame:
    """gold_records() of a CSV file with a header, a byte order mark or none, with ordinal by place in the file."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn("at_", F.monotonically_increasing_id())
    rows = rows.toDF(*(c.removeprefix("﻿") for c in rows.columns))
    return gold_records(numbered(rows, "at_").drop("at_"))


def read_saved_results(spark: SparkSession, path: str) -> DataFrame:
    """The flat rows of a JSON file: a list, or an object with a list called results. Columns it lacks are null."""
    rows = spark.read.json(path, multiLine=True)
    if "results" in rows.columns:
        rows = rows.select(F.explode("results").alias("r")).select("r.*")
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in FLAT))


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The look-up cache at path, empty if there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.read.schema(CACHE_SCHEMA).parquet(path)
    return spark.createDataFrame([], T._parse_datatype_string(CACHE_SCHEMA))


def citations_from_gold(records: DataFrame) -> DataFrame:
    """The fields of each gold record's text."""
    return parse_citations(records, "citation")


