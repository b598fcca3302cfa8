"""python -m refmill verify|benchmark: audits texts, or a gold set, against tables of registry records."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from refmill.operators.decide import MARGIN, THRESHOLD
from refmill.operators.review import flatten, replay
from refmill.plans.audit import audit_parsed
from refmill.session import cut
from refmill.sinks import reports
from refmill.sources import files


def _settings(args: argparse.Namespace) -> dict[str, float]:
    if not 0 < args.threshold <= 1 or not 0 <= args.margin < args.threshold:
        raise SystemExit("the threshold must be above 0 and at most 1, the margin at least 0 and below it")
    return {"threshold": args.threshold, "margin": args.margin}


def verify(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = files.citations_of(files.read_texts(spark, args.path), "path", "text").withColumn("id_", F.xxhash64("path", "ordinal"))
    if rows.isEmpty():
        raise SystemExit("no references found")
    flat = cut(audit_parsed(rows, spark.read.parquet(args.records), "id_", **_settings(args)))
    for write in (reports.write_csv, reports.write_json, reports.write_html):
        write(flat.orderBy("ordinal"), args.out)
    reports.show_summary(flat)


def benchmark(spark: SparkSession, args: argparse.Namespace) -> None:
    gold = cut(files.read_gold_csv(spark, args.path))
    if args.reuse_results:
        flat = flatten(replay(gold, files.read_saved_results(spark, args.reuse_results)))
    else:
        flat = audit_parsed(files.citations_from_gold(gold.select("ordinal", "citation")).drop("citation"), spark.read.parquet(args.records), "ordinal", **_settings(args))
    flat = cut(flat.withColumn("ordinal", F.col("ordinal").cast("int")))
    reports.write_json(flat.orderBy("ordinal"), args.out)
    reports.write_csv(flat.orderBy("ordinal"), args.out)
    reports.write_predictions(gold, flat, args.out)
    reports.write_metrics(gold.select("ordinal", "label", "mutation_type").join(flat.select("ordinal", "status"), "ordinal"), args.out)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="refmill", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for run in (verify, benchmark):
        p = commands.add_parser(run.__name__)
        p.add_argument("path", help="texts to audit" if run is verify else "gold set as CSV")
        p.add_argument("--records", help="Parquet table of registry records")
        p.add_argument("--out", default="bench_out")
        p.add_argument("--threshold", type=float, default=THRESHOLD)
        p.add_argument("--margin", type=float, default=MARGIN)
        if run is benchmark:
            p.add_argument("--reuse-results", help="saved results to decide anew, without look-ups")
        p.set_defaults(run=run)
    args = parser.parse_args(argv)
    args.run(SparkSession.builder.getOrCreate(), args)
