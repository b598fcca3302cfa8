"""Results written out: tables for clusters, single files for people."""

from __future__ import annotations

import csv
import html
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refmill.operators.metrics import by_mutation, quality, status_by_truth, summarize
from refmill.operators.review import FLAT, PREDICTION, predictions

#: Columns of the report page and their headings.
REPORT = {"ordinal": "No.", "status": "Status", "score": "Score", "raw_citation": "Reference", "matched_title": "Best record", "matched_doi": "DOI", "reasons": "Why"}


def write_table(results: DataFrame, path: str, form: str = "parquet") -> None:
    """All results as a folder of files, written by every task; form is parquet, json or csv."""
    writer = results.write.mode("overwrite")
    (writer.option("header", True) if form == "csv" else writer).format(form).save(path)


def _csv(rows: DataFrame, columns: tuple[str, ...], path: str) -> str:
    """One CSV file with a byte order mark, row by row; an empty file for no rows."""
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        writer = None
        for row in rows.select(*columns).toLocalIterator():
            if writer is None:
                writer = csv.writer(f)
                writer.writerow(columns)
            writer.writerow(["" if v is None else v for v in row])
    if writer is None:
        open(path, "w").close()
    return path


def write_csv(flat: DataFrame, folder: str) -> str:
    os.makedirs(folder, exist_ok=True)
    return _csv(flat, FLAT, f"{folder}/results.csv")


def write_json(flat: DataFrame, folder: str) -> str:
    """One object with a summary and the rows, which are written as they come."""
    os.makedirs(folder, exist_ok=True)
    summary = summarize(flat).first().asDict()
    with open(f"{folder}/results.json", "w", encoding="utf-8") as f:
        f.write('{"summary": ' + json.dumps(summary, ensure_ascii=False, indent=2) + ', "results": [')
        for n, row in enumerate(flat.toLocalIterator()):
            f.write(("," if n else "") + "\n" + json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))
        f.write("\n]}\n")
    return f"{folder}/results.json"


def write_html(flat: DataFrame, folder: str) -> str:
    """A page with the summary and a table of results, all text escaped."""
    os.makedirs(folder, exist_ok=True)
    cell = lambda tag, x: f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>"
    summary = summarize(flat).first().asDict()
    with open(f"{folder}/report.html", "w", encoding="utf-8") as f:
        f.write('<!doctype html><html lang="en"><meta charset="utf-8"><title>References checked</title><h1>References checked</h1><dl>')
        f.write("".join(cell("dt", k) + cell("dd", v) for k, v in summary.items()))
        f.write("</dl><table><tr>" + "".join(cell("th", x) for x in REPORT.values()) + "</tr>")
        for row in flat.select(*REPORT).toLocalIterator():
            f.write("<tr>" + "".join(cell("td", f"{float(x):.3f}" if c == "score" and x else x) for c, x in zip(REPORT, row)) + "</tr>")
        f.write("</table></html>")
    return f"{folder}/report.html"


def write_predictions(records: DataFrame, flat: DataFrame, folder: str) -> str:
    os.makedirs(folder, exist_ok=True)
    return _csv(predictions(records, flat), PREDICTION, f"{folder}/predictions.csv")


def metrics_of(judged: DataFrame) -> dict:
    """All measures of judged rows (label, status, mutation_type) as one dictionary; a few rows for each reach the driver."""
    out = quality(judged).first().asDict()
    truth: dict = {}
    for r in status_by_truth(judged).orderBy("label", "status").collect():
        truth.setdefault(r.label, {})[r.status] = r.n
    return out | {"status_by_ground_truth": truth, "by_mutation_type": {r.mutation_type: {k: v for k, v in r.asDict().items() if k != "mutation_type"} for r in by_mutation(judged).orderBy("mutation_type").collect()}}


def write_metrics(judged: DataFrame, folder: str) -> str:
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/metrics.json", "w", encoding="utf-8") as f:
        json.dump(metrics_of(judged), f, ensure_ascii=False, indent=2)
    return f"{folder}/metrics.json"


def write_cache(entries: DataFrame, path: str) -> None:
    """New look-ups (cache_key, candidates) put to the cache at path; failed look-ups, null, aren't kept."""
    entries.where(F.col("candidates").isNotNull()).dropDuplicates(["cache_key"]).write.mode("append").parquet(path)


def show_summary(results: DataFrame) -> None:
    summarize(results).show(truncate=False, vertical=True)
