"""Visually identical text with different characters: confusables skeletons."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refmill.llm.text import plainly, skeleton, standins

_SCHEMA = "record_kind string, record_id bigint, skeleton_id binary, text_id binary, n_standins int"
#: Characters asked for at once when the table of prototypes is read.
_PART = 4_000


@lru_cache(maxsize=1)
def _prototypes(app: str) -> dict[str, str]:
    jvm = SparkSession.getActiveSession().sparkContext._jvm
    checker = jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    chars = [c for c in map(chr, [*range(0x21, 0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x20000)]) if unicodedata.category(c) not in ("Cn", "Cs", "Co", "Zl", "Zp", "Cc")]
    out = {}
    for at in range(0, len(chars), _PART):
        part = chars[at : at + _PART]
        got = checker.getSkeleton("\n".join(part)).split("\n")
        if len(got) != len(part):
            got = [checker.getSkeleton(c) for c in part]
        out |= {c: g for c, g in zip(part, got) if g != unicodedata.normalize("NFD", c)}
    return out


def prototypes(spark: SparkSession) -> dict[str, str]:
    """The whole public table of confusable characters, as the Unicode library that Spark ships with holds it: each character that has one, with its prototype. Its size is that of Unicode."""
    return _prototypes(spark.sparkContext.applicationId)


def skeletons(df: DataFrame, kind: str, key: str, text: str) -> DataFrame:
    """(record_kind, record_id, skeleton_id, text_id, n_standins) for each text that isn't null.

    skeleton_id and text_id are 128-bit hashes of the skeleton and of the text as it stands: rows of equal
    skeleton_id look the same, those of one text_id are the same. n_standins counts the characters that stand
    in for a plain one or can't be seen; they are looked for only in texts whose skeleton isn't what plain
    characters would give, or whose accents stand apart from their letters. Empty texts have the empty skeleton; a text of any length is read whole; nulls give no
    row; equal rows each give their own. Other columns play no part.
    """
    sent = df.sparkSession.sparkContext.broadcast(prototypes(df.sparkSession))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        ascii_ = str.maketrans({c: p for c, p in table.items() if c < "\x80"} | {c: " " for c in "\t\n\v\f\r"})
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids, own, counts = [], [], []
            for t in texts:
                if t.isascii() and (t.isprintable() or not any(c < " " and c not in "\t\n\v\f\r" or c == "\x7f" for c in t)):
                    look, candidate = t.translate(ascii_), False
                else:
                    look = skeleton(t, table)
                    candidate = look != plainly(t, table) or not unicodedata.is_normalized("NFC", t)
                ids.append(xxhash.xxh3_128_digest(look.encode("utf-8", "surrogatepass")))
                own.append(xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")))
                counts.append(len(standins(t, table)) if candidate else 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(texts), pa.string()), batch.column(0), pa.array(ids, pa.binary()), pa.array(own, pa.binary()), pa.array(counts, pa.int32())],
                names=["record_kind", "record_id", "skeleton_id", "text_id", "n_standins"],
            )

    rows = df.select(F.col(key).cast("bigint").alias("record_id"), F.col(text).alias("text")).where("text is not null")
    return rows.mapInArrow(run, _SCHEMA)


def lookalike_groups(rows: DataFrame) -> DataFrame:
    """(record_kind, skeleton_id, n_rows, n_texts, first_id): per skeleton with more than one text, how many rows and texts it has.

    Counts are taken first by text, with map-side combining, then by skeleton: copies of one text never meet in one task.
    """
    texts = rows.groupBy("record_kind", "skeleton_id", "text_id").agg(F.count(F.lit(1)).alias("n"), F.min("record_id").alias("first_id"))
    return (
        texts.groupBy("record_kind", "skeleton_id")
        .agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_texts"), F.min("first_id").alias("first_id"))
        .where("n_texts > 1")
        .select("record_kind", F.hex("skeleton_id").alias("skeleton_id"), "n_rows", "n_texts", "first_id")
    )


def with_standins(rows: DataFrame) -> DataFrame:
    """(record_kind, record_id) of the texts with a stand-in or unseen character."""
    return rows.where("n_standins > 0").select("record_kind", "record_id")
