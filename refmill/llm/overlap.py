"""Same or near-same records across splits, by a suffix array over partitions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refmill.llm.copies import atoms
from refmill.llm.graph import components
from refmill.llm.text import plain, unescape
from refmill.session import cut

#: Characters of a suffix that are sorted, the shortest common prefix that counts as a shared span, and the
#: longest stretch without a suffix of its own where no word begins.
SUFFIX, SPAN, STRETCH = 64, 20, 12
#: Characters of the runs by which coverage of one text by another is measured.
RUN = 6
#: Two texts hold one reference if each is covered to this share, and not both lack a stretch of so many letters of
#: the other: a title replaced by another, or by a much shorter one, as in another script.
COVERED, TITLE, LONG_TITLE, SHORT_TITLE = 0.7, 16, 25, 10
_IDENTIFIER = re.compile(r"https?://\S+|\bdoi\b[:.\s]*10\S+|\b10\.\d{4,9}/\S+|\b10\d{5,}\S+|\b10\.\d{4,9}\S*")


def core(text: str) -> str:
    """Letters and digits of a reference without its identifiers, which may be changed or left out; all of them where nothing else is left."""
    t = plain(unescape(text))
    rest = "".join(ch for ch in _IDENTIFIER.sub(" ", t) if ch.isalnum())
    return rest if len(rest) >= SPAN else "".join(ch for ch in t if ch.isalnum())


def _cover(a: str, runs: set[str]) -> tuple[float, int]:
    n = len(a)
    marks = bytearray(n)
    one = b"\1" * RUN
    for i in range(n - RUN + 1):
        if a[i : i + RUN] in runs:
            marks[i : i + RUN] = one
    longest = at = 0
    for stretch in marks.split(b"\1"):
        if len(stretch) > longest:
            longest = max(longest, sum(ch.isalpha() for ch in a[at : at + len(stretch)]))
        at += len(stretch) + 1
    return sum(marks) / n, longest


def coverage(a: str, b: str) -> tuple[float, float, int, int]:
    """(share of a that b covers, share of b, letters of the longest stretch of a that b lacks, of b), shared spans merged; fields may stand in any order."""
    if a == b:
        return 1.0, 1.0, 0, 0
    if min(len(a), len(b)) < RUN:
        return 0.0, 0.0, len(a), len(b)
    ca, ra = _cover(a, {b[i : i + RUN] for i in range(len(b) - RUN + 1)})
    cb, rb = _cover(b, {a[i : i + RUN] for i in range(len(a) - RUN + 1)})
    return ca, cb, ra, rb


def same_reference(a: str, b: str) -> bool:
    """Whether the cores of two texts hold one reference but for form and small changes."""
    ca, cb, ra, rb = coverage(a, b)
    short, long = min(ra, rb), max(ra, rb)
    return min(ca, cb) >= COVERED and short < TITLE and not (long >= LONG_TITLE and short >= SHORT_TITLE)


def suffix_starts(edge: bytearray, n: int) -> list[int]:
    """Where suffixes begin: at words, and within stretches of STRETCH without one; not in the last SPAN - 1 characters."""
    out, last = [], 0
    for p in range(max(1, n - SPAN + 1)):
        if edge[p] or p - last >= STRETCH:
            out.append(p)
            last = p
    return out


def _texts(df: DataFrame, key: str, text: str, split: str) -> DataFrame:
    """(row_id, train, form, t, core, starts) of the rows with a split and a text with a letter or digit; t is their stream."""
    name = F.lower(F.trim(F.col(split)))
    rows = df.select(F.col(key).cast("bigint").alias("row_id"), (name == "train").alias("train"), F.col(text).alias("t")).where(
        name.isin("train", "dev", "test", "holdout") & F.col("t").isNotNull()
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            parsed = [atoms(t) for t in raw]
            keep = pa.array([i for i, x in enumerate(parsed) if x[0]], pa.int32())
            cores = [core(t) for t, x in zip(raw, parsed) if x[0]]
            parsed = [x for x in parsed if x[0]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(keep),
                    batch.column(1).take(keep),
                    pa.array([xxhash.xxh3_128_digest(s.encode("utf-8", "surrogatepass")) for s, _, _ in parsed], pa.binary()),
                    pa.array([s for s, _, _ in parsed], pa.string()),
                    pa.array(cores, pa.string()),
                    pa.array([suffix_starts(e, len(s)) for s, e, _ in parsed], pa.list_(pa.int32())),
                ],
                names=["row_id", "train", "form", "t", "core", "starts"],
            )

    return rows.mapInArrow(run, "row_id bigint, train boolean, form binary, t string, core string, starts array<int>")


def neighbours(texts: DataFrame) -> DataFrame:
    """(a, b, span): pairs of texts (tid, t, starts) that stand beside each other in the sorted suffixes with a common prefix of SPAN or more.

    Suffixes are sorted over range partitions; each partition also gives its first and last suffix, and those of
    neighbouring partitions are compared with each other, so that no pair is lost at a border.
    """
    suffixes = texts.select("tid", F.explode("starts").alias("p"), "t").select("tid", F.expr(f"substring(t, p + 1, {SUFFIX})").alias("s"))
    ordered = suffixes.repartitionByRange("s", "tid").sortWithinPartitions("s", "tid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        first, at, text = None, None, None
        for batch in batches:
            a, b, spans = [], [], []
            for tid, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if first is None:
                    first = (tid, s)
                elif tid != at and s[:SPAN] == text[:SPAN] and len(s) >= SPAN:
                    k, most = SPAN, min(len(s), len(text))
                    while k < most and s[k] == text[k]:
                        k += 1
                    a.append(min(tid, at))
                    b.append(max(tid, at))
                    spans.append(k)
                at, text = tid, s
            yield _links(a, b, spans, [None] * len(a), [None] * len(a))
        if first is not None:
            yield _links([first[0], at], [None, None], [2 * part, 2 * part + 1], [first[1], text], [True, True])

    def _links(a, b, spans, texts_, border):
        return pa.RecordBatch.from_arrays(
            [pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(spans, pa.int32()), pa.array(texts_, pa.string()), pa.array(border, pa.bool_())], names=["a", "b", "span", "s", "border"]
        )

    found = cut(ordered.mapInArrow(run, "a bigint, b bigint, span int, s string, border boolean"))
    inner = found.where("border is null").select("a", "b", "span")
    # two rows for each partition: in their order, the last of one and the first of the next are neighbours
    from pyspark.sql import Window

    w = Window.orderBy("span")
    ends = found.where("border").select(F.col("a"), "span", "s").withColumns({"a2": F.lag("a").over(w), "s2": F.lag("s").over(w)})
    across = ends.where(f"span % 2 = 0 and a <> a2 and length(s) >= {SPAN} and substring(s, 1, {SPAN}) = substring(s2, 1, {SPAN})")
    return inner.unionByName(across.select(F.least("a", "a2").alias("a"), F.greatest("a", "a2").alias("b"), F.lit(SPAN).alias("span")))


def cross_split_pairs(df: DataFrame, key: str, text: str, split: str) -> DataFrame:
    """(first_row_id, second_row_id): each pair of a train row and a row of another split that hold the same reference.

    Splits are read without case and blanks round them; rows without one of train, dev, test and holdout, and
    texts without a letter or digit, take no part. Equal streams of letters and digits are one text. Texts beside
    each other in the suffix array are compared by the coverage of their merged shared spans; those that hold one
    reference are linked, and within each component of links every train text is compared with every text of
    another split, as the result lists those pairs. Equal rows each give their own pairs; other columns play no part.
    """
    rows = cut(_texts(df, key, text, split))
    texts = rows.groupBy("form").agg(F.min("row_id").alias("tid"), F.min("t").alias("t"), F.min("core").alias("core"), F.min("starts").alias("starts"), F.max("train").alias("in_train"), F.max(~F.col("train")).alias("in_other"))
    texts = cut(texts)

    @F.pandas_udf("boolean")
    def same(left, right):
        import pandas as pd

        return pd.Series([same_reference(x, y) for x, y in zip(left, right)], dtype=bool)

    def judged(pairs: DataFrame) -> DataFrame:
        ta, tb = (texts.select(F.col("tid").alias(x), F.col("core").alias(f"t_{x}")) for x in "ab")
        return pairs.join(ta, "a").join(tb, "b").where(same("t_a", "t_b")).select("a", "b")

    links = cut(judged(neighbours(texts).select("a", "b").distinct()))
    member = components(links)
    sides = texts.join(member, texts.tid == member.node).select("tid", "component", "in_train", "in_other")
    left = sides.where("in_train").select(F.col("tid").alias("a"), "component")
    right = sides.where("in_other").select(F.col("tid").alias("b"), "component")
    near = left.join(right, "component").where("a <> b").select("a", "b")
    itself = texts.where("in_train and in_other").select(F.col("tid").alias("a"), F.col("tid").alias("b"))
    pairs = judged(near).unionByName(itself)
    of = rows.join(texts.select("form", "tid"), "form").select("tid", "row_id", "train")
    out = pairs.join(of.where("train").select(F.col("tid").alias("a"), F.col("row_id").alias("x")), "a").join(of.where("not train").select(F.col("tid").alias("b"), F.col("row_id").alias("y")), "b")
    return out.select(F.least("x", "y").alias("first_row_id"), F.greatest("x", "y").alias("second_row_id"))


def overlap_report(df: DataFrame, pairs: DataFrame, key: str, split: str, by: list[str]) -> DataFrame:
    """(benchmark_split, *by, n_rows, n_overlapping, share) for each split but train: how many of its rows also occur in train."""
    hit = pairs.select(F.col("first_row_id").alias(key)).unionByName(pairs.select(F.col("second_row_id").alias(key))).distinct().withColumn("hit", F.lit(1))
    rows = df.select(key, F.lower(F.trim(F.col(split))).alias("benchmark_split"), *by).where(F.col("benchmark_split").isin("dev", "test", "holdout"))
    out = rows.join(hit, key, "left").groupBy("benchmark_split", *by).agg(F.count(F.lit(1)).alias("n_rows"), F.count("hit").alias("n_overlapping"))
    return out.withColumn("share", F.round(F.col("n_overlapping") / F.col("n_rows"), 6))
