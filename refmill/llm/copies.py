"""Duplicates hidden by formatting: canonical forms, 128-bit hashes, counts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refmill.llm.text import plain, unescape
from refmill.session import cut

#: Words put before a number, never a field of their own.
_BEFORE_NUMBERS = frozenset(("vol", "volume", "no", "nr", "number", "issue", "iss", "p", "pp", "pages", "page"))
#: Fixed value: what stands for a missing year.
_NO_DATE = "nd"
#: Parts by which rows of one form are spread when rows and forms are joined, so that a hot form isn't one task.
SALT = 8


def atoms(text: str) -> tuple[str, bytearray, bytearray]:
    """(letters and digits in sequence, what stood before each: 2 for what may part fields, 1 for a mere blank, whether a dash did); one mark more for the end.

    Fields are parted by a mark, by several blanks, or by a blank beside a number.
    """
    out: list[str] = []
    edge, dash = bytearray(b"\2"), bytearray(b"\0")
    for ch in plain(unescape(text)):
        if ch.isalnum():
            if edge[-1] == 1 and out and (ch.isdigit() or out[-1].isdigit()):
                edge[-1] = 2
            out.append(ch)
            edge.append(0)
            dash.append(0)
        else:
            edge[-1] = min(2, edge[-1] + 1) if ch.isspace() else 2
            if ch == "-":
                dash[-1] = 1
    edge[-1] = 2
    return "".join(out), edge, dash


def _may_stand_alone(block: str) -> bool:
    """Whether a run of letters and digits can be a whole field."""
    return block not in _BEFORE_NUMBERS and (len(block) >= 3 or block.isdigit() or block == _NO_DATE)


def same_fields(left: str, right: str) -> bool:
    """Whether two texts hold the same fields, agreeing in letters and digits, perhaps in another order.

    right is cut into blocks, each a run of left, used once, that lies between blanks or marks in both texts and between
    two places that may part fields in one of them; the longest block that fits goes first, going back where the rest won't fit, and no state is tried twice.
    A block must be able to be a field: a word put before a number isn't one. Two short numbers side by side in
    both texts, but the other way round, are a volume and an issue swapped: another reference.
    """
    a, edge_a, dash_a = atoms(left)
    b, edge_b, _ = atoms(right)
    if a == b:
        return True
    if len(a) != len(b):
        return False
    n, used = len(a), bytearray(len(a))

    def options(j: int) -> list[tuple[int, int]]:
        found = []
        p = a.find(b[j])
        while p >= 0:
            if edge_a[p] and not used[p]:
                k, best, whole_a, whole_b = 0, 0, edge_a[p] == 2, edge_b[j] == 2
                while j + k < n and p + k < n and not used[p + k] and a[p + k] == b[j + k]:
                    k += 1
                    ea, eb = edge_a[p + k], edge_b[j + k]
                    if ea and eb and (whole_a and ea == 2 or whole_b and eb == 2) and _may_stand_alone(b[j : j + k]):
                        if best:
                            found.append((best, p))
                        best = k
                if best:
                    found.append((best, p))
            p = a.find(b[j], p + 1)
        # of equal blocks the first unused will do
        first = {k: p for k, p in sorted(set(found), key=lambda x: -x[1])}
        return sorted(first.items())

    def can_end() -> bool:
        """Whether blocks can reach the end of right, leaving aside that each run of left is used once."""
        was, used[:] = bytes(used), bytes(n)
        reached, ends = {0}, [0]
        while ends:
            j = ends.pop()
            new = {j + k for k, _ in options(j)} - reached if j < n else set()
            reached |= new
            ends += new
        used[:] = was
        return n in reached

    failed: set[tuple[int, bytes]] = set()
    blocks: list[tuple[int, int]] = []
    open_ = [options(0)]
    at = 0
    while open_:
        if at == n:
            if not _swapped(blocks, a, dash_a):
                return True
        elif open_[-1]:
            k, p = open_[-1].pop()
            used[p : p + k] = b"\1" * k
            if at + k < n and (at + k, bytes(used)) in failed:
                used[p : p + k] = bytes(k)
                continue
            blocks.append((p, k))
            at += k
            open_.append(options(at) if at < n else [])
            continue
        else:
            if not failed and not can_end():
                return False
            failed.add((at, bytes(used)))
        open_.pop()
        if blocks:
            p, k = blocks.pop()
            used[p : p + k] = bytes(k)
            at -= k
    return False


def _swapped(blocks: list[tuple[int, int]], a: str, dash: bytearray) -> bool:
    for (p, k), (q, m) in zip(blocks, blocks[1:]):
        short = k <= 3 and m <= 3 and a[p : p + k].isdigit() and a[q : q + m].isdigit()
        if short and q + m == p and not any(dash[p + 1 : p + k]) and not any(dash[q + 1 : q + m]):
            return True
    return False


def signatures(df: DataFrame, name: str, key: str, text: str) -> DataFrame:
    """(table_name, id, bag, form, size, check): 128-bit hashes of the sorted letters and digits of text (bag, the
    same for every order of fields) and of their sequence (form), its length and a second hash for the collision check.
    Texts without a letter or digit, null ones among them, give no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags, forms, sizes, checks, keep = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                s = "".join(ch for ch in plain(unescape(t)) if ch.isalnum())
                if not s:
                    continue
                raw = s.encode("utf-8", "surrogatepass")
                keep.append(i)
                bags.append(xxhash.xxh3_128_digest("".join(sorted(s)).encode("utf-8", "surrogatepass")))
                forms.append(xxhash.xxh3_128_digest(raw))
                sizes.append(len(s))
                checks.append(xxhash.xxh64_intdigest(raw, 7) - (1 << 63))
            ids = batch.column(0).take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(keep), pa.string()), ids, pa.array(bags, pa.binary()), pa.array(forms, pa.binary()), pa.array(sizes, pa.int32()), pa.array(checks, pa.int64())],
                names=["table_name", "id", "bag", "form", "size", "check"],
            )

    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t")).where("t is not null")
    return rows.mapInArrow(run, "table_name string, id bigint, bag binary, form binary, size int, check bigint")


def collapse(sources: dict[str, tuple[DataFrame, str, str]]) -> tuple[DataFrame, DataFrame]:
    """(signatures, forms) of each table given as name -> (frame, id column, text column).

    forms has one row per table and form: table_name, form, n (its rows), form_first (their smallest id) and
    class_id (the smallest id of all forms with the same fields). Nulls and texts without letter or digit have no
    form. Exact repeats fall into one form by counts with map-side combining. Only forms that share a bag are
    compared, each with the first of its bag; those that differ from it go another round among themselves, so no
    bag is ever gathered in one task. Equal hashes of unequal texts raise an error.
    """
    rows = None
    for name, (df, key, text) in sources.items():
        part = signatures(df, name, key, text)
        rows = part if rows is None else rows.unionByName(part)
    rows = cut(rows)
    forms = cut(
        rows.groupBy("table_name", "bag", "form")
        .agg(F.min("id").alias("form_first"), F.count(F.lit(1)).alias("n"), F.min("size").alias("s0"), F.max("size").alias("s1"), F.min("check").alias("c0"), F.max("check").alias("c1"))
        .withColumn("n", F.when((F.col("s0") == F.col("s1")) & (F.col("c0") == F.col("c1")), F.col("n")).otherwise(F.raise_error(F.lit("two texts share a 128-bit hash"))))
        .drop("s0", "s1", "c0", "c1")
    )
    several = forms.groupBy("table_name", "bag").agg(F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    wanted = forms.join(several, ["table_name", "bag"], "left_semi").select("table_name", "bag", F.col("form_first").alias("id"))
    pool = None
    for name, (df, key, text) in sources.items():
        texts = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("t"))
        part = wanted.where(F.col("table_name") == name).join(texts, "id").groupBy("table_name", "bag", "id").agg(F.min("t").alias("t"))
        pool = part if pool is None else pool.unionByName(part)
    pool = cut(pool)

    @F.pandas_udf("boolean")
    def same(left, right):
        import pandas as pd

        return pd.Series([same_fields(x, y) for x, y in zip(left, right)], dtype=bool)

    classes = None
    while not pool.isEmpty():
        heads = pool.groupBy("table_name", "bag").agg(F.min("id").alias("head"), F.min_by("t", "id").alias("head_t"))
        judged = cut(pool.join(heads, ["table_name", "bag"]).withColumn("same", (F.col("id") == F.col("head")) | same("head_t", "t")))
        part = judged.where("same").select("table_name", F.col("id").alias("form_first"), F.col("head").alias("class_id"))
        classes = part if classes is None else classes.unionByName(part)
        pool = judged.where("not same").select("table_name", "bag", "id", "t")
    if classes is None:
        forms = forms.withColumn("class_id", F.col("form_first"))
    else:
        forms = forms.join(classes, ["table_name", "form_first"], "left").withColumn("class_id", F.coalesce("class_id", "form_first"))
    return rows, forms.select("table_name", "form", "n", "form_first", "class_id")


def copies(rows: DataFrame, forms: DataFrame) -> DataFrame:
    """(table_name, first_id, copy_id): every row but the first of each set of copies. Hot forms are salted."""
    double = forms.where("n > 1 or class_id < form_first").select("table_name", "form", "class_id")
    double = double.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return (
        rows.select("table_name", "form", "id", F.pmod("id", F.lit(SALT)).cast("int").alias("salt"))
        .join(double, ["table_name", "form", "salt"])
        .where("id <> class_id")
        .select("table_name", F.col("class_id").alias("first_id"), F.col("id").alias("copy_id"))
    )


def copy_counts(forms: DataFrame) -> DataFrame:
    """(table_name, first_id, n_copies, n_forms): one record for each set of copies with the number of its rows and forms."""
    return forms.groupBy("table_name", F.col("class_id").alias("first_id")).agg(F.sum("n").alias("n_copies"), F.count(F.lit(1)).alias("n_forms"))
