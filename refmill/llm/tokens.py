"""Encoding a corpus with a public tokenizer by overlapping chunks."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refmill.session import cut

TOKENIZER_DIR = "/opt/tokenizers"
#: Characters of a chunk, of the overlap read on either side of it to find where boundaries agree, and of a text whose
#: chunks are spread over the tasks instead of being encoded one after the other.
CHUNK, OVERLAP, SPREAD = 2_048, 256, 1 << 20
#: Characters before the end of a window in which a pre-token may be read wrongly: those of the longest fixed one, and one more.
EDGE = 4
#: Fixed value: the pre-token pattern of the byte-level vocabularies.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _pretoken():
    import regex

    return regex.compile(PRETOKEN)


def boundaries(text: str, start: int, stop: int) -> list[int]:
    """Where pre-tokens end when text is read from start, up to stop; ends within EDGE of stop count only if the text ends there.

    The end of a pre-token depends on nothing before its start, so two readings that share one end share all later ones.
    """
    ends = [m.end() for m in _pretoken().finditer(text, start, stop)]
    if stop < len(text):
        # at the window's edge blanks and "'re" were read as if the text ended
        while ends and ends[-1] > stop - EDGE:
            ends.pop()
    return ends


def agreed(text: str, left: int, at: int, stop: int) -> int | None:
    """The first place from `at` on where the reading from left and the one from `at` both end a pre-token, and not on a blank:
    a run of blanks is split otherwise at the end of a text than before a word."""
    there = set(boundaries(text, at, stop)) | {at}
    return next((b for b in boundaries(text, left, stop) if b >= at and b in there and not text[b - 1].isspace()), None)


def encode_chunk(text: str, begin: int, end: int, first: bool, last: bool, path: str) -> tuple[int | None, int | None, list[int]]:
    """(start, stop, ids) of one chunk; text is the chunk from begin to end with the overlap around it.

    start and stop are places in text where pre-tokens end; None where no agreement was found in the overlap.
    """
    start = 0 if first else agreed(text, 0, begin, min(len(text), begin + OVERLAP))
    stop = len(text) if last else agreed(text, max(begin, end - OVERLAP), end, min(len(text), end + OVERLAP))
    if start is None or stop is None or stop < start:
        return None, None, []
    return start, stop, encoder(path).encode_ordinary(text[start:stop])


def encode_overlapped(text: str, path: str, chunk: int) -> list[int]:
    """The ids of a text, chunk by chunk, stitched where the boundaries of neighbours agree; of the whole where they don't."""
    if len(text) <= chunk:
        return encoder(path).encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for begin in range(0, len(text), chunk):
        left, last = max(0, begin - OVERLAP), begin + chunk >= len(text)
        window = text[left : begin + chunk + OVERLAP]
        start, stop, got = encode_chunk(window, begin - left, len(window) if last else begin - left + chunk, begin == 0, last, path)
        if start is None or left + start != at:
            return encoder(path).encode_ordinary(text)
        ids += got
        at = left + stop
    return ids


def encode_texts(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, chunk: int = CHUNK, spread: int = SPREAD) -> DataFrame:
    """(key, ids array<int>) for every row of df, ids being those of text without special tokens.

    Empty and null texts have the empty array. Texts longer than `chunk` characters are cut into overlapping chunks,
    pre-tokenised from an arbitrary start and stitched where the boundaries of neighbours agree: where they lie, or, if
    longer than `spread`, spread over the tasks. A text whose chunks don't join end to start (say, a run of one
    character longer than the overlap) is encoded whole, so the result never depends on the cutting.
    Decoding joins the bytes of the ids. Rows of equal key each give their own row; other columns play no part.
    """
    path = f"{folder}/{name}.tiktoken"
    key_type = df.select(key).schema[0].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [encode_overlapped(t, path, chunk) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["k", "ids"])

    short = rows.where(F.length("t") <= spread).mapInArrow(encode, f"k {key_type}, ids array<int>")
    # written, so that a row keeps its number in both readings of the long texts
    long = cut(rows.where(F.length("t") > spread).withColumn("row", F.monotonically_increasing_id()))
    if not long.isEmpty():
        short = short.unionByName(_encode_long(long, key_type, path, 32 * chunk))
    return short.select(F.col("k").alias(key), "ids")


def _encode_long(long: DataFrame, key_type: str, path: str, chunk: int) -> DataFrame:
    """(k, ids) of the long texts (row, k, t)."""
    n = F.ceil(F.length("t") / F.lit(chunk)).cast("int")
    begin = F.col("no") * F.lit(chunk)
    left = F.greatest(F.lit(0), begin - F.lit(OVERLAP))
    chunks = (
        long.withColumn("n", n)
        .withColumn("no", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select(
            "row",
            "k",
            "no",
            "n",
            (begin - left).cast("int").alias("begin"),
            left.cast("int").alias("offset"),
            F.substring(F.col("t"), (left + 1).cast("int"), F.lit(chunk + 2 * OVERLAP) - (F.lit(OVERLAP) - (begin - left)).cast("int")).alias("t"),
        )
        .repartition("row", "no")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for no, n_, b, t in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 6))):
                last = no == n_ - 1
                got.append(encode_chunk(t, b, len(t) if last else b + chunk, no == 0, last, path))
            offsets = batch.column(5).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(i) for i in range(4)),
                    pa.array([None if g[0] is None else o + g[0] for o, g in zip(offsets, got)], pa.int64()),
                    pa.array([None if g[1] is None else o + g[1] for o, g in zip(offsets, got)], pa.int64()),
                    pa.array([g[2] for g in got], pa.list_(pa.int32())),
                ],
                names=["row", "k", "no", "n", "start", "stop", "ids"],
            )

    schema = f"row bigint, k {key_type}, no int, n int, start bigint, stop bigint, ids array<int>"
    encoded = chunks.mapInArrow(run, schema)
    texts = encoded.groupBy("row", "k").agg(F.array_sort(F.collect_list(F.struct("no", "start", "stop", "ids"))).alias("parts"))
    joined = F.forall(
        F.sequence(F.lit(1), F.size("parts") - 1),
        lambda i: F.coalesce(F.get("parts", i - 1)["stop"] == F.get("parts", i)["start"], F.lit(False)),
    )
    texts = texts.withColumn("good", joined & ~F.exists("parts", lambda p: p["start"].isNull()))
    stitched = texts.where("good").select("k", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encoder(path).encode_ordinary(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["k", "ids"])

    unjoined = long.join(texts.where("not good").select("row"), "row", "left_semi").select("k", "t").mapInArrow(again, f"k {key_type}, ids array<int>")
    return stitched.unionByName(unjoined)


def token_counts(df: DataFrame, text: str, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """df with n_tokens, the number of ids of text (0 for null and empty), one pass, no shuffle."""
    path = f"{folder}/{name}.tiktoken"

    @F.pandas_udf("bigint")
    def count(texts):
        enc = encoder(path)
        return texts.map(lambda t: len(enc.encode_ordinary(t)) if t else 0).astype("int64")

    return df.withColumn("n_tokens", count(F.coalesce(F.col(text), F.lit(""))))
