"""Mixing sources to target weights by balanced sampling (the cube method)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refmill.session import cut

#: Documents balanced together in one task.
BLOCK = 20_000


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase: probabilities moved to 0 or 1, their sum and the sum of pi * size kept, until at most two are left between.

    Three units at a time have a direction in which both sums stay; it is followed, one way or the other at random with
    the odds that keep every unit's expectation, until one of the three is settled and the next takes its place.
    """
    p = pi.astype(float).copy()
    open_ = [i for i in range(len(p)) if 1e-9 < p[i] < 1 - 1e-9]
    window, rest = open_[:3], iter(open_[3:])
    while len(window) == 3:
        i, j, k = window
        a, b, c = size[i], size[j], size[k]
        u = np.array([b - c, c - a, a - b], float)  # orthogonal to (1, 1, 1) and to the sizes
        if not u.any():
            u = np.array([1.0, -1.0, 0.0])
        q = p[window]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.min(np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)))
            down = np.min(np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)))
        step = up if rng.random() < down / (up + down) else -down
        p[window] = np.clip(q + step * u, 0, 1)
        p[window] = np.where(p[window] < 1e-9, 0, np.where(p[window] > 1 - 1e-9, 1, p[window]))
        window = [x for x in window if 0 < p[x] < 1]
        while len(window) < 3 and (nxt := next(rest, None)) is not None:
            window.append(nxt)
    return p


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settles the few units left so that the sum of sizes and their number come nearest to what they should be."""
    out, open_ = p.copy(), [i for i in range(len(p)) if 0 < p[i] < 1]
    want, number = float((p * size).sum()), float(p.sum())
    usual = float(size.mean()) or 1.0
    best = None
    for code in range(1 << len(open_)):
        trial = p.copy()
        for n, i in enumerate(open_):
            trial[i] = code >> n & 1
        off = abs(float((trial * size).sum()) - want) / usual + abs(float(trial.sum()) - number)
        if best is None or off < best:
            best, out = off, trial
    return out


def rates(sources: list[tuple[str, float, int, int]], total: float) -> dict[str, float]:
    """How often on average each source (name, target share, most repeats, tokens) is used, so that together they give total.

    A source too small for its share is used its most; what it can't give is asked of the others in proportion to their
    shares, until all is given or nothing is left to ask.
    """
    out = {s: 0.0 for s, _, _, _ in sources}
    open_ = [x for x in sources if x[1] > 0 and x[2] > 0 and x[3] > 0]
    left = total
    while open_ and left > 0:
        shares = sum(x[1] for x in open_)
        small = [x for x in open_ if x[2] * x[3] <= left * x[1] / shares]
        for s, share, most, tokens in small or open_:
            out[s] = float(most) if small else left * share / shares / tokens
        if not small:
            break
        left -= sum(x[2] * x[3] for x in small)
        open_ = [x for x in open_ if x not in small]
    return out


def _fly(rows: DataFrame, last: bool, blocks: int) -> DataFrame:
    def run(key, pdf):
        pdf = pdf.sort_values("k")
        p = flight(pdf["pi"].to_numpy(), pdf["size"].to_numpy(float), np.random.default_rng([len(pdf), int(key[1])]))
        pdf["pi"] = landing(p, pdf["size"].to_numpy(float)) if last else p
        return pdf

    # as many tasks as blocks: small as they are in bytes, they are long in work, and would be put together
    spread = rows.repartition(max(1, min(blocks, 100_000)), "source", "block")
    return spread.groupBy("source", "block").applyInPandas(run, "k bigint, source string, size bigint, base int, pi double, block int")


def mix(df: DataFrame, key: str, source: str, size: str, targets: DataFrame, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, shares). selection: (key, source, n_uses) of the documents used; shares: per source the target and what was reached.

    targets has source, target_share and max_repeats, one row per source and few of them. Each source is to give its
    share of `total` (by default the size of the whole corpus); a source too small for it is used max_repeats times
    over, no more, and what it can't give is spread over the others. Every document is used a whole number of times, the floor of its source's rate, and once more with
    the remaining probability, by balanced sampling on the number of documents and their sizes: in blocks first, then
    among the few left open by each. Documents of a source without a target, and of null source, are left out;
    documents of size 0 or null count as size 0. Nulls and ties are settled by the order of the hash of the key.
    """
    docs = df.select(F.col(key).alias("k"), F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size"))
    docs = cut(docs)
    have = docs.groupBy("source").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("n"))
    # one row per source: as few as targets
    known = targets.select("source", "target_share", "max_repeats").join(have, "source").orderBy("source").collect()
    whole = total if total is not None else docs.agg(F.sum("size")).first()[0] or 0
    rate = rates([(r.source, float(r.target_share or 0), int(r.max_repeats or 0), int(r.tokens)) for r in known], float(whole))
    made = [(r.source, int(rate[r.source]), rate[r.source] - int(rate[r.source]), -(-int(r.n) // BLOCK)) for r in known]
    plan = df.sparkSession.createDataFrame(made, "source string, base int, frac double, blocks int")
    rows = docs.join(F.broadcast(plan), "source").select("k", "source", "size", "base", F.col("frac").alias("pi"), F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int").alias("block"))
    flown = cut(_fly(rows, False, sum(m[3] for m in made)))
    settled = flown.where("pi = 0 or pi = 1")
    left = flown.where("pi > 0 and pi < 1")
    # each block leaves two documents at most: some rounds more, and all of a source stand in one block
    while True:
        most = left.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        blocks = max(1, -(-most // BLOCK))
        again = cut(_fly(left.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(blocks)).cast("int")), blocks == 1, blocks * len(made)))
        settled = settled.unionByName(again.where("pi = 0 or pi = 1"))
        if blocks == 1:
            break
        left = again.where("pi > 0 and pi < 1")
    chosen = cut(settled.withColumn("n_uses", (F.col("base") + F.col("pi")).cast("int")).where("n_uses > 0"))
    used = chosen.groupBy("source").agg(F.sum(F.col("size") * F.col("n_uses")).alias("used_tokens"), F.sum("n_uses").alias("used_documents"))
    whole = used.agg(F.sum("used_tokens").alias("all_tokens"))
    shares = (
        targets.select("source", "target_share", "max_repeats")
        .join(used, "source", "left")
        .join(F.broadcast(whole), F.lit(True))
        .select(
            "source", "target_share", "max_repeats", F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"), F.coalesce("used_documents", F.lit(0)).alias("used_documents"),
            F.round(F.coalesce(F.col("used_tokens") / F.col("all_tokens"), F.lit(0.0)), 6).alias("reached_share"),
        )
    )
    return chosen.select(F.col("k").alias(key), "source", "n_uses"), shares
