"""Subject areas of documents: sentence evidence from term features, a classifier chain, and beam search."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refmill.llm.text import fold

#: Labelled documents the model is fitted on, at most (those whose ids hash lowest), and terms it keeps.
SAMPLE, TERMS = 5_000, 60_000
#: Subjects a document has at most; shares of its sentences about a subject at which the odds may step.
MOST, STEPS = 2, (0.15, 0.25, 0.3, 0.35, 0.45, 0.6)
#: Width of the beam, rounds of fitting at most, and folds by which the chain is calibrated.
BEAM, ROUNDS, FOLDS = 6, 60, 4
#: Headings that open a reference list.
_LIST = re.compile(r"^\W*(?:\d+\.?\s*)?(references|reference list|bibliography|works cited|literature|literatur|literaturverzeichnis|quellen|referencias|bibliografia)\W*$", re.IGNORECASE)
_END = re.compile(r"(?<=[.!?])\s+")
_WORD = re.compile(r"[^\W\d_]{3,}")


def sentences(text: str) -> list[str]:
    """Sentences of a text up to its reference list; lines broken inside paragraphs are joined."""
    out = []
    for part in text.replace("\r\n", "\n").split("\n\n"):
        first, _, _ = part.partition("\n")
        if _LIST.match(first) or not first.isascii() and _LIST.match(fold(first)):
            break
        out += [s for s in _END.split(part.replace("\n", "")) if s]
    return out


def terms(sentence: str) -> list[str]:
    """Words and pairs of words beside each other."""
    words = _WORD.findall(fold(sentence))
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


class Chain:
    """Term weights by subject, and for each subject in turn a logistic model of the shares, the structure, the source and the subjects before it, calibrated on documents held out of the fit."""

    def __init__(self, docs: list[tuple[str, list[str], str]], subjects: list[str]):
        self.subjects, self.calibration = subjects, (1.0, 0.0)
        parsed = [([set(terms(s)) for s in sentences(t)], labels, source) for t, labels, source in docs]
        self.sources = {s: i for i, s in enumerate(sorted({source for _, _, source in docs}))}
        y = np.array([[s in labels for s in subjects] for _, labels, _ in docs], float).reshape(len(docs), len(subjects))
        # the most frequent subjects come first, so that the rarer ones lean on them
        self.order = [int(i) for i in np.argsort(-y.sum(0), kind="stable")]
        self.held_out = self._calibrate(parsed, y)
        self._learn(parsed, y)

    def _calibrate(self, parsed: list, y: np.ndarray) -> tuple[int, int, int]:
        """Fits the chain on all folds but one in turn and learns from the one left out how far its odds can be trusted. (pairs of document and subject, those given, those right) of the folds left out."""
        odds, truth, tests = [], [], []
        for fold in range(FOLDS if len(parsed) >= 10 * FOLDS else 0):
            out = np.arange(len(parsed)) % FOLDS == fold
            self._learn([p for p, o in zip(parsed, out) if not o], y[~out])
            x = np.array([self.features([{w for w in s if w in self.weights} for s in p[0]], p[2]) for p, o in zip(parsed, out) if o])
            for n, s in enumerate(self.order):
                odds.append(self._row(x, s, y[out][:, self.order[:n]]) @ self.models[n])
                truth.append(y[out][:, s])
            tests.append((x, y[out], self.models))
        if odds:
            z, t = np.clip(np.concatenate(odds), -30, 30), np.concatenate(truth)
            a, b = 1.0, 0.0
            for _ in range(200):
                p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
                w = p * (1 - p) + 1e-6
                g, h = np.array([((p - t) * z).sum(), (p - t).sum()]), np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
                step = np.clip(np.linalg.solve(h, g + np.array([1e-2 * (a - 1), 1e-2 * b])), -0.5, 0.5)
                a, b = a - step[0], b - step[1]
                if np.abs(step).max() < 1e-8:
                    break
            self.calibration = (float(a), float(b))
        given = right = 0
        for x, t, self.models in tests:
            for row, labels in zip(x, t):
                found = [self.subjects.index(s) for s in self.decode(row)] if row[: len(self.subjects)].any() else []
                given += len(found)
                right += int(sum(labels[s] for s in found))
        return int(sum(t.sum() for _, t, _ in tests)), given, right

    def _learn(self, parsed: list, y: np.ndarray) -> None:
        subjects = self.subjects
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(subjects)))
        of = np.zeros(len(subjects))
        for (parts, labels, _), row in zip(parsed, y):
            if row.sum() == 1:
                s = int(row.argmax())
                of[s] += 1
                for w in set().union(*parts) if parts else ():
                    counts[w][s] += 1
        rate = {w: (c + 0.05) / (of + 1.0) for w, c in counts.items() if c.sum() >= 2}
        keep = sorted(rate, key=lambda w: -(rate[w].max() / rate[w].sum()) * np.log1p(counts[w].sum()))[:TERMS]
        # a term speaks for a subject if most of its documents, each subject taken as equally frequent, are of it
        self.weights = {w: (int(rate[w].argmax()), float(np.log(rate[w].max() / (rate[w].sum() - rate[w].max() + 1e-9)))) for w in keep if rate[w].max() / rate[w].sum() > 0.6}
        x = np.array([self.features(parts, source) for parts, _, source in parsed]) if parsed else np.zeros((0, len(subjects) + 3 + len(self.sources)))
        self.models = [self._fit(x, y, n) for n in range(len(subjects))]

    def features(self, parts: list[set[str]], source: str) -> np.ndarray:
        """For each subject its share of the sentences about any, the number of those, whether there are any, and the source."""
        k = len(self.subjects)
        votes = np.zeros(k)
        for found in parts:
            score: Counter = Counter()
            for w in found:
                if w in self.weights:
                    s, weight = self.weights[w]
                    score[s] += weight
            if score:
                s, best = score.most_common(1)[0]
                if best > 1.0:
                    votes[s] += 1
        total = votes.sum()
        out = np.zeros(k + 3 + len(self.sources))
        if total:
            out[:k] = votes / total
        out[k : k + 3] = min(3.0, np.log1p(total)), total > 1, min(1.0, total / max(1, len(parts)))
        if source in self.sources:
            out[k + 3 + self.sources[source]] = 1.0
        return out

    def _row(self, x: np.ndarray, subject: int, before: np.ndarray) -> np.ndarray:
        share = x[..., subject : subject + 1]
        # besides the share, whether it passes each of a few steps: where the line runs is learned
        return np.concatenate([np.ones_like(share), share, *((share >= step) * 1.0 for step in STEPS), x[..., len(self.subjects) :], before], -1)

    def _fit(self, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
        s, earlier = self.order[n], self.order[:n]
        a = self._row(x, s, y[:, earlier])
        w = np.zeros(a.shape[1])
        w[0] = -4.0
        if not len(a):
            return w
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            h = (a * (p * (1 - p))[:, None]).T @ a / len(a) + 0.002 * np.eye(len(w))
            step = np.linalg.solve(h, a.T @ (p - y[:, s]) / len(a) + 0.002 * w)
            # where the fit is nearly sure the curve is flat and a full step would overshoot
            step = step * min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
            w = w - step
            if np.abs(step).max() < 1e-6:
                break
        return w

    def decode(self, x: np.ndarray) -> list[str]:
        """The likeliest set of at most MOST subjects by calibrated odds."""
        a, b = self.calibration
        k, n_steps = len(self.subjects), len(STEPS)
        share = x[self.order]
        # what doesn't hang on the subjects taken before, for all subjects at once
        first = np.array([m[: 2 + n_steps] for m in self.models])
        rest = np.array([m[2 + n_steps : 2 + n_steps + len(x) - k] for m in self.models])
        base = first[:, 0] + first[:, 1] * share + ((share[:, None] >= np.array(STEPS)) * first[:, 2:]).sum(1) + rest @ x[k:]
        beam: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for n in range(k):
            earlier = self.models[n][2 + n_steps + len(x) - k :]
            wider = []
            for score, taken in beam:
                z = min(30.0, max(-30.0, a * (float(base[n]) + sum(float(earlier[t]) for t in taken)) + b))
                wider.append((score - math.log1p(math.exp(z)), taken))
                if len(taken) < MOST:
                    wider.append((score - math.log1p(math.exp(-z)), (*taken, n)))
            beam = sorted(wider, key=lambda v: -v[0])[:BEAM]
        return [self.subjects[self.order[t]] for t in beam[0][1]]


def train(docs: DataFrame, labels: DataFrame, subjects: list[str], key: str, text: str, source: str) -> Chain:
    """A chain fitted on the labelled documents, at most SAMPLE of them: labels (key, annotator, subject), null for none.

    A document has the subjects that at least half of its annotators gave it.
    """
    said = labels.groupBy(key).agg(F.countDistinct("annotator").alias("n"))
    given = labels.where(F.col("subject").isin(subjects)).groupBy(key, "subject").agg(F.countDistinct("annotator").alias("k"))
    agreed = given.join(said, key).where("2 * k >= n").groupBy(key).agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    chosen = said.join(agreed, key, "left").orderBy(F.xxhash64(key), key).limit(SAMPLE)
    rows = docs.where(F.col(text).isNotNull()).select(key, F.col(text).alias("t"), F.col(source).alias("s")).join(chosen, key)
    return Chain([(r.t, list(r.subjects or []), r.s or "") for r in rows.orderBy(key).collect()], subjects)


def subjects_of(docs: DataFrame, model: Chain, key: str, text: str, source: str) -> DataFrame:
    """(key, subject) of each document's subjects; null and empty texts and those about none give no row. One pass, no shuffle."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, known = sent.value, sent.value.weights
        for batch in batches:
            take, out = [], []
            for i, (t, s) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                parts = [{w for w in terms(x) if w in known} for x in sentences(t)]
                if any(parts):
                    for subject in chain.decode(chain.features(parts, s or "")):
                        take.append(i)
                        out.append(subject)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take, pa.int32())), pa.array(out, pa.string())], names=[key, "subject"])

    return docs.where(F.col(text).isNotNull()).select(key, text, source).mapInArrow(run, f"`{key}` {kind}, subject string")
