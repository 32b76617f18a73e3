"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier in numpy learns from confirmed toxic texts and from texts of the corpus at large, whose labels it
doesn't look at. The risk of the unlabelled part is corrected by the class prior: prior x loss on positives as
positive, plus the loss on unlabelled as negative less prior x the loss on positives as negative, which is not let
fall under zero: where it would, the step goes the other way. Features are the n-grams and word starts that positives
hold EXCESS standard deviations oftener than the corpus leads to expect, LEAST positives at least; one counts in full
from FULL standard deviations on and in proportion below, so that weak evidence is used, at any number of positives,
but can't outweigh strong. A text repeated among the positives counts once. What the corpus leads to expect is counted
over all documents outside the held-out fold.

The prior is the share of toxic labels among labelled rows outside the held-out fold. The fit takes at most POSITIVES
toxic rows and UNLABELLED rows of the corpus (those whose ids hash lowest, within the sample's bytes); scoring reads every whole text.

Defined results: null and empty texts get the score of a text without features; very long texts are scored whole;
repeated rows get equal scores, and ties stay ties; a label given twice counts as its greatest value; without toxic
labels every score is that of a model without features, under 1e-12; an empty table gives an empty result; other columns
go through, but for those named `score` or `predicted` in any case, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm.features import BITS, SCORE_SLICE, collect_indicators, indicators, known_labels, least_hashed, sample_texts, score_texts, sums, word_starts
from llm.kernel import slices
from llm.shared import fold

POSITIVES, UNLABELLED, LEAST, EXCESS, FULL, STEPS, RATE, DECAY, THRESHOLD = 4000, 8000, 3, 2.0, 8.0, 400, 0.05, 1e-4, 0.5


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def __call__(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(sums(self.weights[x], first) + self.bias, -30, 30)))


def shares(rows: list[np.ndarray], size: int) -> np.ndarray:
    total = np.zeros(size)
    for x in rows:
        total[x] += 1
    return total


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, bits: int = BITS, corpus: tuple[np.ndarray, int] | None = None) -> ToxicityModel:
    """corpus: in how many documents each feature occurs, and how many there are; without it, those of `unlabelled` count."""
    size = 1 << bits
    positive = list({x.tobytes(): x for x in positive}.values())
    if not positive or not unlabelled:
        return ToxicityModel(np.zeros(size, np.float32), -30.0)
    p = shares(positive, size)
    u, n = corpus or (shares(unlabelled, size), len(unlabelled))
    expected = (u + 0.5) / n * len(positive)
    excess = (p - expected) / np.sqrt(expected)
    keep = np.flatnonzero((p >= LEAST) & (excess >= EXCESS))
    if not len(keep):
        return ToxicityModel(np.zeros(size, np.float32), -30.0)
    number = np.full(size, -1)
    number[keep] = np.arange(len(keep))

    def compact(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        short = [number[x][number[x] >= 0] for x in rows]
        return np.concatenate(short).astype(np.int64), np.concatenate([[0], np.cumsum([len(s) for s in short])])

    sets = [(*compact(positive), len(positive)), (*compact(unlabelled), len(unlabelled))]
    scale = np.minimum(1.0, excess[keep] / FULL)
    w = np.zeros(len(keep) + 1)
    w[-1] = -2.0
    m, v = np.zeros_like(w), np.zeros_like(w)

    def push(which: int, slopes: np.ndarray) -> np.ndarray:
        x, first, n = sets[which]
        return np.append(scale * np.bincount(x, np.repeat(slopes, np.diff(first)), len(keep)), slopes.sum()) / n

    for step in range(1, STEPS + 1):
        z = [np.clip(sums((scale * w[:-1])[x], first) + w[-1], -30, 30) for x, first, _ in sets]
        s = [1 / (1 + np.exp(-a)) for a in z]
        loss = lambda a: np.logaddexp(0, a).mean()
        negative = loss(z[1]) - prior * loss(z[0])
        grad = push(1, s[1]) - prior * push(0, s[0])
        grad = prior * push(0, s[0] - 1) + grad if negative >= 0 else -grad
        grad[:-1] += DECAY * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(size, np.float32)
    weights[keep] = scale * w[:-1]
    return ToxicityModel(weights, float(w[-1]))


def frequencies(docs: DataFrame, wanted: np.ndarray, bits: int = BITS, features=indicators) -> tuple[np.ndarray, int]:
    """In how many documents each wanted feature occurs (0 for others), and how many documents there are."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, n = np.zeros(1 << bits, bool), 0
        mine[shared.value] = True
        total = np.zeros(1 << bits, np.int64)
        for part in slices(batches, limit=SCORE_SLICE):
            x, _ = features(part["text"], bits)
            total += np.bincount(x[mine[x]], minlength=1 << bits)
            n += part.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(total[at], n))], names=["k", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    k, n = rows["k"].to_numpy(), rows["n"].to_numpy()
    out = np.zeros(1 << bits)
    out[k[k >= 0]] = n[k >= 0]
    shared.destroy()
    return out, int(n[k < 0].sum())


def train_toxicity(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> ToxicityModel:
    known = known_labels(labels, "toxic")
    toxic, total = known.agg(F.sum("y"), F.count(F.lit(1))).first()
    if not toxic:
        return fit([], [], 0.0)
    _, pos = collect_indicators(sample_texts(docs, least_hashed(known.where("y = 1"), positives)), word_starts)
    learned = docs.where(F.col("doc_id").isNotNull() & (fold() != 0))
    corpus = learned.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    _, rest = collect_indicators(sample_texts(docs, least_hashed(corpus, unlabelled)), word_starts)
    if not pos or not rest:
        return fit([], [], 0.0)
    wanted = np.flatnonzero(shares(list({x.tobytes(): x for x in pos}.values()), 1 << BITS) >= LEAST)
    return fit(pos, rest, min(max(toxic / total, 1e-4), 0.95), corpus=frequencies(learned, wanted, features=word_starts))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` with `score` (toxic likelihood) and `predicted` (1 if score >= 0.5, else 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(train_toxicity(docs, labels))
    return score_texts(docs, lambda x, first: shared.value(x, first), THRESHOLD, word_starts)
