"""Quality classification by naive-Bayes support vectors.

Indicators of hashed n-grams are scaled by the classes' log-count ratios and brought to unit length; a linear
classifier with hinge loss is fitted to them by dual coordinate descent, and its margins are turned into
probabilities on rows held back from the fit.

The fit takes at most PER_CLASS labelled rows of each class (those whose ids hash lowest, within the sample's bytes);
class shares come from all labelled rows. Scoring reads every whole text.

Defined results: null and empty texts get the score of a text without features; very long texts are scored whole;
repeated rows get equal scores, and ties stay ties; a label given twice counts as its greatest value; without labels of
both classes every score is their share (0.5 without any); an empty table gives an empty result; other columns go
through, but for those named `score` or `predicted` in any case, which are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from llm.features import BITS, collect_indicators, known_labels, least_hashed, sample_texts, score_texts, sums
from llm.kernel import release

PER_CLASS, ROUNDS, COST, THRESHOLD = 3000, 12, 1.0, 0.3


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, size: int, cost: float = COST, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Weights of the L2-regularised hinge-loss classifier, one dual variable at a time; the last weight is the bias.
    Values may be narrow: each row's are widened when it is visited."""
    rng = np.random.default_rng(seed)
    w, alpha = np.zeros(size + 1), np.zeros(len(rows))
    square = np.array([wide @ wide + 1.0 for wide in (v.astype(np.float64) for v in values)])
    share = np.bincount((y > 0).astype(int), minlength=2) / max(1, len(y))
    top = np.where(y > 0, cost * 0.5 / max(share[1], 1e-9), cost * 0.5 / max(share[0], 1e-9))
    for _ in range(rounds):
        for i in rng.permutation(len(rows)):
            wide = values[i].astype(np.float64)
            g = y[i] * (w[rows[i]] @ wide + w[-1]) - 1
            new = min(max(alpha[i] - g / square[i], 0.0), top[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * wide
                w[-1] += step
                alpha[i] = new
    return w


def to_probability(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve through margins and labels, by Newton steps with a slight ridge."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        d, h = weight * (p - (y > 0)), weight * np.maximum(p * (1 - p), 1e-6)
        grad = np.array([d @ margin + 1e-2 * a, d.sum()])
        hess = np.array([[h @ margin**2 + 1e-2, h @ margin], [h @ margin, h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
        if abs(step).max() < 1e-8:
            break
    return a, b


@dataclass
class QualityModel:
    ratio: np.ndarray  # log-count ratios
    weights: np.ndarray  # ratio times weight of each feature
    bias: float
    slope: float
    offset: float

    def margin(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return sums(self.weights[x], first) / np.sqrt(np.maximum(sums(self.ratio[x] ** 2, first), 1e-12)) + self.bias

    def __call__(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x, first) + self.offset, -30, 30)))


def fit(rows: list[np.ndarray], y: np.ndarray, share: float, bits: int = BITS) -> QualityModel:
    """y: 1 or -1; share: of label 1 among all labelled rows."""
    size = 1 << bits
    if len(set(y.tolist())) < 2:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return QualityModel(np.zeros(size, np.float32), np.zeros(size, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    hold = np.arange(len(y)) % 5 == 0
    if len(set(y[hold].tolist())) < 2 or len(set(y[~hold].tolist())) < 2:
        hold = np.zeros(len(y), bool)
    counts = [np.ones(size), np.ones(size)]
    for x, label, h in zip(rows, y, hold):
        if not h:
            counts[int(label > 0)][x] += 1
    ratio = (np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())).astype(np.float32)
    values = [ratio[x] / max(np.sqrt((ratio[x] ** 2).sum()), 1e-6) for x in rows]
    used = [i for i in range(len(y)) if not hold[i]]
    w = dual_descent([rows[i] for i in used], [values[i] for i in used], y[used], size)
    model = QualityModel(ratio, (ratio * w[:-1]).astype(np.float32), float(w[-1]), 1.0, 0.0)
    test = np.flatnonzero(hold) if hold.any() else np.arange(len(y))
    margin = np.array([values[i] @ w[rows[i]] + w[-1] for i in test])
    mean = (y[test] > 0).mean()
    weight = np.where(y[test] > 0, share / mean, (1 - share) / (1 - mean))
    model.slope, model.offset = to_probability(margin, y[test], weight)
    return model


def train_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    known = known_labels(labels, "quality").cache()
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    picked = least_hashed(known.where("y = 1"), per_class).unionByName(least_hashed(known.where("y = 0"), per_class))
    truth = {r["doc_id"]: r["y"] for r in picked.collect()}
    known.unpersist()
    ids, rows = collect_indicators(sample_texts(docs, picked))
    order = np.argsort(ids, kind="stable")
    y = np.array([1 if truth[ids[i]] else -1 for i in order], np.int64)
    return fit([rows[i] for i in order], y, counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5)


def score_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """`docs` with `score` (probability of label 1) and `predicted` (1 if score >= 0.3, else 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(train_quality(docs, labels, per_class))
    release()  # the sample, which the driver would keep through all that follows
    return score_texts(docs, lambda x, first: shared.value(x, first), THRESHOLD)
