"""Quality classifier: a naive Bayes support vector machine on n-gram indicators."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import map_rows
from helixframe.llm.learning import fold, platt, sample

#: Training defaults: labelled documents a class at most, hash bits, n-gram lengths in bytes, smoothing, cost, passes.
PER_CLASS, BITS, SIZES, ALPHA, COST, PASSES = 2000, 17, (1, 2, 3, 4), 1.0, 1.0, 15
_MIX = np.uint32(2654435761)


def grams(text: str | None, bits: int = BITS, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    """Distinct hashed byte n-grams of a text's UTF-8, case kept and digits as 0, each length with its own hash."""
    a = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    a[(a > 48) & (a < 58)] = 48
    seen = np.zeros(1 << bits, bool)
    v = a
    for n in range(1, max(sizes) + 1):
        if n > 1:
            v = (v[:-1] << np.uint32(8)) | a[n - 1 :] if len(v) else v
        if n in sizes:
            seen[((v + np.uint32(n * 40503)) * _MIX) >> np.uint32(32 - bits)] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass
class Model:
    """Weights by hashed n-gram, already scaled by the log-count ratios, and the calibration of the margin."""

    weights: np.ndarray
    offset: float
    slope: float
    shift: float

    def margin(self, found: np.ndarray) -> float:
        return float(self.weights[found].sum()) / math.sqrt(len(found) or 1) + self.offset

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * self.margin(grams(text)) + self.shift))))


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, passes: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss: one multiplier a row, clipped to its box; rows have unit length but for the ratios."""
    w, b, rng = np.zeros(len(ratio)), 0.0, np.random.default_rng(0)
    x = [(ratio[r] / math.sqrt(len(r) or 1)).astype(np.float32) for r in rows]
    q = np.array([float(v @ v) + 1 for v in x])
    most = cost * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    alpha = np.zeros(len(rows))
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            g = y[i] * (float(w[rows[i]] @ x[i]) + b) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[rows[i]] += step * x[i]
                b += step
                alpha[i] = new
    return w * ratio, b


def train(data: list[tuple[str, int]], cost: float = COST, passes: int = PASSES) -> Model:
    """Log-count ratios, then dual coordinate descent; the margin is calibrated on a fifth that a first fit leaves out."""
    if len({y for _, y in data}) < 2:
        share = (sum(y for _, y in data) + 0.5) / (len(data) + 1)
        return Model(np.zeros(1 << BITS), 0.0, 1.0, math.log(share / (1 - share)))
    rows = [grams(t) for t, _ in data]
    y = np.array([1.0 if v else -1.0 for _, v in data])

    def fitted(keep: np.ndarray):
        p, q = np.full(1 << BITS, ALPHA), np.full(1 << BITS, ALPHA)
        for i in np.flatnonzero(keep):
            (p if y[i] > 0 else q)[rows[i]] += 1
        ratio = np.log(p / p.sum()) - np.log(q / q.sum())
        at = np.flatnonzero(keep)
        return descend([rows[i] for i in at], y[at], ratio, cost, passes)

    out = np.arange(len(rows)) % 5 == 4
    w, b = fitted(~out)
    first = Model(w, b, 1.0, 0.0)
    slope, shift = platt(np.array([first.margin(rows[i]) for i in np.flatnonzero(out)]), (y[out] > 0).astype(float))
    w, b = fitted(np.ones(len(rows), bool))
    return Model(w.astype(np.float32), b, slope, shift)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Trains on at most per_class documents of each label, of those whose crc32(doc_id) modulo 5 isn't 0."""
    rows = sample(docs, labels.where(fold(5) != 0).select("doc_id", F.col("quality").alias("label")), per_class)
    return train([(t, int(y)) for t, y in rows])


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, text) to (doc_id, score, predicted), predicted 1 where the score reaches the threshold.

    Null and empty texts have no n-grams and get the calibrated offset; repeated rows stay; other columns are not
    read; an empty table gives an empty result. The weights, 2^BITS floats, go to each worker once by broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def f(doc_id, text):
            p = m.score(text)
            return [(doc_id, p, int(p >= threshold))]

        return f

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, score double, predicted int")
