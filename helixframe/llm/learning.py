"""What the trained operators share: bounded samples of labelled rows, folds, calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Most labels that a classifier has.
LABELS = 1000


def fold(folds: int) -> Column:
    """crc32 of doc_id as text, modulo the number of folds; null ids have none."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


def sample(docs: DataFrame, labelled: DataFrame, per_class: int) -> list[tuple[str, object]]:
    """(text, label) of at most per_class rows for each of the few labels, the first by a hash of doc_id.

    labelled has doc_id and label. Ids are chosen before texts are read, and of rows that share an id the least text is
    taken, so what the driver gathers is bounded by per_class whole texts a label. Over LABELS labels are an error.
    """
    labels = [r[0] for r in labelled.select("label").where("label is not null").distinct().orderBy("label").limit(LABELS + 1).collect()]
    if len(labels) > LABELS:
        raise ValueError(f"over {LABELS} labels")
    chosen = None
    for label in labels:
        top = labelled.where(F.col("label") == F.lit(label)).select("doc_id", "label").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = top if chosen is None else chosen.union(top)
    if chosen is None:
        return []
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    rows = found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    return [(r.text, r.label) for r in sorted(rows, key=lambda r: (r.doc_id, r.label, r.text))]


def platt(margin: np.ndarray, label: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of a logistic curve through margins, by Newton steps with a little damping; the slope stays positive."""
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g, w = p - label, np.maximum(p * (1 - p), 1e-6)
        h = np.array([[np.dot(w, margin * margin) + 1e-3, np.dot(w, margin)], [np.dot(w, margin), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [np.dot(g, margin) + 1e-3 * (a - 1), g.sum() + 1e-3 * b])
        a, b = max(1e-3, a - np.clip(step[0], -1, 1)), b - np.clip(step[1], -2, 2)
    return float(a), float(b)
