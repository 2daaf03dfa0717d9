"""Toxicity by multiple-instance learning: documents are bags of sentences, combined by noisy-or."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import filter_rows, map_rows
from helixframe.llm.learning import fold, sample

#: Bytes of folded text: sentence ends become line feeds, other ASCII but letters and digits spaces.
_FOLD = bytes(10 if chr(c) in ".!?\n" else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Training defaults: labelled documents a class at most; least toxic documents with a feature, and how much more often
#: than in others; passes, L1 shrinkage a pass, learning rate.
PER_CLASS, LEAST_DOCS, LEAST_LIFT, PASSES, L1, RATE = 2500, 4, 2.5, 250, 2e-5, 0.1
#: Lengths of the word beginnings that are features, besides whole words: inflected words share them.
PREFIXES = (3, 4, 5, 6)
#: Words whose weight a worker remembers.
CACHE = 100_000


def folded(text: str | None) -> bytes:
    """UTF-8 of the text in lower case, as many code points as before; sentences are its lines, words split on spaces."""
    low = (text or "").lower()
    if len(low) != len(text or ""):
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return low.encode("utf-8", "surrogatepass").translate(_FOLD)


def features(raw: bytes) -> list[str]:
    """A word's features: itself, marked, and its beginnings."""
    word = raw.decode("utf-8", "replace")
    return ["=" + word, *(word[:n] for n in PREFIXES if len(word) > n)]


@dataclass
class Model:
    """Feature weights and the offset of a sentence's logit. Features that training set to 0 aren't kept."""

    weights: dict[str, float]
    offset: float

    def __post_init__(self):
        self.seen: set[bytes] = set()
        self.telling: dict[bytes, tuple[str, ...]] = {}

    def evidence(self, words: set[bytes]) -> set[bytes]:
        """Those of the words that have a weighted feature."""
        for w in words - self.seen:
            if found := tuple(x for x in features(w) if x in self.weights):
                self.telling[w] = found
        self.seen |= words
        out = words & self.telling.keys()
        if len(self.seen) > CACHE:
            self.seen, self.telling = set(), {w: self.telling[w] for w in out}
        return out

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences with a weighted feature; the others carry no evidence."""
        flat = folded(text)
        telling = self.evidence(set(flat.split()))
        if not telling:
            return []
        out, at = [], 0
        for s in flat.split(b"\n"):
            n = len(s.decode("utf-8", "surrogatepass"))
            found = {x for w in telling.intersection(s.split()) for x in self.telling[w]}
            if found:
                z = self.offset + sum(self.weights[x] for x in sorted(found))
                out.append((at, at + n, 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))))
            at += n + 1
        return out

    def score(self, found: list[tuple[int, int, float]]) -> float:
        """Noisy-or of the sentences; a document without evidence has the probability of an empty sentence."""
        rest = 1 / (1 + math.exp(self.offset))
        for _, _, p in found:
            rest *= 1 - p
        return 1 - rest


def train(rows: list[tuple[str, int]], passes: int = PASSES, l1: float = L1) -> Model:
    """Fits weights to document labels through the noisy-or of sentence probabilities: Adam on the log-loss, shrunk by L1.

    Only features that toxic documents have at least LEAST_LIFT times as often as others enter: under noisy-or, a
    sentence can't take evidence back from another.
    """
    share = (sum(y for _, y in rows) + 0.5) / (len(rows) + 1)
    constant = Model({}, math.log(share / (1 - share)))
    y = np.array([y for _, y in rows], float)
    if len(set(y)) < 2:
        return constant
    flat = [folded(t) for t, _ in rows]

    def telling(text: bytes) -> set[str]:
        return {x for w in set(text.split()) for x in features(w)}

    toxic, other = Counter(), Counter()
    for t in (t for t, label in zip(flat, y) if label):
        toxic.update(telling(t))
    toxic = Counter({x: n for x, n in toxic.items() if n >= LEAST_DOCS})
    for t in (t for t, label in zip(flat, y) if not label):
        other.update(telling(t) & toxic.keys())
    lift = LEAST_LIFT * y.sum() / (len(y) - y.sum())
    vocabulary = {w: k for k, w in enumerate(sorted(w for w, n in toxic.items() if n >= lift * (other[w] + 0.5)))}
    feature, sentence, doc_of = [], [], []
    for d, t in enumerate(flat):
        for s in t.split(b"\n"):
            ids = sorted({vocabulary[x] for w in s.split() for x in features(w) if x in vocabulary})
            if ids:
                feature += ids
                sentence += [len(doc_of)] * len(ids)
                doc_of.append(d)
    if not doc_of:
        return constant
    feature, sentence, doc_of = np.array(feature), np.array(sentence), np.array(doc_of)
    w, n, docs = np.zeros(len(vocabulary)), len(doc_of), len(rows)
    offset, m, v = -2.0, np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1)
    for t in range(1, passes + 1):
        z = np.clip(np.bincount(sentence, w[feature], n) + offset, -30, 30)
        p = 1 / (1 + np.exp(-z))
        clear = np.bincount(doc_of, np.logaddexp(0, z), docs) + np.logaddexp(0, offset)  # -log of the chance that no sentence is toxic
        odds = np.where(y > 0, -1 / np.expm1(np.maximum(clear, 1e-6)), 1.0) / docs
        dz = p * odds[doc_of]
        g = np.append(np.bincount(feature, dz[sentence], len(w)), dz.sum() + odds.sum() / (1 + math.exp(-offset)))
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        shrink = RATE * l1 / (np.sqrt(v[:-1] / (1 - 0.999**t)) + 1e-8)
        w = w - step[:-1]
        w = np.sign(w) * np.maximum(np.abs(w) - shrink, 0)
        offset -= step[-1]
    return Model({x: float(w[k]) for x, k in vocabulary.items() if w[k]}, float(offset))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Trains on at most per_class documents of each label, of those whose crc32(doc_id) modulo 5 isn't 0."""
    rows = sample(docs, labels.where(fold(5) != 0).select("doc_id", F.col("toxic").alias("label")), per_class)
    return train([(t, int(y)) for t, y in rows])


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, text) to (doc_id, score, predicted, offending): offending are the sentences at or over the threshold.

    Spans are code points, end exclusive. Null and empty texts get the score of a sentence without evidence; repeated
    rows stay; other columns are not read; an empty table gives an empty result.
    """

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value

        def f(doc_id, text):
            found = model.sentences(text)
            p = model.score(found)
            return [(doc_id, p, int(p >= threshold), [{"start": a, "end": b, "score": s} for a, b, s in found if s >= threshold])]

        return f

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, score double, predicted int, offending array<struct<start:int,end:int,score:double>>")


def keep(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below the threshold; null and empty texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        return lambda text: not text or model.score(model.sentences(text)) < threshold

    return filter_rows(docs, make, ["text"])
