"""Language identification: averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import map_rows
from helixframe.llm.learning import fold, sample

#: Training defaults: labelled documents a language at most, hash bits, embedding width, passes, learning rate.
PER_CLASS, BITS, WIDTH, PASSES, RATE = 800, 15, 16, 5, 0.5
#: Share of the sample's correct predictions that the rejection threshold may refuse.
REFUSED = 0.01
UNKNOWN = "und"
_MIX = np.uint32(2654435761)
_LETTER = regex.compile(r"\p{L}")
_SPACE = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def subwords(text: str | None, bits: int = BITS) -> np.ndarray:
    """Hashed byte n-grams (2 to 4) within words, whose ends a space marks; case and all but letters are folded away."""
    flat = b" " + b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACE).split()) + b" "
    a = np.frombuffer(flat, np.uint8).astype(np.uint32)
    inner = a != 32
    out, v, whole = [], a, None
    for n in (2, 3, 4):
        v = (v[:-1] << np.uint32(8)) | a[n - 1 :] if len(a) >= n else v[:0]
        if n > 2:
            whole = inner[1 : len(v) + 1] if n == 3 else inner[1 : len(v) + 1] & inner[2 : len(v) + 2]
        h = ((v + np.uint32(n * 40503)) * _MIX) >> np.uint32(32 - bits)
        out.append(h if whole is None else h[whole])
    return np.concatenate(out)


@dataclass
class Model:
    """Embeddings times softmax weights, by hashed subword; offsets; temperature and rejection threshold."""

    languages: list[str]
    table: np.ndarray
    offsets: np.ndarray
    temperature: float = 1.0
    reject: float = 0.0

    def logits(self, found: np.ndarray) -> np.ndarray:
        return (self.table[found].sum(0) / max(1, len(found)) if len(found) else np.zeros(len(self.languages))) + self.offsets

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, calibrated probability, rejected); a text without letters is unknown, with probability 0."""
        if not self.languages or text is None or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        z = self.logits(subwords(text)) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        k = int(p.argmax())
        return self.languages[k], float(p[k]), bool(p[k] < self.reject)


def train(data: list[tuple[str, str]], passes: int = PASSES, rate: float = RATE) -> Model:
    """Stochastic gradient descent on documents in a fixed random order; every tenth document calibrates.

    The temperature minimises the log-loss of the calibration documents; the rejection threshold is the probability
    below which REFUSED of those that were right lie.
    """
    languages = sorted({y for _, y in data})
    if not languages:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros(0))
    rng = np.random.default_rng(0)
    e = rng.normal(0, 1 / WIDTH, (1 << BITS, WIDTH)).astype(np.float32)
    w, b = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    rows = []
    for t, y in data:
        ids, n = np.unique(subwords(t), return_counts=True)
        rows.append((ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32), languages.index(y)))
    held = np.arange(len(rows)) % 10 == 9
    learn = np.flatnonzero(~held)
    for k in range(passes):
        for i in rng.permutation(learn):
            ids, share, y = rows[i]
            x = share @ e[ids]
            z = x @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            step = rate * (1 - k / passes)
            e[ids] -= (10 * step * share)[:, None] * (w @ p)[None]
            w -= step * np.outer(x, p)
            b -= 0.1 * step * p
    model = Model(languages, e @ w, b)
    z = np.array([share @ model.table[ids] + b for (ids, share, _), h in zip(rows, held) if h])
    if len(z):
        y = np.array([y for (_, _, y), h in zip(rows, held) if h])

        def probabilities(t: float) -> np.ndarray:
            q = np.exp((z - z.max(1, keepdims=True)) / t)
            return q / q.sum(1, keepdims=True)

        model.temperature = min((float(t) for t in np.geomspace(0.05, 20, 60)), key=lambda t: -np.log(probabilities(t)[np.arange(len(y)), y] + 1e-12).sum())
        p = probabilities(model.temperature)
        right = p.max(1)[p.argmax(1) == y]
        model.reject = float(np.quantile(right, REFUSED)) if len(right) else 0.0
    return model


def fit(docs: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Trains on at most per_class documents of each language, of those whose crc32(doc_id) modulo 4 isn't 2."""
    return train(sample(docs, docs.where(fold(4) != 2).select("doc_id", F.col("lang").alias("label")), per_class))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) to (doc_id, lang_pred, score, rejected): the likeliest language of the whole text.

    lang_pred is "und" with score 0 where the text is null or has no letter; rejected marks predictions whose
    calibrated probability lies below the model's threshold. Repeated rows stay; other columns are not read; an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        return lambda doc_id, text: [(doc_id, *m.predict(text))]

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, lang_pred string, score double, rejected boolean")
