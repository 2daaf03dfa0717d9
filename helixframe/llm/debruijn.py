"""Substring dedup: long word sequences that an earlier document has, by a compacted De Bruijn graph of word k-mers.

Words are hashed; of each window's k-mers the one with the least hash is its anchor, so equal windows have equal
anchors. Anchors are the graph's nodes, the text from one anchor to the end of the next its edges. Spark counts them:
anchors that occur in one document settle their windows at once. Anchors that all occurrences enter and leave by the
same edges are joined with their successors into nonbranching paths. Each occurrence of a path gives its coordinates and
a digest of its words, and repeats its first document's only if the digest at that source's coordinates is the same.
Windows at branches are compared one by one, by two independent hashes of 64 and 32 bits, with their source.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import connected_components, local_forests, map_rows, written

#: Words of a window, words of a k-mer.
WINDOW, KMER = 50, 16
_B1, _B2 = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    x = np.full(n, base, np.uint64)
    x[:1] = 1
    return np.cumprod(x, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """A text's words, as bytes, and hashes of its runs of words."""

    def __init__(self, text: str | None):
        self.words = (text or "").encode("utf-8", "surrogatepass").split()
        self.n = len(self.words)

    def hashed(self) -> None:
        digest, n = xxhash.xxh64_intdigest, self.n
        self.x = np.fromiter((digest(w) for w in self.words), np.uint64, n)
        self.sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(y * _power(b, n), dtype=np.uint64))) for b, y in ((_B1, self.x), (_B2, _mixed(self.x)))]
        self.back = [_power(pow(b, -1, 1 << 64), n + 1) for b in (_B1, _B2)]

    def runs(self, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
        """Hashes of the words [start, end): a polynomial modulo 2**64, mixed; the second set has words hashed anew."""
        s = self.sums[which]
        return _mixed((s[end] - s[start]) * self.back[which][start])

    def anchors(self, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, first window, last window) of each anchor, in order; every window has just one."""
        at = np.arange(self.n - k + 1)
        kmers = self.runs(at, at + k)
        width = window - k + 1
        least = np.lib.stride_tricks.sliding_window_view(kmers, width).argmin(1) + np.arange(self.n - window + 1)
        first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
        return least[first], first, np.concatenate((first[1:], [len(least)])) - 1


def _graph(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(doc_id, text, h) to every document's words, digest, anchors' hashes and the edges around them (0 at its ends)."""

    def make():
        def f(doc_id, text, h):
            w = Words(text)
            sha = hashlib.sha256(b" ".join(w.words)).hexdigest()
            if doc_id is None or w.n < window:
                return [(doc_id, h, w.n, sha, [], [])]
            w.hashed()
            at, _, _ = w.anchors(window, k)
            edges = w.runs(at[:-1], at[1:] + k).view(np.int64).tolist()
            return [(doc_id, h, w.n, sha, w.runs(at, at + k).view(np.int64).tolist(), [0, *edges, 0])]

        return f

    return map_rows(docs.select("doc_id", "text", "h"), make, "doc_id long, h long, n_words long, sha string, kmers array<long>, edges array<long>")


#: Documents whose keys may be broadcast, some 10 MB; with more of them, the texts are joined by key in full.
BROADCAST_KEYS = 200_000


def _with_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """rows by (doc_id, h) with the texts of docs. Where the keys are few, other texts are left out before the shuffle."""
    if rows.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        docs = docs.join(F.broadcast(rows.select("doc_id", "h").distinct()), ["doc_id", "h"], "left_semi")
    return docs.join(rows, ["doc_id", "h"])


def _settled(docs: DataFrame, window: int, k: int) -> DataFrame:
    """(doc_id, h, text, found) to `paths`, occurrences of nonbranching paths, and `starts` of windows, with `one` and `two`, to be compared.

    found has the document's anchors that another document has: index, first document, and path, null at branches. An
    occurrence has the path, the first and last start of its windows, and a digest of its words, from the anchor before
    the path to that after it: they are the same for all.
    """

    def make():
        def f(doc_id, text, h, found):
            w = Words(text)
            w.hashed()
            at, first, last = w.anchors(window, k)
            path = {x["j"]: x["path"] for x in found}
            paths, starts = [], []
            for j in sorted(path):
                if path[j] is None:
                    starts += range(int(first[j]), int(last[j]) + 1)
                elif path.get(j - 1) is None:
                    end = j
                    while path.get(end + 1) is not None:
                        end += 1
                    low, high = int(at[max(0, j - 1)]), int(at[min(end + 1, len(at) - 1)]) + k
                    a, b = int(first[j]), int(last[end])
                    c, d = max(a, low), min(b, high - window)
                    if c <= d:
                        digest = hashlib.blake2b(b" ".join(w.words[low:high]), digest_size=16).digest()
                        paths.append({"path": path[j], "a": c, "b": d, "digest": digest})
                        starts += [*range(a, c), *range(d + 1, b + 1)]
                    else:
                        starts += range(a, b + 1)
            s = np.array(starts, np.int64)
            return [(doc_id, h, paths, starts, w.runs(s, s + window).view(np.int64).tolist(), (w.runs(s, s + window, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist())]

        return f

    return map_rows(docs.select("doc_id", "text", "h", "found"), make, "doc_id long, h long, paths array<struct<path:long,a:int,b:int,digest:binary>>, starts array<int>, one array<long>, two array<int>")


def _compacted(places: DataFrame) -> DataFrame:
    """(kmer, path) of the anchors that all occurrences enter and leave by the same edges; anchors that follow one another share a path.

    All anchors of a path have the same documents, so the pairs that follow one another are first joined within the
    first of these, home, and then over all.
    """
    single = places.groupBy("kmer").agg(F.min("rid").alias("home"), F.min("into").alias("into"), F.max("into").alias("into2"), F.min("out").alias("out"), F.max("out").alias("out2"), F.min("next").alias("next"))
    single, _ = written(single.where("into = into2 and out = out2").select("kmer", "next", "home"))
    follows = single.where("next is not null").join(single.select(F.col("kmer").alias("next")), "next")
    roots = connected_components(local_forests(follows.select(F.col("kmer").alias("a"), F.col("next").alias("b"), "home"), "home"))
    return single.join(roots, single.kmer == roots.node, "left").select("kmer", F.coalesce("root", "kmer").alias("path"))


def _windows(rows: DataFrame) -> DataFrame:
    """Starts (doc_id, h, start, one, two) of windows to those that an earlier document has: (doc_id, h, run)."""
    sources, _ = written(rows.groupBy("one", "two").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").drop("last"))
    return rows.join(sources, ["one", "two"]).where("source < doc_id").select("doc_id", "h", F.struct(F.col("start").alias("a"), F.col("start").alias("b")).alias("run"))


def repeated_runs(docs: DataFrame, window: int = WINDOW, k: int = KMER) -> tuple[DataFrame, DataFrame]:
    """The table of all documents (doc_id, h, n_words, sha), and (doc_id, h, runs) of those that repeat an earlier one.

    runs are ranges [a, b] of starts of windows that a document with a smaller doc_id also has. Null and wordless texts
    have none, rows without a doc_id neither; rows that share one don't repeat one another; an empty table gives empty
    ones. Anchors and windows are counted with map-side partial sums into written tables, and joined back by plain
    joins, which adaptive execution splits at an anchor that a third of all documents have.
    """
    graph, _ = written(_graph(docs, window, k).withColumn("rid", F.monotonically_increasing_id()))
    nodes = graph.select("rid", "doc_id", F.posexplode("kmers").alias("j", "kmer"), "kmers", "edges")
    shared, _ = written(nodes.groupBy("kmer").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where("source < last").select("kmer"))
    nodes = nodes.select("rid", "j", "kmer", F.get("edges", F.col("j")).alias("into"), F.get("edges", F.col("j") + 1).alias("out"), F.get("kmers", F.col("j") + 1).alias("next"))
    places, _ = written(nodes.join(shared, "kmer"))
    paths, _ = written(_compacted(places))
    found = places.select("rid", "j", "kmer").join(paths, "kmer", "left").groupBy("rid").agg(F.collect_list(F.struct("j", "path")).alias("found"))
    found, _ = written(found.join(graph.select("rid", "doc_id", "h"), "rid").drop("rid"))
    compared, _ = written(_settled(_with_texts(docs, found), window, k))

    occurrences = compared.select("doc_id", "h", F.explode("paths").alias("p")).select("doc_id", "h", "p.*")
    sources, _ = written(occurrences.groupBy("path").agg(F.min(F.struct("doc_id", F.col("a").alias("at"), "digest")).alias("source")).select("path", "source.*").withColumnsRenamed({"doc_id": "source", "digest": "told"}))
    judged = occurrences.join(sources, "path").where("source < doc_id")
    same = judged.where("digest = told").select("doc_id", "h", F.struct("a", "b").alias("run"))
    rows = compared.select("doc_id", "h", F.explode(F.arrays_zip("starts", "one", "two")).alias("w")).select("doc_id", "h", F.col("w.starts").alias("start"), "w.one", "w.two")
    other = judged.where("digest <> told").select("path").distinct()
    if other.limit(1).count():  # two texts under one hash: all windows of such paths are compared
        doubtful, _ = written(occurrences.join(other, "path").groupBy("doc_id", "h").agg(F.collect_list(F.struct("a", "b")).alias("runs")))
        rows = rows.union(_starts(_with_texts(docs, doubtful), window))
    runs, _ = written(_windows(rows).union(same).groupBy("doc_id", "h").agg(F.collect_set("run").alias("runs")))
    return graph.select("doc_id", "h", "n_words", "sha"), runs


def _starts(docs: DataFrame, window: int) -> DataFrame:
    """(doc_id, h, text, runs) to the windows that start in the runs: (doc_id, h, start, one, two)."""

    def make():
        def f(doc_id, text, h, runs):
            w = Words(text)
            w.hashed()
            s = np.array(sorted({i for r in runs for i in range(r["a"], r["b"] + 1)}), np.int64)
            one, two = w.runs(s, s + window).view(np.int64).tolist(), (w.runs(s, s + window, 1) >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist()
            return [(doc_id, h, *x) for x in zip(s.tolist(), one, two)]

        return f

    return map_rows(docs.select("doc_id", "text", "h", "runs"), make, "doc_id long, h long, start int, one long, two int")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))


def covered(n: int, runs: list, window: int) -> np.ndarray:
    """Which of n words lie in a window that starts in a run."""
    step = np.zeros(n + 1, np.int64)
    for r in runs:
        step[r["a"]] += 1
        step[r["b"] + window] -= 1
    return np.cumsum(step)[:n] > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, k: int = KMER) -> DataFrame:
    """(doc_id, text) to (doc_id, n_words, n_removed, kept_sha256, kept_text), kept_text null where nothing was removed.

    Null and wordless texts keep nothing, and nothing is removed from them. Rows without a doc_id are neither changed
    nor a source; rows that share a doc_id are one document to each other, and each comes back. Other columns are not
    read; an empty table gives an empty result.
    """
    keyed = _keyed(docs.select("doc_id", "text"))
    every, runs = repeated_runs(keyed, window, k)

    def make():
        def f(doc_id, text, h, found):
            w = Words(text)
            gone = covered(w.n, found, window)
            kept = b" ".join(x for x, g in zip(w.words, gone) if not g)
            return [(doc_id, h, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"))]

        return f

    cleaned = map_rows(_with_texts(keyed, runs).select("doc_id", "text", "h", "runs"), make, "doc_id long, h long, n_removed long, kept_sha256 string, kept_text string")
    cleaned = cleaned.dropDuplicates(["doc_id", "h"])
    joined = every.join(cleaned, ["doc_id", "h"], "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), "kept_text")
