"""Benchmark decontamination: Wu-Manber search for windows of benchmark words in documents."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from typing import ClassVar

from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import filter_rows, map_rows

#: Words are runs of what is neither an ASCII character other than 0-9, a-z nor, before folding, A-Z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: The benchmark's words are held by every worker; a larger benchmark is searched in so many parts of at most this many windows.
PART_WINDOWS = 200_000


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WuManber:
    """Patterns of one length m over words: shifts by the last block of a position, buckets by that block's patterns.

    A block is the last B words. A block that ends no pattern lets the search skip m - B + 1 positions, or as many as
    it lies before a pattern's end; where the shift is 0, the bucket's patterns are compared word by word.
    """

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], tuple[str, ...]]):
        self.m, self.b = m, min(2, m)
        self.most = m - self.b + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for p, items in patterns.items():
            for end in range(self.b, m + 1):
                block = self.block(p, end - 1)
                self.shift[block] = min(self.shift.get(block, self.most), m - end)
            self.bucket[self.block(p, m - 1)].append((p, items))

    def block(self, w, i):
        return (w[i - 1], w[i]) if self.b == 2 else w[i]

    def search(self, w: list[bytes]):
        """(start, items) of each occurrence, in order."""
        i, n, m, most, shift = self.m - 1, len(w), self.m, self.most, self.shift.get
        if self.b == 2:
            while i < n:
                s = shift((w[i - 1], w[i]), most)
                if s:
                    i += s
                    continue
                yield from self.confirmed(w, i - m + 1, self.bucket.get((w[i - 1], w[i]), ()))
                i += 1
        else:
            for i in range(n):
                if w[i] in self.bucket:
                    yield from self.confirmed(w, i, self.bucket[w[i]])

    def confirmed(self, w, start, bucket):
        found = tuple(w[start : start + self.m])
        for p, items in bucket:
            if p == found:
                yield start, items


def windows(items: list[tuple[str, str | None]], size: int) -> dict[int, dict[tuple[bytes, ...], tuple[str, ...]]]:
    """Patterns by length: each item's windows of `size` words, or the whole item if it is shorter; without words, none."""
    out: dict[int, dict] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            p = tuple(w[i : i + size])
            out[len(p)][p].add(item)
    return {m: {p: tuple(sorted(x)) for p, x in ps.items()} for m, ps in out.items()}


def benchmark_parts(benchmark: DataFrame) -> Iterator[list[tuple[str, str | None]]]:
    """(item, text) of the benchmark in parts of at most PART_WINDOWS words, or one item; repeated rows once.

    The driver holds one part at a time. Null texts and ids are as hits() says; an empty table is one empty part.
    """
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").distinct()
    part, n = [], 0
    for item, text in rows.orderBy("item", "text").toLocalIterator():
        k = max(1, len(words(text)))
        if part and n + k > PART_WINDOWS:
            yield part
            part, n = [], 0
        part.append((item, text))
        n += k
    yield part


@dataclass
class Search:
    """A broadcast part of the benchmark; each worker process makes its machines once and keeps those of the latest part."""

    patterns: Broadcast

    latest: ClassVar[tuple] = (None, [])

    def machines(self) -> list[WuManber]:
        patterns = self.patterns.value
        if Search.latest[0] is not patterns:
            Search.latest = (patterns, [WuManber(m, p) for m, p in patterns.items()])
        return Search.latest[1]


def hits(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(doc_id, text) and (item_id, text) to (doc_id, n_words, n_hit, items array, hit_words array<int>).

    items are ids, as sorted strings, of the items with a window in the document; hit_words the words that windows
    cover. The benchmark is broadcast in parts of at most PART_WINDOWS windows, and each part is one pass over the
    documents; a benchmark that fits has one pass. Null texts have no words; items without an item_id are searched as
    "null".
    """
    state = docs.select("doc_id", "text", F.lit(None).cast("array<int>").alias("hit_words"), F.lit(None).cast("array<string>").alias("items"))
    parts = benchmark_parts(benchmark)
    part = next(parts)
    while part is not None:
        search = Search(docs.sparkSession.sparkContext.broadcast(windows(part, size)))
        part = next(parts, None)

        def make(search=search, last=part is None):
            found = search.machines()

            def f(doc_id, text, hit_words, items):
                w = words(text)
                hit, who = set(hit_words or ()), set(items or ())
                for x in found:
                    for start, names in x.search(w):
                        hit.update(range(start, start + x.m))
                        who.update(names)
                return [(doc_id, None if last else text, sorted(hit), sorted(who), len(w))]

            return f

        state = map_rows(state.select("doc_id", "text", "hit_words", "items"), make, "doc_id long, text string, hit_words array<int>, items array<string>, n_words long")
    return state.select("doc_id", "n_words", F.size("hit_words").cast("long").alias("n_hit"), "items", "hit_words")


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Empty tables on either side give zero hits or no rows; repeated documents give repeated rows; extra columns of
    either table, also of the same names, are not read.
    """
    return hits(docs, benchmark, size).select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of docs, with all their columns, in whose text no window of the benchmark occurs.

    Null and empty texts stay, repeated rows stay or go together, an empty table of either kind changes nothing.
    """
    for part in benchmark_parts(benchmark):
        search = Search(docs.sparkSession.sparkContext.broadcast(windows(part, size)))

        def make(search=search):
            found = search.machines()
            return lambda text: not any(True for x in found for _ in x.search(words(text)))

        docs = filter_rows(docs, make, ["text"])
    return docs


SQL = r"""
WITH toks AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), bench AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), pats AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS p, least(len(w), 10) AS m
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bench WHERE len(w) > 0)
), lens AS (SELECT DISTINCT m FROM pats),
wins AS (
  SELECT doc_id, i, m, array_to_string(w[i:i + m - 1], ' ') AS p
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM toks, lens WHERE len(w) >= m)
), occ AS (SELECT wins.doc_id, wins.i, wins.m, item_id FROM wins JOIN pats USING (p, m)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM (SELECT DISTINCT doc_id, i, m FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id)
SELECT toks.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM toks LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
