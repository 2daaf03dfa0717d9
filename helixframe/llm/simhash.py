"""SimHash near-duplicate detection with pigeonhole blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from helixframe.llm.common import connected_components, cut, map_rows, numbers, release, small_batches, written

SEED = 42
#: A bucket of up to so many fingerprints is compared within one task; a larger one is keyed anew on more of its bits.
BUCKET = 16384


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of the text's word shingles, repeats included; a shorter text is one shingle, one without words none."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, "<u8")
    flat = b" ".join(w)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(flat, SEED)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1)
    starts = np.concatenate(([0], ends[: len(w) - words])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())), "<u8", len(starts))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if over half of the hashes have it; 0 for none. As a signed 64-bit number."""
    if not len(hashes):
        return 0
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 255 * 64):
        part = hashes[i : i + 255 * 64]
        part = np.concatenate((part, np.zeros(-len(part) % 255, "<u8")))
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 255, 8), axis=2, bitorder="little").sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, text) to (doc_id, fp): the 64-bit fingerprint of the whole text, ASCII case folded."""

    def make():
        return lambda doc_id, text: [(doc_id, fingerprint(shingle_hashes(text, words)))]

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, fp long")


@cache
def masks(fixed: int, distance: int) -> tuple[int, ...]:
    """Pigeonhole masks: the bits outside `fixed` in distance + 2 blocks; two close fingerprints agree on some two of them."""
    free = [i for i in range(64) if not fixed >> i & 1]
    n = distance + 2
    blocks = [sum(1 << i for i in free[len(free) * k // n : len(free) * (k + 1) // n]) for k in range(n)]
    return tuple(fixed | a | b for a, b in combinations(blocks, 2))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _forest(group: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that span the group's components under the distance; fewer than it has members."""
    out, rest = [], group[1:]
    todo = [group[0]]
    while len(rest):
        at = todo.pop() if todo else None
        if at is None:
            todo, rest = [rest[0]], rest[1:]
            continue
        near = np.bitwise_count(rest ^ at) <= distance
        found = rest[near]
        out += [(at, x) for x in found]
        todo += list(found)
        rest = rest[~near]
    return out


def _compare(distance: int, bucket: int):
    """Streams rows (mask, key, fp) sorted by bucket; yields links (a, b, 0), or (mask, fp, 1) for members of overfull buckets."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("kind", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, over = np.zeros((0, 3), np.int64), None

        def judged(rows: np.ndarray, last: bool):
            nonlocal held, over
            links: list[tuple[int, int, int]] = []
            rows = np.concatenate((held, rows))
            cuts = np.flatnonzero((rows[1:, :2] != rows[:-1, :2]).any(1)) + 1
            ends = np.concatenate((cuts, [len(rows)])) if len(rows) else np.zeros(0, np.int64)
            starts = np.concatenate(([0], cuts))[: len(ends)]
            n = ends - starts
            whole = np.ones(len(n), bool)
            if len(n) and not last:
                whole[-1] = False
            same = np.array([over is not None and tuple(rows[s, :2]) == over for s in starts[:1]] + [False] * max(0, len(n) - 1), bool)
            pair = starts[(n == 2) & whole & ~same]
            near = pair[np.bitwise_count((rows[pair, 2] ^ rows[pair + 1, 2]).view(np.uint64)) <= distance]
            links += [(a, b, 0) for a, b in zip(rows[near, 2].tolist(), rows[near + 1, 2].tolist())]
            for k in np.flatnonzero(((n > 2) | same) & (whole | (n > bucket) | same)):
                s, e = starts[k], ends[k]
                free = 64 - (int(rows[s, 0]) & (2**64 - 1)).bit_count()
                if same[k] or n[k] > bucket and (free > 12):
                    over = tuple(rows[s, :2])
                    links += [(m, f, 1) for m, f in zip(rows[s:e, 0].tolist(), rows[s:e, 2].tolist())]
                    if k == len(n) - 1:
                        ends[k] = starts[k] = len(rows)
                elif whole[k]:
                    links += [(int(a.view(np.int64)), int(b.view(np.int64)), 0) for a, b in _forest(rows[s:e, 2].view(np.uint64), distance)]
            held = rows[starts[-1] :] if len(n) and not last else rows[:0]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*links), arrow)], schema=arrow)

        for rows in numbers(batches, 20_000):
            yield from judged(rows, False)
        yield from judged(np.zeros((0, 3), np.int64), True)
        release()

    return run


def links(fps: DataFrame, distance: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) whose transitive closure joins all distinct fingerprints of column fp within the Hamming distance.

    Blocks: distance + 2, so two close fingerprints agree on two whole blocks; each of the pairs of blocks is a join
    key. The rows of a key stream, sorted, through one task that keeps at most `bucket` of them; a larger bucket is
    split on pairs of blocks of its remaining bits, until 12 are left, so every bucket is compared in full.
    """
    spark = fps.sparkSession
    rows = fps.select("fp", F.explode(F.array(*(F.lit(_signed(m)) for m in masks(0, distance)))).alias("mask"))
    done = None
    while True:
        rows = rows.select("mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
        out = cut(small_batches(rows).repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(_compare(distance, bucket), "a long, b long, kind int"))
        done = out.where("kind = 0") if done is None else done.union(out.where("kind = 0"))
        more = out.where("kind = 1")
        if more.isEmpty():
            return done.select("a", "b").distinct()
        made = [(r.a, [_signed(x) for x in masks(r.a & (2**64 - 1), distance)]) for r in more.select("a").distinct().collect()]  # of each level at most 15 times the one before
        split = spark.createDataFrame(made, "a long, finer array<long>")
        rows = more.join(F.broadcast(split), "a").select(F.col("b").alias("fp"), F.explode("finer").alias("mask"))


def components(fps: DataFrame, distance: int = 4) -> DataFrame:
    """(doc_id, fp) to (doc_id, fp, component_id), component_id the smallest doc_id that links reach.

    Rows with equal fingerprints are one node; no pairs within a group of copies are formed. Rows without a doc_id
    keep their component; a component of such rows only has the id null.
    """
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(nodes.select("fp"), distance))
    nodes = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = nodes.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(nodes.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def simhash_groups(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """Near-duplicate groups of (doc_id, text): doc_id, fingerprint, component_id for every row.

    Null or wordless texts have fingerprint 0 and are linked like any other; repeated rows come back as often as they
    are given; other columns, whatever their names, are not read. An empty table gives an empty result.
    """
    out = components(cut(fingerprints(docs, words)), distance)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For deduplication at a similarity: shingles of a sample of one in SAMPLE texts that SEEN or more of them have count as
#: frequent and come last in the order of shingles, at most FREQUENT of them.
SAMPLE, SEEN, FREQUENT = 16, 4, 1_000_000
#: A shingle that so many texts lead with is paired in full at once; over it, each text with so many others at first.
WHOLE, FIRST = 128, 3
#: Bits of the parity sketch of a set of shingles, and texts that one task compares the others of a large key with.
SKETCH, BLOCK = 1024, 4096
#: Up to so many ids, as counted, go to the texts; beyond, the texts are dealt out by their ids.
SENT_IDS = 4_000_000


def _mapped(df: DataFrame, make, schema: str) -> DataFrame:
    """mapInArrow of a function from a batch's columns to columns of the result."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(f(*batch.columns), arrow)], schema=arrow)
        release()

    return small_batches(df).mapInArrow(run, schema)


def _least(share: float, n):
    """The least whole number of n or more at a share, safe against rounding."""
    return np.ceil(share * np.asarray(n) - 1e-9).astype(np.int64)


def _frequent(docs: DataFrame, words: int) -> np.ndarray:
    """Hashes of shingles that many texts have, sorted. It only decides the order of shingles, so a sample will do."""

    def make():
        return lambda texts: [np.concatenate([np.unique(shingle_hashes(t, words)) for t in texts.to_pylist()]).view("<i8")]

    some = docs.where(F.xxhash64("doc_id") % SAMPLE == 0).select("text")
    counts = _mapped(some, make, "shingle long").groupBy("shingle").count().where(F.col("count") >= SEEN)
    found = counts.orderBy(F.desc("count"), "shingle").limit(FREQUENT).select("shingle").toArrow().column(0).to_numpy()
    return np.sort(found.astype("<i8").view("<u8"))


def _leading(hashes: np.ndarray, frequent: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, rare ones first, then by hash: any set as similar has one of its own first ones among these."""
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        often = frequent[at] == hashes
        hashes = np.concatenate((hashes[~often], hashes[often]))
    return hashes[: len(hashes) - int(_least(similarity, len(hashes))) + 1]


def _sketch(hashes: np.ndarray) -> bytes:
    """Parity of the hashes in each of SKETCH cells: two sets differ in at least as many elements as their sketches in bits."""
    cells = np.bincount((hashes >> np.uint64(64 - SKETCH.bit_length() + 1)).astype(np.int64), minlength=SKETCH)
    return np.packbits(cells & 1).tobytes()


def _batches(parts: Iterator[np.ndarray], names: list[str], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Rows, as arrays, in batches of some `most` rows."""
    size, out = 0, []
    for part in parts:
        out.append(part)
        size += len(part)
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out).T], names)
            size, out = 0, []
    if size:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out).T], names)


def _meet(similarity: float, whole: int, first: int):
    """Streams rows (key, n, id) sorted by key; yields pairs whose sizes allow the similarity.

    Rows (a, b, na, nb, kind): kind 0 from keys of up to `whole` texts, all pairs. Of a larger key, kind 1 are the pairs
    of texts that stand up to `first` rows apart; its members follow as (id, key, n, 0, 2). At most `whole` rows of a
    key, or a batch's, are held at once.
    """
    names = ["a", "b", "na", "nb", "kind"]

    def pairs(rows: np.ndarray, kind: int, old: int = 0):
        """Pairs of the rows of a key, the first `old` of which have been paired with one another."""
        n, ids = rows[:, 1], rows[:, 2]
        for d in range(1, len(rows) if kind == 0 else min(len(rows), first + 1)):
            at = np.arange(max(0, old - d), len(rows) - d)
            at = at[np.minimum(n[at], n[at + d]) >= similarity * np.maximum(n[at], n[at + d]) - 1e-9]
            swap = ids[at] > ids[at + d]
            x, y = np.where(swap, at + d, at), np.where(swap, at, at + d)
            yield np.stack((ids[x], ids[y], n[x], n[y], np.full(len(at), kind)), 1)

    def members(rows: np.ndarray):
        yield np.stack((rows[:, 2], rows[:, 0], rows[:, 1], np.zeros(len(rows), np.int64), np.full(len(rows), 2)), 1)

    def found(batches: Iterator[pa.RecordBatch]):
        held, large = np.zeros((0, 3), np.int64), False
        for rows in numbers(batches, 4096):
            rows = np.concatenate((held, rows))
            edges = np.concatenate(([0], np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1, [len(rows)]))
            for k in np.flatnonzero(np.diff(edges) > 1):
                group, last = rows[edges[k] : edges[k + 1]], k == len(edges) - 2
                old = len(held) if k == 0 and large else 0
                if len(group) > whole or old:
                    yield from pairs(group, 1, old)
                    yield from members(group[old:])
                elif not last:
                    yield from pairs(group, 0)
            group = rows[edges[-2] :]
            large = len(group) > whole or len(edges) == 2 and large
            held = group[-first:] if large else group
        if len(held) > 1 and not large:
            yield from pairs(held, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(found(batches), names)
        release()

    return run


def _against(similarity: float):
    """Streams rows (key, block, side, id, n, root, sketch) sorted so; yields the pairs (a, b) of different roots that may be as similar.

    Of each key and block the rows of side 0 are held, some BLOCK of them, and those of side 1 compared with them.
    """
    share = (1 - similarity) / (1 + similarity)

    def numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        words = np.frombuffer(b"".join(batch.column(6).to_pylist()), "<u8").reshape(-1, SKETCH // 64)
        return np.stack([c.to_numpy() for c in batch.columns[:6]], 1), words

    def near(x: np.ndarray, xw: np.ndarray, y: np.ndarray, yw: np.ndarray):
        for k in range(len(x)):
            n, m = x[k, 4], y[:, 4]
            at = np.flatnonzero((y[:, 5] != x[k, 5]) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-9))
            apart = np.bitwise_count(yw[at] ^ xw[k]).sum(1, dtype=np.int64)
            ids = y[at[apart <= share * (n + m[at]) + 1e-9], 3]
            yield np.stack((np.minimum(ids, x[k, 3]), np.maximum(ids, x[k, 3])), 1)

    def found(batches: Iterator[pa.RecordBatch]):
        held, words, now = [], [], None
        for batch in batches:
            rows, sketches = numbers(batch)
            cuts = [0, *(np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(1)) + 1).tolist(), len(rows)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if tuple(rows[i, :2]) != now:
                    held, words, now = [], [], tuple(rows[i, :2])
                if rows[i, 2] == 0:
                    held.append(rows[i:j])
                    words.append(sketches[i:j])
                elif held:
                    held, words = [np.concatenate(held)], [np.concatenate(words)]
                    yield from near(held[0], words[0], rows[i:j], sketches[i:j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(found(batches), ["a", "b"])
        release()

    return run


def _few(ids: DataFrame) -> DataFrame:
    """A column of ids, written, and sent to the tasks of what it is joined with if it is small enough."""
    ids, _ = written(ids)
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are as similar, by the sets themselves."""

    def make_set():
        def f(ids, texts):
            sets = [np.unique(shingle_hashes(t, words)).tobytes() for t in texts.to_pylist()]
            return ids, [xxhash.xxh3_128_digest(x) for x in sets], sets

        return f

    def make_check():
        def f(a, b, one, two):
            good = np.zeros(len(a), bool)
            for k, (x, y) in enumerate(zip(one, two)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                good[k] = both >= similarity * (len(x) + len(y) - both) - 1e-9
            return a.filter(pa.array(good)), b.filter(pa.array(good))

        return f

    some = _few(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    sets = _mapped(docs.join(some, "doc_id", "left_semi"), make_set, "id long, sig binary, set binary")
    sets = sets.join(nodes.select("id", "sig"), ["id", "sig"], "left_semi").dropDuplicates(["id", "sig"])
    sets, _ = written(sets.select("id", "set"))
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("one")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("two")), "b")
    return cut(_mapped(both.select("a", "b", "one", "two"), make_check, "a long, b long"))


def _printed(nodes: DataFrame, distance: int) -> DataFrame:
    """Pairs (a, b) of ids that join all nodes (id, n, fp) whose fingerprints lie within the distance."""
    nodes = nodes.where("n > 0").select("id", "fp")
    first = cut(nodes.groupBy("fp").agg(F.min("id").alias("first")))
    same = nodes.join(first, "fp").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    one, two = (first.select(F.col("fp").alias(c), F.col("first").alias(f"of_{c}")) for c in "ab")
    near = links(first.select("fp"), distance).join(one, "a").join(two, "b")
    return same.union(near.select(F.least("of_a", "of_b"), F.greatest("of_a", "of_b")))


def _open(pairs: DataFrame, nodes: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b, na, nb) whose roots differ and whose sketches allow the similarity, as (a, b)."""
    share = (1 - similarity) / (1 + similarity)

    def make():
        def f(a, b, na, nb, one, two):
            x, y = (np.frombuffer(b"".join(c.to_pylist()), "<u8").reshape(-1, SKETCH // 64) for c in (one, two))
            good = pa.array(np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= share * (na.to_numpy() + nb.to_numpy()) + 1e-9)
            return a.filter(good), b.filter(good)

        return f

    known = nodes.select("id", "sketch").join(roots, nodes.id == roots.node, "left").select("id", "sketch", F.coalesce("root", "id").alias("root"))
    one, two = (known.select(F.col("id").alias(c), F.col("sketch").alias(f"sketch_{c}"), F.col("root").alias(f"root_{c}")) for c in "ab")
    both = pairs.join(one, "a").join(two, "b").where("root_a <> root_b")
    return _mapped(both.select("a", "b", "na", "nb", "sketch_a", "sketch_b"), make, "a long, b long").distinct()


def _rest(full: DataFrame, nodes: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of members (key, id, n) of large keys that may be as similar and whose roots differ.

    Of each key, the texts outside its largest root are dealt out in blocks of some BLOCK, and all members pass by each
    block; only pairs that their sketches allow come out.
    """
    full, _ = written(full.join(roots, full.id == roots.node, "left").select("key", "id", "n", F.coalesce("root", "id").alias("root")))
    counts = full.groupBy("key", "root").agg(F.count("*").alias("c"))
    keys = counts.groupBy("key").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("c"))
    keys = keys.select("key", F.col("top.root").alias("top"), F.ceil((F.col("c") - F.col("top.c")) / BLOCK).cast("int").alias("blocks")).where("blocks > 0")
    rows = full.join(keys, "key").join(nodes.select("id", "sketch"), "id")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("long")
    some = F.when(F.col("root") != F.col("top"), F.array(F.struct(block.alias("block"), F.lit(0).cast("long").alias("side")))).otherwise(F.expr("cast(array() as array<struct<block:bigint,side:bigint>>)"))
    every = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(k.cast("long").alias("block"), F.lit(1).cast("long").alias("side")))
    rows = rows.select("key", "id", "n", "root", "sketch", F.explode(F.concat(some, every)).alias("to")).select("key", "to.block", "to.side", "id", "n", "root", "sketch")
    rows = rows.repartition("key", "block").sortWithinPartitions("key", "block", "side", "id")
    return rows.mapInArrow(_against(similarity), "a long, b long").distinct()


def representatives(docs: DataFrame, words: int = 5, similarity: float = 0.8, bucket: int = WHOLE, distance: int = 4) -> DataFrame:
    """doc_id of one document, the smallest, of each group of near duplicates of (doc_id, text).

    SimHash first: fingerprints of the shingles within the distance, found by links() as in simhash_groups, make pairs
    that are verified by the sets of shingle hashes. What these don't join, an exact check completes, as fingerprints
    at the similarity may differ in more bits. It is a prefix filter, without chance: in one order of all shingles, two sets that are as similar share one of their
    first n - ceil(similarity * n) + 1 shingles, so each of these is a join key. A pair that shares too few of them to
    reach the similarity is dropped, as is one that is joined already or that sketches rule out; the others are verified
    by their sets of shingle hashes (64 bits). Of a key of more
    than `bucket` texts, each is paired with a few others first, others for each key, which joins most of a large group;
    what that leaves apart is then compared with the key's other texts by sketches that lose no pair, so large groups
    don't make all their pairs. Texts without words are copies of one another. Rows without a doc_id are left out.
    """
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(docs, words))

    def make():
        def f(ids, texts):
            hashes = [shingle_hashes(t, words) for t in texts.to_pylist()]
            prints, sets = [fingerprint(x) for x in hashes], [np.unique(x) for x in hashes]
            digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
            return ids, digests, [len(x) for x in sets], [_leading(x, frequent.value, similarity).tobytes() if len(x) else b"" for x in sets], [_sketch(x) for x in sets], prints

        return f

    def make_keys():
        def f(ids, n, leading):
            keys = [np.frombuffer(x.as_buffer(), "<i8") for x in leading]
            times = [len(k) for k in keys]
            return np.concatenate(keys), np.repeat(n.to_numpy(), times), np.repeat(ids.to_numpy(), times)

        return f

    prints = _mapped(docs, make, "doc_id long, sig binary, n long, leading binary, sketch binary, fp long")
    nodes = cut(prints.groupBy("sig").agg(F.min("doc_id").alias("id"), F.min("fp").alias("fp"), *(F.first(c).alias(c) for c in ("n", "leading", "sketch"))))
    roots = cut(connected_components(_verified(cut(_printed(nodes, distance).distinct()), docs, nodes, words, similarity)))
    rows = _mapped(nodes.select("id", "n", "leading").where("n > 0"), make_keys, "key long, n long, id long")
    # equal sizes, roughly, stand together; within these, each key has its own order
    rows = rows.repartition("key").sortWithinPartitions("key", F.floor(F.log("n") / max(1e-6, -math.log(similarity))), F.xxhash64("key", "id"), "id").select("key", "n", "id")
    met, _ = written(rows.mapInArrow(_meet(similarity, bucket, FIRST), "a long, b long, na long, nb long, kind long"))
    need = F.ceil((F.col("na") + F.col("nb")) * (similarity / (1 + similarity)) - 1e-9)
    rest = F.greatest(*(F.ceil(F.col(c) * similarity - 1e-9) - 1 for c in ("na", "nb")))
    close = met.where("kind < 2").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"), F.max("kind").alias("kind")).where((F.col("kind") == 1) | (F.col("shared") + rest >= need))
    more = _verified(cut(_open(close.select("a", "b", "na", "nb"), nodes, roots, similarity)), docs, nodes, words, similarity)
    joined = lambda roots, more: connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    roots = joined(roots, more)
    full = met.where("kind = 2").select(F.col("b").alias("key"), F.col("a").alias("id"), F.col("na").alias("n"))
    if full.limit(1).count():
        roots = cut(roots)
        found = _verified(cut(_rest(full, nodes, roots, similarity)), docs, nodes, words, similarity)
        roots = joined(roots, found)
    return nodes.join(roots, nodes.id == roots.node, "left").where("root is null or root = id").select(F.col("id").alias("doc_id")).distinct()


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, with all their columns, but for near duplicates of a document with a smaller doc_id.

    Rows without a doc_id stay; rows that share one stay or go together.
    """
    gone = _few(docs.select("doc_id").where("doc_id is not null").distinct().join(representatives(docs, words, similarity), "doc_id", "left_anti"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
