"""A trie of conversation prefixes: LCP-aware external mergesort, and a stack of open nodes over the merged stream.

A turn is a code of 20 bytes (a digest of role and text, and the text's bytes), a conversation the codes of its turns, one
after another: its path. Bytes compare as turns do, so paths that share turns stand together in their order.

1. Each task cuts what it reads into runs, sorts each and stores with every path how many turns it shares with the one
   before (its LCP). The runs are written to the shared folder; none is larger than RUN_ROWS paths or RUN_BYTES bytes.
2. The order of (path, conversation) is dealt out by ranges. A range gets its part of every run and merges the parts by a
   loser tree, which compares two paths only beyond the turns that both share with the last one given out.
3. The merged stream, path by path, closes the nodes that the next path doesn't share. What is closed is whole, unless it
   begins the range's first or last path: such nodes of a range go on in others, and are summed up by node afterwards.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import dropped, release, small_batches, written
from helixframe.llm.merkle import CRC32_SQL

#: Bytes of a turn's code: 16 of its digest, 4 of the count of its text's UTF-8 bytes.
CODE = 20
#: A run ends at so many paths or bytes.
RUN_ROWS, RUN_BYTES = 8192, 4 << 20
#: Bytes of paths in a range, by which their number is chosen.
RANGE_BYTES = 16 << 20

NODE = {"conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string()}
#: What a range has of a node that begins its first or last path. `part`, `side` and depth order first sights of nodes as their paths are ordered.
PART = {"key": pa.binary(), "parent": pa.binary(), "part": pa.int64(), "side": pa.int64(), "size": pa.int64(), "ends": pa.binary()}
_KINDS = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def _ddl(kinds: dict) -> str:
    return ", ".join(f"{c} {_KINDS[t]}" for c, t in kinds.items())


def _batch(rows: list, kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], list(kinds))


def _in_batches(rows: Iterator[tuple], kinds: dict, most: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _batch(held, kinds)
            held = []
    if held:
        yield _batch(held, kinds)
    release()


def shared(a: bytes, b: bytes, least: int = 0) -> int:
    """Turns that two paths share from the first on; `least` are known to be."""
    n = min(len(a), len(b)) // CODE
    step = 1
    while least < n and step:  # strides double while they hold, and halve where they don't
        to = min(n, least + step)
        if a[least * CODE : to * CODE] == b[least * CODE : to * CODE]:
            least, step = to, step * 2
        else:
            step //= 2
    return least


def sorted_run(rows: list[tuple[bytes, int]]) -> list[tuple[bytes, int, int]]:
    """(path, conv_id) in order, each with its LCP, in turns, with the one before; 0 for the first."""
    rows.sort()
    out, last = [], b""
    for i, (path, conv) in enumerate(rows):
        out.append((path, conv, shared(last, path) if i else 0))
        last = path
    return out


class LoserTree:
    """Merges sorted runs of (path, conv_id, LCP) into one such stream.

    Each head carries its LCP with the last row given out, whose order it can't precede: of two heads, the one with the
    larger LCP comes first, unseen; only if they are equal are the paths compared, from there on, and the loser's LCP
    becomes that with the winner.
    """

    def __init__(self, runs: list[Iterator[tuple[bytes, int, int]]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.width = max(1, len(runs))
        self.tree = [-1] * self.width  # inner nodes hold the losers of their matches, tree[0] the winner
        self.tree[0] = self._play(1) if runs else -1

    def _play(self, at: int) -> int:
        if at >= self.width:
            return at - self.width
        left, right = self._play(2 * at), self._play(2 * at + 1)
        winner, self.tree[at] = self._match(left, right)
        return winner

    def _match(self, i: int, j: int) -> tuple[int, int]:
        """Winner and loser of two runs' heads."""
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return (i, j) if b is None else (j, i)
        if a[2] != b[2]:
            return (i, j) if a[2] > b[2] else (j, i)
        lcp = shared(a[0], b[0], a[2])
        after = slice(lcp * CODE, lcp * CODE + CODE)
        winner, loser = (i, j) if (a[0][after], a[1]) <= (b[0][after], b[1]) else (j, i)
        path, conv, _ = self.heads[loser]
        self.heads[loser] = (path, conv, lcp)
        return winner, loser

    def __iter__(self) -> Iterator[tuple[bytes, int, int]]:
        if not self.runs:
            return
        while (row := self.heads[top := self.tree[0]]) is not None:
            yield row
            self.heads[top] = next(self.runs[top], None)
            at = (top + self.width) // 2
            while at:
                top, self.tree[at] = self._match(top, self.tree[at])
                at //= 2
            self.tree[0] = top


@dataclass
class Node:
    """A node while the stream is below it; the counts are of what has been closed below it, and of its own members."""

    depth: int
    size: int  # bytes of its last text
    edge: bool = False  # it begins the range's first path
    key: bytes | None = None  # given where it spans ranges
    conv: int | None = None
    convs: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    ends: list[bytes] = field(default_factory=list)  # decimal ids of members that end here
    waiting: list[tuple] = field(default_factory=list)  # closed children, whose parent's smallest member isn't known yet

    def hold(self, conv: int | None, convs: int) -> None:
        self.convs += convs
        if conv is not None and (self.conv is None or conv < self.conv):
            self.conv = conv

    def close(self, ends: str, parent: Node | None) -> Iterator[tuple]:
        """The node is whole: its children's rows are; it waits at its parent, or is the root."""
        self.leaves = self.leaves if self.children else 1
        self.saved += (self.convs - 1) * self.size
        for row in self.waiting:
            yield (*row[:2], self.conv, *row[3:])
        row = (self.conv, self.depth, None, self.convs, self.children, self.leaves, self.saved, ends, self.key)
        if parent is None:
            yield row
            return
        parent.hold(self.conv, self.convs)
        parent.children += 1
        parent.leaves += self.leaves
        parent.saved += self.saved
        parent.waiting.append(row)


def _keys(path: bytes) -> list[bytes]:
    """A digest of each of a path's beginnings, by their turns."""
    so_far, out = hashlib.sha256(), []
    for i in range(0, len(path) + 1, CODE):
        out.append(so_far.digest()[:16])
        so_far.update(path[i : i + CODE])
    return out


def finished_nodes(stream: Iterator[tuple[bytes, int, int]], part: int) -> Iterator[tuple]:
    """Rows (path, conv_id, LCP) of a range, in order, to rows of NODE and PART.

    Whole nodes have no key; they have their parent's key instead of its smallest member if the parent isn't whole. Of
    the others, n_leaves and saved_tokens are those of whole nodes below, the rest what belongs to no other such node.
    """
    stack: list[Node] = []
    first: list[bytes] = []
    path = b""
    rest = (None,) * (len(PART) - 2)

    def pop(depth: int, last: list[bytes] | None) -> Iterator[tuple]:
        while len(stack) > depth + 1:
            node = stack.pop()
            if node.edge or last:
                key, side = (first[node.depth], 0) if node.edge else (last[node.depth], 1)
                for row in node.waiting:
                    yield (*row, key, *rest)
                ends = b",".join(node.ends) if node.ends else None
                yield (node.conv, node.depth, None, node.convs, node.children, node.leaves, node.saved, None, key, None, part, side, node.size, ends)
            else:
                for row in node.close(hashlib.sha256(b",".join(node.ends)).hexdigest(), stack[-1]):
                    yield (*row, None, *rest)

    for path, conv, lcp in stream:
        edge = not stack
        if edge:
            first = _keys(path)
            stack.append(Node(0, 0, True))
        yield from pop(lcp, None)
        for depth in range(len(stack), len(path) // CODE + 1):
            stack.append(Node(depth, int.from_bytes(path[depth * CODE - 4 : depth * CODE], "big"), edge))
        stack[-1].hold(conv, 1)
        stack[-1].ends.append(str(conv).encode())
    if stack:
        yield from pop(-1, _keys(path))


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int, int]]:
    """Turns (block, conv_id, code, part), a block's first conversation first, to (path, conv_id, part)."""
    block = conv = part = None
    lent, codes = b"", bytearray()

    def path() -> bytes:
        h = zlib.crc32(str(conv).encode()) % 9
        return bytes(lent[: h * CODE] + codes[h * CODE :])

    for batch in batches:
        for of, now, code, at in zip(*(c.to_pylist() for c in batch.columns)):
            if now != conv and conv is not None:
                if conv == block:
                    lent = bytes(codes[: 8 * CODE])
                yield path(), conv, part
                codes = bytearray()
            if of != block:
                lent = b""
            block, conv, part = of, now, at
            codes += code
    if conv is not None:
        if conv == block:
            lent = bytes(codes[: 8 * CODE])
        yield path(), conv, part


_RUN = {"path": pa.binary(), "conv_id": pa.int64(), "run": pa.int64(), "number": pa.int64(), "lcp": pa.int64()}


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of what a task reads."""

    def rows():
        held, size, n = [], 0, 0
        for path, conv, part in _rebuilt(batches):
            held.append((path, conv))
            size += len(path)
            if len(held) == RUN_ROWS or size >= RUN_BYTES:
                yield from ((*row[:2], part << 32 | n, i, row[2]) for i, row in enumerate(sorted_run(held)))
                held, size, n = [], 0, n + 1
        if held:
            yield from ((*row[:2], part << 32 | n, i, row[2]) for i, row in enumerate(sorted_run(held)))

    yield from _in_batches(rows(), _RUN)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's parts of all runs to its nodes."""
    runs: dict[int, list] = {}
    part = 0
    for batch in batches:
        for path, conv, run, number, lcp, part in zip(*(c.to_pylist() for c in batch.columns)):  # noqa: B007
            runs.setdefault(run, []).append((number, path, conv, lcp))
    for rows in runs.values():
        rows.sort()
        rows[0] = (*rows[0][:3], 0)  # what stood before it is in another range
    tree = LoserTree([((path, conv, lcp) for _, path, conv, lcp in rows) for rows in runs.values()])
    yield from _in_batches(finished_nodes(iter(tree), part), NODE | PART)


_SUMMED = {"key": pa.binary(), "conv_id": pa.int64(), "depth": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "size": pa.int64(), "part": pa.int64(), "side": pa.int64(), "ends_sha256": pa.string()}


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges' rows of a node, in their order, to one; the ids' text goes through the hash and isn't held."""

    def rows():
        key = node = row = ends = None

        def done():
            return (key, node.conv, node.depth, node.convs, node.children, node.leaves, node.saved, node.size, *row, ends.hexdigest())

        for batch in batches:
            for now, conv, depth, convs, children, leaves, saved, size, part, side, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now != key:
                    if node:
                        yield done()
                    key, node, row, ends, begun = now, Node(depth, size), (part, side), hashlib.sha256(), False
                node.hold(conv, convs)
                node.children += children
                node.leaves += leaves
                node.saved += saved
                if text is not None:
                    ends.update(b"," * begun + text)
                    begun = True
        if node:
            yield done()

    yield from _in_batches(rows(), _SUMMED)


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that span ranges, in the order of their paths, to whole ones; the same stack over what is left open."""

    def rows():
        stack: list[tuple[Node, str]] = []

        def pop(depth):
            while len(stack) > depth:
                node, ends = stack.pop()
                yield from node.close(ends, stack[-1][0] if stack else None)

        for batch in batches:
            for key, conv, depth, convs, children, leaves, saved, size, ends in zip(*(c.to_pylist() for c in batch.columns)):
                yield from pop(depth)
                stack.append((Node(depth, size, False, key, conv, convs, children, leaves, saved), ends))
        yield from pop(0)

    yield from _in_batches(rows(), NODE | {"key": pa.binary()})


def paths_of(turns: DataFrame) -> DataFrame:
    """Turns by block of five conversations: block, conv_id and the turn's code, the block's first conversation first."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    code = F.unhex(F.concat(F.substring(told, 1, 2 * (CODE - 4)), F.lpad(F.hex(F.octet_length(text)), 8, "0")))
    conv = F.col("conv_id").cast("long")
    rows = turns.where("conv_id is not null").select((conv - conv % 5).alias("block"), conv.alias("conv_id"), "turn", code.alias("code"))
    first = F.col("conv_id") != F.col("block")
    return rows.repartition("block").sortWithinPartitions("block", first, "conv_id", F.col("turn").asc_nulls_first(), "code").select("block", "conv_id", "code", F.spark_partition_id().cast("long").alias("part"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, from rows (conv_id, turn, role, text); columns as in NODE.

    A conversation c begins with the first h turns of conversation c - c % 5, h = crc32(decimal c) % 9, in place of as
    many of its own. Turns stand by turn, null first; ties by their digest; repeated rows stay. Null roles and texts are
    empty; rows of a null conv_id belong to no conversation; other columns are left out; an empty table has no nodes.
    Equal turns are told by 128 bits of their SHA-256 and their text's length. A task holds one range of paths, and one
    conversation's codes, 20 bytes a turn. Nodes that begin a range's first or last path are closed in one task: as many
    as there are ranges, times a path's turns.
    """
    spark = turns.sparkSession
    runs, first = written(small_batches(paths_of(turns)).mapInArrow(_runs, _ddl(_RUN)))
    size = runs.agg(F.sum(F.length("path") + 40)).first()[0] or 0
    ranges = runs.repartitionByRange(max(spark.sparkContext.defaultParallelism, -(-size // RANGE_BYTES)), "path", "conv_id")
    made, _ = written(ranges.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(_merged, _ddl(NODE | PART)))
    dropped(spark, first)
    open_ones = made.where("key is not null").select("key", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "size", "part", "side", "ends")
    summed = open_ones.repartition("key").sortWithinPartitions("key", "part", "side").mapInArrow(_summed, _ddl(_SUMMED))
    closing = summed.repartition(1).sortWithinPartitions("part", "side", "depth").select("key", "conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "size", "ends_sha256")
    edges, _ = written(closing.mapInArrow(_closed, _ddl(NODE | {"key": pa.binary()})))
    whole = made.where("key is null")
    above = edges.select(F.col("key").alias("parent"), F.col("conv_id").alias("above"))
    below = whole.where("parent is not null").join(above, "parent").withColumn("parent_conv_id", F.col("above"))
    return whole.where("parent is null").select(*NODE).union(below.select(*NODE)).union(edges.select(*NODE))


SQL = f"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, {CRC32_SQL.format("c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT c FROM turns)
), rebuilt AS (
  SELECT v.c, 0 AS own, t.n, t.role, t.body FROM convs v JOIN turns t ON t.c = v.c - v.c % 5 AND t.n <= v.h
  UNION ALL SELECT v.c, 1, t.n, t.role, t.body FROM convs v JOIN turns t ON t.c = v.c AND t.n > v.h
), paths AS (
  SELECT v.c, coalesce(list({{'role': r.role, 'body': r.body}} ORDER BY r.own, r.n) FILTER (r.c IS NOT NULL), []) AS path FROM convs v LEFT JOIN rebuilt r ON r.c = v.c GROUP BY v.c
), begun AS (
  SELECT c, len(path) AS size, unnest(range(0, len(path) + 1)) AS depth, path FROM paths
), nodes AS (
  SELECT path[1:depth] AS node, depth, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = depth), '') AS ends
  FROM begun GROUP BY ALL
), valued AS (
  SELECT n.*, CASE WHEN depth > 0 THEN (n_convs - 1) * strlen(node[depth].body) ELSE 0 END AS saved,
         (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.node[1:n.depth] = n.node) AS n_children
  FROM nodes n
), below AS (
  SELECT node[1:up] AS node, sum(saved)::BIGINT AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM valued) GROUP BY node[1:up]
)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, b.n_leaves, b.saved_tokens, sha256(v.ends) AS ends_sha256
FROM valued v JOIN below b ON b.node = v.node LEFT JOIN valued p ON v.depth > 0 AND p.depth = v.depth - 1 AND p.node = v.node[1:v.depth - 1]"""
