"""Merkle manifest of a table: a tree for each language, a tree over those, and a proof for every row.

Distributed large-block reduction: rows get their place among their language's by ranges of the order, blocks of 8**k
consecutive leaves become a row each, and every block is reduced to one node where it lies. The driver builds the small
top tree over the blocks' nodes and sends it out once; it holds every block's path to the root (the suffix that all
proofs of a block share). Each block then finishes its rows' proofs and folds where it lies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import dropped, release, small_batches, written

#: Nodes that become one.
RUN = 8
#: Levels that a block reduces: at least the first figure; more (up to the second) where the blocks would be more than TOP_NODES.
LEVELS = (4, 7)
#: Nodes of the driver's tree: blocks, one a language at least. Beyond it (some 10**11 rows), the job ends with an error rather than load the driver.
TOP_NODES = 1 << 18


def digest(inputs: list[str]) -> str:
    """H: the SHA-256 of its inputs one after another."""
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def reduced(nodes: list[str], levels: int | None = None) -> list[list[str]]:
    """All levels over some nodes, these first: every RUN consecutive ones become one, `levels` times, or until one is left."""
    out = [nodes]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        out.append([digest(out[-1][i : i + RUN]) for i in range(0, len(out[-1]), RUN)])
    return out


def siblings(level: list[str], at: int) -> tuple[str, str]:
    """Of one node of a level: what stands left and right of it in its run, as text."""
    first = at - at % RUN
    return "".join(level[first:at]), "".join(level[at + 1 : first + RUN])


def path(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """siblings() from a node of the first level up to the last one's."""
    out = []
    for level in levels[:-1]:
        out.append(siblings(level, at))
        at //= RUN
    return out


def fold(node: str, steps: list[tuple[str, str]]) -> str:
    """The root that a node and its siblings give."""
    for left, right in steps:
        node = digest([left, node, right])
    return node


def _field(c: str, value: Column | None = None) -> Column:
    """A field as a leaf holds it: `-` if null, else its UTF-8 bytes' count, a colon and itself."""
    text = F.col(c).cast("string") if value is None else value
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column | None = None) -> Column:
    """The leaf of a row of documents; with another text, if given."""
    return F.sha2(F.concat(*(_field(c) for c in ("doc_id", "source", "lang", "n_chars")), _field("text", text)), 256)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tampered() -> Column:
    """The text after tampering: where 3 divides the CRC-32 of the decimal doc_id, its A-Z are lower case."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))


def _ordered(leaves: DataFrame) -> tuple[DataFrame, str, list]:
    """Rows with their place `at` among their lang's, without a task that sees a whole lang; the table to delete; each lang's count in order.

    The order's ranges are written with each row's number in its range; what the ranges hold of each lang (a row for
    each range, and one more for each lang) gives the numbers at which they begin.
    """
    spark = leaves.sparkSession
    order = ("lang", "doc_id", "leaf", "other")
    ranges = leaves.repartitionByRange(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *order)
    table, where = written(ranges.sortWithinPartitions(*order).select("*", F.monotonically_increasing_id().alias("number")))
    part = F.shiftrightunsigned("number", 33)
    held = table.groupBy(part.alias("part"), "lang").agg(F.min("number").alias("first"), F.count("*").alias("n")).limit(TOP_NODES).collect()
    if len(held) == TOP_NODES:
        raise ValueError(f"some {TOP_NODES} languages or more; the top tree is built by the driver")
    size: dict = {}
    begins = []
    for r in sorted(held, key=lambda r: r["first"]):
        begins.append((r["part"], r["lang"], r["first"] - size.get(r["lang"], 0)))
        size[r["lang"]] = size.get(r["lang"], 0) + r["n"]
    begins = F.broadcast(spark.createDataFrame(begins, "of_part long, of_lang string, begin long"))
    placed = table.join(begins, (part == F.col("of_part")) & F.col("lang").eqNullSafe(F.col("of_lang")))
    return placed.select("lang", "doc_id", "leaf", "other", (F.col("number") - F.col("begin")).alias("at")), where, sorted(size.items(), key=lambda x: _bytewise(x[0]))


def _bytewise(lang: str | None) -> tuple[bool, bytes]:
    """Orders langs: null first, then by their UTF-8 bytes."""
    return lang is not None, (lang or "").encode()


_BLOCK = {"lang": pa.string(), "block": pa.int64(), "node": pa.string(), "ids": pa.list_(pa.int64()), "leaves": pa.string(), "others": pa.string()}
_RESULT = {"doc_id": pa.int64(), "leaf": pa.string(), "subroot": pa.string(), "root": pa.string(), "proof_sha256": pa.string(), "folded_root": pa.string(), "verified": pa.bool_()}


def _batch(rows: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], list(kinds))


def _blocks(rows: Iterator[pa.RecordBatch], levels: dict) -> Iterator[pa.RecordBatch]:
    """Rows sorted by lang, block and place to a row a block, with the node that it reduces to."""

    def block(key, held):
        ids, leaves, others = zip(*held)
        return _batch([(*key, reduced(list(leaves), levels[key[0]])[-1][0], ids, "".join(leaves), "".join(others))], _BLOCK)

    key, held = None, []
    for batch in rows:
        for lang, at, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if held and key != (lang, at):
                yield block(key, held)
                held = []
            key = (lang, at)
            held.append(rest)
    if held:
        yield block(key, held)
    release()


def _finished(batch: pa.RecordBatch, trees: dict, above: list, order: dict, levels: dict) -> Iterator[tuple]:
    """The result's rows of some blocks."""
    for lang, block, ids, own, others in zip(*(c.to_pylist() for c in batch.columns)):
        nodes = [own[i : i + 64] for i in range(0, len(own), 64)]
        inner = reduced(nodes, levels[lang])
        suffix = path(trees[lang], block) + path(above, order[lang])
        subroot, root = trees[lang][-1][0], above[-1][0]
        for i, (doc_id, node) in enumerate(zip(ids, nodes)):
            if i % RUN == 0:  # the rows of a run share what stands above them
                shared = path(inner[1:], i // RUN) + suffix
                tail = "".join(left + right for left, right in shared)
            steps = [siblings(nodes, i)] if len(inner) > 1 else []
            folded = fold(others[64 * i : 64 * i + 64], steps + shared)
            yield doc_id, node, subroot, root, digest([left + right for left, right in steps] + [tail]), folded, folded == root


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of documents; see this module.

    Null fields are marked as such in the leaf; rows of a null lang have a tree of their own, the first; null doc_ids
    come first and are left untampered. Rows of one doc_id stand by their leaves; repeated rows stay; a lone row has no
    siblings; other columns are left out; an empty table gives no rows. A task holds one block: 8**4 leaves of some 200
    bytes, or more where the rows are beyond 10**9.
    """
    spark = docs.sparkSession
    leaves, first = written(docs.select("lang", F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("leaf"), leaf(tampered()).alias("other")))
    placed, second, sizes = _ordered(leaves)
    k, least = LEVELS[0], len(sizes)
    while k < LEVELS[1] and sum(-(-n // RUN**k) for _, n in sizes) > TOP_NODES:
        k += 1
    if sum(-(-n // RUN**k) for _, n in sizes) > TOP_NODES + least:
        raise ValueError(f"blocks of {RUN**k} leaves are more than {TOP_NODES}; the top tree is built by the driver")
    levels = {lang: next(i for i in range(k + 1) if RUN**i >= n or i == k) for lang, n in sizes}  # a lone block's end with one node
    keyed = placed.withColumn("block", F.floor(F.col("at") / RUN**k)).repartition("lang", "block").sortWithinPartitions("lang", "block", "at").select("lang", "block", "doc_id", "leaf", "other")
    blocks, _ = written(small_batches(keyed).mapInArrow(lambda rows: _blocks(rows, levels), _ddl(_BLOCK)))
    for old in (first, second):
        dropped(spark, old)
    tops: dict = {lang: [] for lang, _ in sizes}
    for r in sorted(blocks.select("lang", "block", "node").collect(), key=lambda r: r["block"]):
        tops[r["lang"]].append(r["node"])
    trees = {lang: reduced(nodes) for lang, nodes in tops.items()}
    above = reduced([trees[lang][-1][0] for lang, _ in sizes])
    sent = spark.sparkContext.broadcast((trees, above, {lang: i for i, (lang, _) in enumerate(sizes)}, levels))

    def finish(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            done = _finished(batch, *sent.value)
            while some := list(islice(done, 4096)):
                yield _batch(some, _RESULT)
        release()

    return small_batches(blocks.select("lang", "block", "ids", "leaves", "others")).mapInArrow(finish, _ddl(_RESULT))


def _ddl(kinds: dict) -> str:
    """An Arrow schema as Spark's."""
    names = {pa.string(): "string", pa.int64(): "long", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{c} {names[t]}" for c, t in kinds.items())


#: CRC-32 of a text's ASCII characters, in DuckDB: each is added and shifted out bit by bit.
CRC32_SQL = "xor(list_reduce(flatten([[4294967295]] || list_transform(range(0, length({0})::BIGINT), lambda i: [ascii(substr({0}, (i + 1)::INT, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"


def _sql() -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    given = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    levels = lambda name, start, key: f"""
{name} AS (
  {start}
  UNION ALL
  SELECT {key}, lvl + 1, place // {RUN}, sha256(string_agg(node, '' ORDER BY place)), max((n + {RUN - 1}) // {RUN}) FROM {name} WHERE n > 1 GROUP BY {key}, lvl, place // {RUN}
)"""  # noqa: E731
    around = lambda side, own: f"coalesce(string_agg(s.node, '' ORDER BY s.place) FILTER (s.place {side} {own}), '')"
    step = f"{around('<', 'o.place')} || '|' || {around('>', 'o.place')}"
    return f"""
WITH RECURSIVE texts AS (
  SELECT *, CASE WHEN {CRC32_SQL.format("doc_id::VARCHAR")} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS other_text FROM documents
), hashed AS (
  SELECT doc_id, lang, sha256({given} || {field("text")}) AS leaf, sha256({given} || {field("other_text")}) AS other FROM texts
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n FROM hashed
), {levels("nodes", "SELECT lang, 0 AS lvl, place, leaf AS node, n FROM leaves", "lang")}
, subroots AS (
  SELECT lang, node, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), {levels("tops", "SELECT 0 AS tree, 0 AS lvl, place, node, n FROM subroots", "tree")}
, steps AS (
  SELECT o.lang, o.place AS leaf_place, s.lvl, {step.replace("o.place", f"(o.place // ({RUN}**s.lvl)::BIGINT)")} AS step
  FROM leaves o JOIN nodes s ON s.lang IS NOT DISTINCT FROM o.lang AND s.n > 1 AND s.place // {RUN} = o.place // ({RUN}**(s.lvl + 1))::BIGINT GROUP BY o.lang, o.place, s.lvl
), suffixes AS (
  SELECT o.lang, 100 + s.lvl AS lvl, {step.replace("o.place", f"(o.place // ({RUN}**s.lvl)::BIGINT)")} AS step
  FROM subroots o JOIN tops s ON s.n > 1 AND s.place // {RUN} = o.place // ({RUN}**(s.lvl + 1))::BIGINT GROUP BY o.lang, o.place, s.lvl
), upper AS (SELECT lang, list(step ORDER BY lvl) AS steps FROM suffixes GROUP BY lang),
lower AS (SELECT lang, leaf_place, list(step ORDER BY lvl) AS steps FROM steps GROUP BY lang, leaf_place),
paths AS (
  SELECT l.doc_id, l.leaf, l.other, l.lang, coalesce(d.steps, []::VARCHAR[]) || coalesce(u.steps, []::VARCHAR[]) AS steps
  FROM leaves l LEFT JOIN lower d ON d.lang IS NOT DISTINCT FROM l.lang AND d.leaf_place = l.place LEFT JOIN upper u ON u.lang IS NOT DISTINCT FROM l.lang
), folded AS (
  SELECT *, list_reduce([other] || steps, lambda a, x: sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2))) AS folded_root FROM paths
)
SELECT f.doc_id, f.leaf, s.node AS subroot, r.node AS root, sha256(replace(array_to_string(f.steps, ''), '|', '')) AS proof_sha256, f.folded_root, f.folded_root = r.node AS verified
FROM folded f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang CROSS JOIN (SELECT node FROM tops WHERE n = 1) r"""


SQL = _sql()
