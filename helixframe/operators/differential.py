"""Differences of two samples: edited minus starter, exact and tolerant, one to one."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from helixframe.functions import identity, sequence
from helixframe.operators import segments
from helixframe.operators.intervals import band_join
from helixframe.plans.session import cut

#: Positions that may differ by so many bases and still be the same event, for junctions, insertions of elements and longer deletions.
TOLERANCE = 5


def subtract_set(edited: DataFrame, starter: DataFrame, keys: list[str], always: Column | None = None) -> DataFrame:
    """Rows of edited whose key starter lacks; rows for which `always` holds stay in any case. Null keys never meet."""
    if always is None:
        return edited.join(starter.select(*keys).distinct(), keys, "left_anti").select(*edited.columns)
    rest = edited.where(~F.coalesce(always, F.lit(False))).join(starter.select(*keys).distinct(), keys, "left_anti").select(*edited.columns)
    return edited.where(F.coalesce(always, F.lit(False))).unionByName(rest)


def subtract_multiset(edited: DataFrame, starter: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each row of starter takes one row of edited with its key away, the first in order.

    starter is counted by key first (map-side), so a frequent key costs one row there.
    """
    taken = starter.groupBy(*keys).agg(F.count("*").alias("_taken"))
    numbered = edited.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return numbered.join(taken, keys, "left").where(F.col("_rn") > F.coalesce("_taken", F.lit(0))).select(*edited.columns)


def canonical(records: DataFrame, contigs: DataFrame, domain: bytes = identity.DOMAIN) -> DataFrame:
    """Records (kind, fields) with their preimage and event_id; insertions and deletions at the last equivalent place.

    contigs is (seq_id, seq), a few sequences that are hashed once and joined; records of unknown sequences raise.
    """
    refs = contigs.select("seq_id", "seq", F.sha2(F.encode("seq", "UTF-8"), 256).alias("sha"))
    one, two = refs.select(F.col("seq_id").alias("_s1"), F.col("seq").alias("_q1"), F.col("sha").alias("_h1")), refs.select(F.col("seq_id").alias("_s2"), F.col("sha").alias("_h2"))
    at = lambda i: F.get("fields", F.lit(i))
    rows = records.join(one, at(0) == F.col("_s1"), "left").join(two, F.when(F.col("kind") == "JC", at(3)).otherwise(at(0)) == F.col("_s2"), "left")
    pos = at(1).try_cast("long")
    deletion = sequence.right_aligned_deletion("_q1", pos, at(2).try_cast("long"))
    insertion = sequence.right_aligned_insertion("_q1", pos, F.upper(at(2)))
    placed = (
        F.when(F.col("kind") == "DEL", F.array(at(0), deletion.cast("string"), at(2)))
        .when(F.col("kind") == "INS", F.array(at(0), insertion["position"].cast("string"), insertion["bases"]))
        .otherwise(F.col("fields"))
    )
    known = F.when(F.col("_h1").isNull() | F.col("_h2").isNull(), F.raise_error(F.concat(F.lit("unknown sequence in "), F.array_join("fields", " "))).cast("array<string>")).otherwise(placed)
    rows = rows.withColumn("fields", F.explode(F.array(known)))  # one row each: keeps the placed fields from being computed at every use
    image = identity.event_preimage(F.col("kind"), F.col("fields"), F.col("_h1"), F.col("_h2"), domain)
    return rows.withColumn("preimage", image).withColumn("event_id", identity.event_id(F.col("preimage"))).drop("_s1", "_q1", "_h1", "_s2", "_h2")


def coalesce_events(records: DataFrame, by: list[str], representative: list[str], ids: str) -> DataFrame:
    """One row for each group: the least representative by the listed columns, and all ids, sorted and distinct."""
    key = F.struct(*representative)
    return records.groupBy(*by).agg(F.min(key).alias("_r"), F.array_sort(F.collect_set(ids)).alias("ids")).select(*by, "_r.*", "ids")


def tolerant_candidates(edited: DataFrame, starter: DataFrame, discrete: list[str], at: str, second: str | None = None, tolerance: int = TOLERANCE) -> DataFrame:
    """Pairs (edited_id, starter_id, max_delta, sum_delta) with equal discrete columns and positions within the tolerance.

    Both tables have id, the discrete columns, and one or two positions, of which each must agree.
    """
    names = [at, *([second] if second else [])]
    left = edited.select(F.col("id").alias("edited_id"), *discrete, *(F.col(c).alias(f"_e_{c}") for c in names))
    right = starter.select(F.col("id").alias("starter_id"), *discrete, *(F.col(c).alias(f"_s_{c}") for c in names))
    pairs = band_join(left, right, discrete, f"_e_{at}", f"_s_{at}", tolerance)
    deltas = [F.abs(F.col(f"_e_{c}") - F.col(f"_s_{c}")) for c in names]
    most, total = (F.greatest(*deltas), deltas[0] + deltas[1]) if second else (deltas[0], deltas[0])
    return pairs.where(most <= tolerance).select("edited_id", "starter_id", most.alias("max_delta"), total.alias("sum_delta"))


def cheapest_matching(edges: list[tuple[int, int, int, int]], undo: int = -1) -> list[tuple[int, int]]:
    """A maximum matching of least cost, costs (max_delta, sum_delta) summed and compared in this order.

    Costs become one number, the first part scaled beyond any sum of the second, and shortest augmenting paths are
    found by relaxation, matched edges running backwards at their negated cost. Equal costs prefer the lesser pair.
    With undo 1, a matched edge costs once more when it is taken back: still a maximum matching, but each path keeps
    earlier choices where it can.
    """
    scale = sum(e[3] for e in edges) + 1
    cost = {}
    for a, b, most, total in sorted(edges):
        cost[a, b] = min(cost.get((a, b), most * scale + total), most * scale + total)
    partner_of: dict[int, int] = {}
    used: dict[int, int] = {}
    lefts = sorted({a for a, _ in cost})
    while True:
        best = {("L", a): (0, None) for a in lefts if a not in partner_of}
        changed = True
        while changed:
            changed = False
            for (a, b), c in cost.items():
                if ("L", a) in best and partner_of.get(a) != b:
                    d = best["L", a][0] + c
                    if ("R", b) not in best or d < best["R", b][0]:
                        best["R", b] = (d, a)
                        changed = True
                if used.get(b) == a and ("R", b) in best:
                    d = best["R", b][0] + undo * c
                    if ("L", a) not in best or d < best["L", a][0]:
                        best["L", a] = (d, b)
                        changed = True
        free = [(d, b) for (side, b), (d, _) in best.items() if side == "R" and b not in used]
        if not free:
            return sorted(partner_of.items())
        b = min(free)[1]
        while b is not None:
            a = best["R", b][1]
            used[b], partner_of[a] = a, b
            b = best["L", a][1]


def _apart(edges: list[tuple]) -> list[list[tuple]]:
    """Edges (a, b, ...) by connected component, each in the order given."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    for e in edges:
        parent[root(("L", e[0]))] = root(("R", e[1]))
    out: dict = {}
    for e in edges:
        out.setdefault(root(("L", e[0])), []).append(e)
    return list(out.values())


def one_to_one(candidates: DataFrame, block: list[str], undo: int = -1) -> DataFrame:
    """The matched pairs of candidates, each block on its own: (block, edited_id, starter_id); undo as in cheapest_matching.

    Blocks are the discrete columns with a stretch of positions that no candidate leaves; they stay small. Sorted rows
    stream through each task block by block, and a block's connected components are matched one after the other: no
    path leaves a component, so the pairs are those of the whole block.
    """
    names, n = [*block, "edited_id", "starter_id"], len(block)
    arrow = to_arrow_schema(candidates.select(*names).schema)

    def pairs(key: tuple | None, edges: list[tuple]) -> list[tuple]:
        if len(edges) < 2:
            return [(*key, a, b) for a, b, *_ in edges]
        return [(*key, a, b) for part in _apart(edges) for a, b in cheapest_matching(part, undo)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)
        now, edges = None, []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:n] != now:
                    out += pairs(now, edges)
                    now, edges = row[:n], []
                edges.append(row[n:])
            if out:
                yield table(out)
        if edges:
            yield table(pairs(now, edges))

    # the rows are few bytes and much work, so their number of tasks is the cluster's, not one by size
    dealt = candidates.select(*names, "max_delta", "sum_delta").repartition(4 * candidates.sparkSession.sparkContext.defaultParallelism, *block)
    return dealt.sortWithinPartitions(*block).mapInArrow(run, candidates.select(*names).schema)


def mutual_nearest(candidates: DataFrame) -> DataFrame:
    """Pairs in which each side is the other's nearest, ties by id: a matching without search, for dense data."""
    cost = F.struct("max_delta", "sum_delta")
    mine = candidates.groupBy("edited_id").agg(F.min(F.struct(cost.alias("c"), F.col("starter_id").alias("o"))).alias("b")).select("edited_id", F.col("b.o").alias("starter_id"))
    theirs = candidates.groupBy("starter_id").agg(F.min(F.struct(cost.alias("c"), F.col("edited_id").alias("o"))).alias("b")).select(F.col("b.o").alias("edited_id"), "starter_id")
    return mine.join(theirs, ["edited_id", "starter_id"])


def multiplicity(candidates: DataFrame) -> DataFrame:
    """Candidates with the number of partners that each side has."""
    e, s = candidates.groupBy("edited_id").agg(F.count("*").alias("edited_degree")), candidates.groupBy("starter_id").agg(F.count("*").alias("starter_degree"))
    return candidates.join(e, "edited_id").join(s, "starter_id")


def missing_references(rows: DataFrame, key: str, table: DataFrame, target: str) -> DataFrame:
    """Distinct keys of rows that the table lacks; a gate raises unless it is empty."""
    return rows.select(key).where(F.col(key).isNotNull()).distinct().join(table.select(F.col(target).alias(key)).distinct(), key, "left_anti")


def difference(edited: DataFrame, starter: DataFrame, contigs: DataFrame, domain: bytes = identity.DOMAIN, by: tuple[str, ...] = ()) -> DataFrame:
    """Events of edited that starter lacks: (by, event_id, kind, fields, ids).

    Records are GD mutations (id, kind, fields). Equal preimages are one event; events of both samples go; then
    junctions, element insertions and deletions of more than two bases are matched one to one within the tolerance.
    Columns `by` (strings) of edited tell samples apart, each of which is compared with the whole starter, on its own.
    """
    events = lambda df, keys: coalesce_events(canonical(df, contigs, domain), [*keys, "event_id"], ["kind", "fields"], "id")
    e, s = cut(events(edited, by)), cut(events(starter, ()))  # a few thousand rows a sample, used again below
    e = e.withColumn("_n", identity.scoped(*by, "event_id"))
    left = e.join(s.select("event_id"), "event_id", "left_anti")
    pairs = _tolerant_pairs(left, s.withColumnRenamed("event_id", "_n"), by)
    # a starter event that the sample has itself is taken already
    taken = e.select(*by, F.col("event_id").alias("starter_id"))
    matched = one_to_one(pairs.join(taken, [*by, "starter_id"], "left_anti"), [*by, "kind", "group", "stretch"])
    return left.join(matched.select(F.col("edited_id").alias("_n")), "_n", "left_anti").select(*by, "event_id", "kind", "fields", "ids")


def _tolerant_pairs(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Candidates of records (_n, kind, fields) that tolerance may match, with left's columns `by`, kind, group and stretch, in which they lie apart from others."""
    at = lambda i: F.get("fields", F.lit(i))

    def keyed(df: DataFrame, *more: str) -> DataFrame:
        kind, size = F.col("kind"), at(2).try_cast("long")
        group = F.when(kind == "DEL", at(0)).when(kind == "MOB", F.concat_ws("|", at(0), at(2), at(3), at(4))).when(kind == "JC", F.concat_ws("|", at(0), at(2), at(3), at(5), at(6)))
        second = F.when(kind == "DEL", at(1).try_cast("long") + size - 1).when(kind == "JC", at(4).try_cast("long")).otherwise(at(1).try_cast("long"))
        chosen = (kind.isin("MOB", "JC")) | ((kind == "DEL") & (size > 2))
        return df.where(chosen).select(F.col("_n").alias("id"), *more, "kind", group.alias("group"), at(1).try_cast("long").alias("p"), second.alias("q"))

    pairs = tolerant_candidates(keyed(left), keyed(right), ["kind", "group"], "p", "q")
    # two edited records can only want the same starter one within twice the tolerance, so wider gaps part the blocks
    blocks = segments.stretches(keyed(left, *by), [*by, "kind", "group"], "p", 2 * TOLERANCE).select(F.col("id").alias("edited_id"), *by, "kind", "group", "stretch")
    return pairs.join(blocks, "edited_id")


def subtract_records(edited: DataFrame, starter: DataFrame) -> DataFrame:
    """Records (id, kind, fields) of edited without those that starter has, record for record: nothing is coalesced first.

    Equal records cancel one for one, by id; a junction's sides count in order of sequence and position. Of the rest,
    junctions, elements and deletions over two bases are matched within the tolerance, where taking back a match costs
    as much as it saved. Records of kind UN stay, and cancel nothing; null fields make records equal like any others.
    """
    at = lambda i: F.get("fields", F.lit(i))
    one, two = (F.struct(at(i).alias("s"), at(i + 1).try_cast("long").alias("p"), at(i + 2).alias("t")) for i in (0, 3))
    text = lambda x: F.array(x["s"], x["p"].cast("string"), x["t"])
    sides = F.concat(text(F.least(one, two)), text(F.greatest(one, two)), F.slice("fields", 7, 1))
    order = W.partitionBy("_k").orderBy("id")

    def ranked(df: DataFrame) -> DataFrame:
        rows = df.where("kind <> 'UN'").withColumn("fields", F.when(F.col("kind") == "JC", sides).otherwise(F.col("fields")))
        return rows.withColumn("_k", F.array_join(F.concat(F.array("kind"), "fields"), "\t", "\0")).withColumn("_r", F.row_number().over(order))

    e, s = cut(ranked(edited.select("id", "kind", "fields"))), cut(ranked(starter.select("id", "kind", "fields")))
    left, right = e.join(s.select("_k", "_r"), ["_k", "_r"], "left_anti"), s.join(e.select("_k", "_r"), ["_k", "_r"], "left_anti")
    pairs = _tolerant_pairs(left.withColumnRenamed("id", "_n"), right.withColumnRenamed("id", "_n"))
    matched = one_to_one(pairs, ["kind", "group", "stretch"], 1).select(F.col("edited_id").alias("id"))
    kept = left.select("id").join(matched, "id", "left_anti").union(edited.where("kind = 'UN'").select("id"))
    return edited.join(kept, "id", "left_semi")
