"""What is emitted as a record: repeat lookups, gates on junctions, calls inside deletions, evidence behind events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.intervals import window_join

#: How far a position may be from a copy's end to be at it, and to count as entering it.
TERMINUS_REACH, TERMINUS_SLACK = 20, 5
#: Reads a strand from which a junction between repeats counts as balanced.
BALANCED = 5


def repeats_near(points: DataFrame, repeats: DataFrame, ident: str, seq: str, pos: str, reach: int | None = None) -> DataFrame:
    """All pairs of points and repeats (ord, seq_id, start, end, strand, name): (ident, repeat).

    Without a reach the repeat contains the point; with one, an end of it lies so near. A join by bins, so neither side
    is scanned for each row of the other. Points without a place meet nothing; an empty table gives an empty result.
    """
    some = points.select(F.col(ident).alias("_id"), F.col(seq).alias("seq_id"), F.col(pos).alias("_a"), F.col(pos).alias("_b")).where("_a is not null")
    copies = repeats.withColumn("_copy", F.struct("ord", "start", "end", "strand", "name"))
    if reach is None:
        pairs = window_join(some, copies.select("seq_id", "start", "end", "_copy"), ["seq_id"], ("_a", "_b"), ("start", "end"), 0, 2000)
    else:
        ends = copies.select("seq_id", F.explode(F.array_distinct(F.array("start", "end"))).alias("_e"), "_copy").withColumn("_f", F.col("_e"))
        pairs = window_join(some, ends, ["seq_id"], ("_a", "_b"), ("_e", "_f"), reach, 2000).dropDuplicates(["_id", "_copy"])
    return pairs.select(F.col("_id").alias(ident), F.col("_copy").alias("repeat"))


def with_repeat(rows: DataFrame, repeats: DataFrame, ident: str, seq: str, pos: str, name: str, reach: int | None = None) -> DataFrame:
    """Adds the first repeat, in order of the table, at or near a position, as a struct; null where there is none."""
    first = repeats_near(rows, repeats, ident, seq, pos, reach).groupBy(ident).agg(F.min_by("repeat", F.col("repeat.ord")).alias(name))
    return rows.join(first, ident, "left")


def _off(pos: Column, copy: Column) -> Column:
    return F.least(F.abs(pos - copy["start"]), F.abs(pos - copy["end"]))


def repeat_gate(pos1: Column, copy1: Column, pos2: Column, copy2: Column, balanced: Column, constituent: Column) -> Column:
    """What becomes of a junction whose sides lie in the repeats copy1 and copy2 (null: in none): drop, tag or null.

    Two inner points of one copy are no junction. An inner point paired with a distant copy is a chimera of repeats,
    unless the junction is balanced or part of an element's insertion. Every other junction of two repeats is tagged.
    """
    both = copy1.isNotNull() & copy2.isNotNull()
    same = (copy1["start"] == copy2["start"]) & (copy1["end"] == copy2["end"])
    at_end = (_off(pos1, copy1) <= TERMINUS_SLACK) | (_off(pos2, copy2) <= TERMINUS_SLACK)
    meet = (copy1["start"] <= copy2["end"]) & (copy2["start"] <= copy1["end"])
    inner = (_off(pos1, copy1) > TERMINUS_REACH) | (_off(pos2, copy2) > TERMINUS_REACH)
    longest = F.greatest(copy1["end"] - copy1["start"], copy2["end"] - copy2["start"])
    chimera = ~meet & inner & (F.abs(pos1 - pos2) > longest) & ~balanced & ~constituent
    return F.when(both, F.when(same & ~at_end, "drop").when(~same & chimera, "drop").otherwise("tag"))


def gated(junctions: DataFrame, repeats: DataFrame, ident: str = "id") -> DataFrame:
    """Junctions (id, seq_id1, pos1, seq_id2, pos2, balanced, constituent) that pass repeat_gate, with repeat_junction."""
    rows = with_repeat(with_repeat(junctions, repeats, ident, "seq_id1", "pos1", "_r1"), repeats, ident, "seq_id2", "pos2", "_r2")
    fate = repeat_gate(F.col("pos1"), F.col("_r1"), F.col("pos2"), F.col("_r2"), F.col("balanced"), F.col("constituent"))
    rows = rows.withColumn("_fate", F.coalesce(fate, F.lit("")))
    return rows.where("_fate <> 'drop'").withColumn("repeat_junction", F.col("_fate") == "tag").select(*junctions.columns, "repeat_junction")


def outside_deletions(calls: DataFrame, deletions: DataFrame, ident: str = "id") -> DataFrame:
    """Calls (id, kind, seq_id, start, end) without substitutions of bases that a deletion (seq_id, start, end) takes away."""
    gone = deletions.select("seq_id", F.col("start").alias("_a"), F.col("end").alias("_b"))
    hit = window_join(calls.where(F.col("kind").isin("SNP", "SUB")), gone, ["seq_id"], ("start", "end"), ("_a", "_b"), 0, 1000).select(ident).distinct()
    return calls.join(hit, ident, "left_anti").select(*calls.columns)


def continues_clip(clip_left: Column, aligned_pos: Column, hit_0: Column, length: Column) -> Column:
    """Whether a clip's placement on the same contig (0-based start) only goes on where its read was aligned (1-based)."""
    return F.when(clip_left, (aligned_pos - hit_0 - length).isin(0, 1)).otherwise((hit_0 + 1 - aligned_pos).isin(0, 1))


def resolved_parents(events: DataFrame, evidence: DataFrame, by: list[str]) -> DataFrame:
    """events with parent_ids (array) to found, the (id, kind) of the evidence behind them, sorted, and unresolved ids.

    Ids are looked up within the columns `by`, such as the sample. Events without parents keep empty arrays.
    """
    parents = events.select(*by, "event_id", F.explode("parent_ids").alias("id")).distinct()
    known = evidence.select(*by, F.col("id").cast("string").alias("id"), "kind").distinct()
    met = parents.withColumn("id", F.col("id").cast("string")).join(known, [*by, "id"], "left")
    told = met.groupBy(*by, "event_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("id", "kind")))).alias("found"),
        F.array_sort(F.collect_list(F.when(F.col("kind").isNull(), F.col("id")))).alias("unresolved"),
    )
    out = events.join(told, [*by, "event_id"], "left")
    none = F.expr("cast(array() as array<struct<id:string,kind:string>>)")
    return out.withColumns({"found": F.coalesce("found", none), "unresolved": F.coalesce("unresolved", F.expr("cast(array() as array<string>)"))})


def without_constituents(records: DataFrame, by: list[str]) -> DataFrame:
    """Records (id, kind, parent_ids) but for junctions that an element's insertion names as its parents."""
    owned = records.where("kind = 'MOB'").select(*by, F.explode("parent_ids").alias("id")).distinct()
    loose = records.where("kind = 'JC'").join(owned, [*by, "id"], "left_anti").select(*records.columns)
    return records.where("kind <> 'JC' or kind is null").select(*records.columns).unionByName(loose)


def evidence_union(*streams: DataFrame) -> DataFrame:
    """Streams of candidates from reads and from a second pass as one table with `origin`, their number; columns by name."""
    out = None
    for k, s in enumerate(streams):
        s = s.withColumn("origin", F.lit(k))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out
