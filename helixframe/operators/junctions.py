"""Breakpoints: mosaic read pairs, support, acceptance, clustering, ranking, reciprocal evidence."""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.operators import segments
from helixframe.operators.ranks import running_sum


def is_mosaic(length: Column, a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two pieces of a read [start, end) make a junction.

    One begins the read and the other ends it; together they cover over two bases more than the longer; each has five
    bases of its own, one of them ten; the gap between them is 20 at most.
    """
    first = F.when(a_start <= b_start, F.struct(a_start.alias("s"), a_end.alias("e"))).otherwise(F.struct(b_start.alias("s"), b_end.alias("e")))
    last = F.when(a_start <= b_start, F.struct(b_start.alias("s"), b_end.alias("e"))).otherwise(F.struct(a_start.alias("s"), a_end.alias("e")))
    shared = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    own_a, own_b = a_end - a_start - shared, b_end - b_start - shared
    union = a_end - a_start + b_end - b_start - shared
    gap = F.greatest(F.lit(0), last["s"] - first["e"])
    return (first["s"] == 0) & (F.greatest(a_end, b_end) == length) & (union > F.greatest(a_end - a_start, b_end - b_start) + 2) & (F.least(own_a, own_b) >= 5) & (F.greatest(own_a, own_b) >= 10) & (gap <= 20)


def read_pairs(pieces: DataFrame, read: list[str], order: list[str], most: int = 20) -> tuple[DataFrame, DataFrame]:
    """(pairs, overflow): pairs of pieces of a read, and the reads with more than `most` pieces, which are not paired.

    Columns of the second piece end in _2. Pieces of a read are few by the bound, so the self-join is small; reads
    over it are returned for the family pairing and never dropped silently.
    """
    counted = pieces.withColumn("_n", F.count("*").over(W.partitionBy(*read))).withColumn("_k", F.row_number().over(W.partitionBy(*read).orderBy(*order)))
    some = counted.where(F.col("_n").between(2, most)).drop("_n")
    second = some.select(*read, *(F.col(c).alias(f"{c}_2") for c in some.columns if c not in read))
    overflow = counted.where(F.col("_n") > most).select(*read).distinct()
    return some.join(second, read).where("_k < _k_2").drop("_k", "_k_2"), overflow


def support_columns(side1: str, side2: str, minus: Column, counts: Column | None = None) -> list[Column]:
    """Aggregates over supporting reads: reads, plus, minus, best_min, best_min_plus, best_min_minus, min_side1, min_side2.

    With `counts`, only rows for which it holds are reads; sides and minus must be null in the others.

    best_min is the greatest over reads of the shorter side; sides of 0 are unknown and don't count for the least.
    """
    reads = F.count("*") if counts is None else F.count_if(counts)
    short = F.least(side1, side2)
    known = lambda c: F.coalesce(F.min(F.when(F.col(c) > 0, F.col(c))), F.lit(0))
    return [
        reads.alias("reads"), F.count_if(~minus).alias("plus"), F.count_if(minus).alias("minus"), F.max(short).alias("best_min"),
        F.coalesce(F.max(F.when(~minus, short)), F.lit(0)).alias("best_min_plus"), F.coalesce(F.max(F.when(minus, short)), F.lit(0)).alias("best_min_minus"), known(side1).alias("min_side1"), known(side2).alias("min_side2"),
    ]


def support(rows: DataFrame, by: list[str], side1: str, side2: str, minus: Column) -> DataFrame:
    """Counts of supporting reads by group: (by, support_columns)."""
    return rows.groupBy(*by).agg(*support_columns(side1, side2, minus))


def accepted(both: int = 14, strand: int = 9, side: int = 3) -> Column:
    """Whether a row of support() is accepted: both strands, long enough overlaps overall, on each strand, and on each side."""
    return (F.col("plus") > 0) & (F.col("minus") > 0) & (F.col("best_min") >= both) & (F.col("best_min_plus") >= strand) & (F.col("best_min_minus") >= strand) & (F.least("min_side1", "min_side2") >= side)


def frequent_enough(least_reads: int = 3, least_share: float = 0.05) -> Column:
    """Whether a junction's reads suffice for its depth: max(round(depth * share), least), unless both sides are repeats."""
    needed = F.greatest(F.round(F.coalesce("depth", F.lit(0)) * least_share).cast("long"), F.lit(least_reads).cast("long"))
    return (F.col("reads") >= least_reads) & (F.col("both_repeats") | (F.col("reads") >= needed))


def clusters(rows: DataFrame, by: list[str], side1: str, side2: str, ident: str, tolerance: int = 5) -> DataFrame:
    """Adds cluster, the id of its first member: rows in order of (side1, side2, id), each compared with the first of a cluster.

    A row joins the first cluster whose first member lies within the tolerance on both sides, else it begins one. The
    order matters, so a group is one sequential pass; groups are cut where side1 leaves a gap over the tolerance,
    as no cluster can span that. Firsts wait by their bin of side2, while side1 is within reach.
    """
    cut = segments.stretches(rows, by, side1, tolerance, "_stretch")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([side1, side2, ident], kind="stable")
        firsts: dict[int, deque] = defaultdict(deque)
        found = []
        for n, (a, b, k) in enumerate(pdf[[side1, side2, ident]].itertuples(index=False, name=None)):
            near = []
            for at in range((b - tolerance) // (tolerance + 1), (b + tolerance) // (tolerance + 1) + 1):
                queue = firsts.get(at, ())
                while queue and a - queue[0][1] > tolerance:
                    queue.popleft()
                near += [f for f in queue if abs(f[2] - b) <= tolerance]
            first = min(near, default=(n, a, b, k))
            if first[0] == n:
                firsts[b // (tolerance + 1)].append(first)
            found.append(first[3])
        return pdf.assign(cluster=found).drop(columns="_stretch")

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + f", cluster {kinds[ident]}"
    return cut.groupBy(*by, "_stretch").applyInPandas(greedy, schema)


def rank_and_cap(rows: DataFrame, by: list[str], seeds: str, length: str, order: list[str], budget: Column, most: int = 5000) -> DataFrame:
    """The leading candidates of each group, most seeds first, then in order: (…, rank, total).

    Where some have two seeds, those with one go. The list ends at the first candidate beyond the count or whose
    cumulative length is over the budget; the first stays in any case.
    """
    best = W.partitionBy(*by)
    some = rows.where(F.col(seeds) > 0).withColumn("_most", F.max(seeds).over(best)).where((F.col("_most") < 2) | (F.col(seeds) >= 2)).drop("_most")
    ordered = W.partitionBy(*by).orderBy(F.col(seeds).desc(), *order)
    upto = ordered.rowsBetween(W.unboundedPreceding, 0)
    ranked = some.withColumn("rank", F.row_number().over(ordered)).withColumn("total", F.sum(length).over(upto))
    over = (F.col("rank") > 1) & ((F.col("rank") > most) | (F.col("total") > budget))
    return ranked.withColumn("_over", F.max(over).over(upto)).where("not _over").drop("_over")


def rank_and_cap_all(rows: DataFrame, seeds: str, length: str, order: list[str], budget: int, most: int = 5000) -> DataFrame:
    """rank_and_cap of a whole table as one group, by ranges of the order instead of in one task.

    Ranks and sums only grow along the order, so the first candidate beyond a bound parts the list without a search.
    """
    top = rows.agg(F.max(seeds).alias("_most"))  # one row
    some = rows.where(F.col(seeds) > 0).crossJoin(F.broadcast(top)).where((F.col("_most") < 2) | (F.col(seeds) >= 2)).drop("_most")
    keyed = some.withColumns({"_down": -F.col(seeds), "_one": F.lit(1)})
    summed = running_sum(running_sum(keyed, ["_down", *order], "_one", "rank"), ["_down", *order], length, "total")
    return summed.where((F.col("rank") == 1) | (F.col("rank") <= most) & (F.col("total") <= budget)).drop("_down", "_one")


def best_with_ties(rows: DataFrame, by: list[str], score: str) -> DataFrame:
    """The rows with a group's greatest score; the maximum is combined map-side and joined back."""
    top = rows.groupBy(*by).agg(F.max(score).alias(score))
    return rows.join(top, [*by, score], "left_semi")


def flagged_reads(reads: DataFrame, least_clip: int = 6) -> DataFrame:
    """Adds name (without a /1 or /2 at its end), mate (1, 2 or 0) and second_pass: unmapped, mate unmapped, or a clip of least_clip."""
    flag = F.col("flag")
    suffix = F.regexp_extract("qname", r"/([12])$", 1)
    mate = F.when(flag.bitwiseAND(0x40) > 0, 1).when(flag.bitwiseAND(0x80) > 0, 2).when(suffix != "", suffix.try_cast("int")).otherwise(0)
    clips = F.transform(F.regexp_extract_all("cigar", F.lit(r"(\d+)S"), F.lit(1)), lambda x: x.try_cast("int"))
    again = (flag.bitwiseAND(0x4) > 0) | (flag.bitwiseAND(0x8) > 0) | F.coalesce(F.array_max(clips) >= least_clip, F.lit(False))
    return reads.withColumns({"name": F.regexp_replace("qname", "/[12]$", ""), "mate": mate, "second_pass": again})


def reciprocal(seeds: DataFrame) -> DataFrame:
    """Pairs of seeds whose anchors lie in each other's copies: (id, other), id < other, of different molecules.

    seeds has id, molecule, geometry, anchor and copies (array of places like anchor). Copies are exploded and joined
    with anchors on place and geometry; a pair must be found both ways.
    """
    copies = seeds.select("id", "molecule", "geometry", F.explode("copies").alias("place"))
    anchors = seeds.select(F.col("id").alias("other"), F.col("molecule").alias("other_molecule"), "geometry", F.col("anchor").alias("place"))
    one_way = copies.join(anchors, ["place", "geometry"]).where("id <> other and molecule <> other_molecule").select("id", "other").distinct()
    back = one_way.select(F.col("other").alias("id"), F.col("id").alias("other"))
    return one_way.join(back, ["id", "other"]).where("id < other")
