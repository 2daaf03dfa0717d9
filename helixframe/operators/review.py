"""Comparison of two sets of calls, evidence at a place, and what became of published events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.intervals import band_join


def greedy_pairs(a: DataFrame, b: DataFrame, on: list[str], at: str, tolerance: int) -> DataFrame:
    """(a_id, b_id, off): each row of a and b in one pair at most, nearest first, ties by the ids.

    Candidates come from a join by bins; the choice is made one group of `on` at a time, of its candidates only.
    """
    pairs = band_join(a.select(*on, F.col("id").alias("a_id"), F.col(at).alias("_a")), b.select(*on, F.col("id").alias("b_id"), F.col(at).alias("_b")), on, "_a", "_b", tolerance)
    pairs = pairs.select(*on, "a_id", "b_id", F.abs(F.col("_a") - F.col("_b")).cast("long").alias("off"))
    kinds = dict(pairs.dtypes)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["off", "a_id", "b_id"], kind="stable")
        left, right, keep = set(), set(), []
        for k, (x, y) in enumerate(zip(pdf["a_id"], pdf["b_id"])):
            if x not in left and y not in right:
                left.add(x)
                right.add(y)
                keep.append(k)
        return pdf.iloc[keep][["a_id", "b_id", "off"]]

    return pairs.groupBy(*on).applyInPandas(choose, f"a_id {kinds['a_id']}, b_id {kinds['b_id']}, off long")


def most_pairs(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(a_id, b_id): as many of the candidate pairs as can stand side by side, one group at a time, by augmenting paths."""
    kinds = dict(pairs.dtypes)

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        options = {a: sorted(g) for a, g in pdf.groupby("a_id", sort=True)["b_id"]}
        owner: dict = {}
        for start in options:
            came, todo, end = {}, [start], None  # came: b to the a that reached it
            while todo and end is None:
                a = todo.pop(0)
                for b in options[a]:
                    if b in came:
                        continue
                    came[b] = a
                    if b not in owner:
                        end = b
                        break
                    todo.append(owner[b])
            before = {a: b for b, a in owner.items()}
            while end is not None:
                a = came[end]
                owner[end], end = a, before.get(a)
        return pd.DataFrame([(a, b) for b, a in owner.items()], columns=["a_id", "b_id"])

    return pairs.select(*by, "a_id", "b_id").distinct().groupBy(*by).applyInPandas(match, f"a_id {kinds['a_id']}, b_id {kinds['b_id']}")


def pair_reason(exact: int, near: int) -> Column:
    """Why two junctions (columns a1, a2, as1, as2, ao and b1, b2, bs1, bs2, bo: positions, strands, overlap) agree or don't.

    exact and near bound the greater distance of the two sides, taken straight or crosswise, whichever is less.
    """
    off = lambda x, y: F.abs(F.col(x) - F.col(y))
    straight, crossed = F.greatest(off("a1", "b1"), off("a2", "b2")), F.greatest(off("a1", "b2"), off("a2", "b1"))
    turned = crossed < straight
    strands = F.when(turned, (F.col("as1") == F.col("bs2")) & (F.col("as2") == F.col("bs1"))).otherwise((F.col("as1") == F.col("bs1")) & (F.col("as2") == F.col("bs2")))
    distance, one_end = F.least(straight, crossed), F.least(off("a1", "b1"), off("a2", "b2"), off("a1", "b2"), off("a2", "b1")) <= near
    close = F.when(distance <= exact, F.lit("EXACT")).otherwise(F.lit("NEAR"))
    agree = F.when(turned, F.concat(close, F.lit("_SWAPPED"))).otherwise(close)
    return F.when(distance <= near, F.when(~strands, "TOPOLOGY").when(F.col("ao") != F.col("bo"), "OVERLAP_DIFFERS").otherwise(agree)).when(one_end, "DISCORDANT_BREAKEND").otherwise("UNRELATED")


def locus_counters(observations: DataFrame, by: list[str], base: Column, ref: Column, alt: Column, mapq: Column, quality: Column, unique: int = 10, good: int = 20) -> DataFrame:
    """Reads with the reference, the other and any other base at a place: all, uniquely mapped, and of good quality too.

    One row a place, with a histogram of bases; a map-side combined sum, so a deep place costs its bases only.
    """
    kind = F.when(base == ref, "ref").when(base == alt, "alt").otherwise("other")
    levels = {"raw": F.lit(True), "unique": mapq >= unique, "good": (mapq >= unique) & (quality >= good)}
    rows = observations.select(*by, base.alias("_base"), kind.alias("_kind"), *(level.alias(f"_{n}") for n, level in levels.items()))
    per_base = rows.groupBy(*by, "_base", "_kind").agg(*(F.count_if(F.col(f"_{n}")).alias(n) for n in levels))
    total = lambda n, k: F.sum(F.when(F.col("_kind") == k, F.col(n)).otherwise(0)).alias(f"{n}_{k}")
    return per_base.groupBy(*by).agg(*(total(n, k) for n in levels for k in ("ref", "alt", "other")), F.map_from_entries(F.array_sort(F.collect_list(F.struct("_base", "raw")))).alias("histogram"))


def evidence_classes(support: Column, plus: Column, minus: Column, least_side: Column, repeats: Column, primary: Column) -> Column:
    """Four judgements of a junction: how many reads, on which strands, how long its sides, how unique its places."""
    return F.struct(
        F.when(support >= 10, "STRONG").when(support >= 3, "MODERATE").when(support >= 1, "WEAK").otherwise("NONE").alias("reads"),
        F.when((plus > 0) & (minus > 0), "BOTH").when(plus + minus > 0, "ONE").otherwise("NONE").alias("strands"),
        F.when(least_side >= 14, "LONG").when(least_side >= 3, "SHORT").otherwise("UNANCHORED").alias("sides"),
        F.when(repeats == 0, "UNIQUE").when((repeats == 1) | primary, "ONE_REPEAT").otherwise("REPEATS").alias("places"),
    )


def recovery(exact: Column, near: Column, subclonal: Column, covered: Column) -> Column:
    """What became of a published event: recovered, near, below consensus, absent though covered, or not assessable."""
    return F.when(exact, "RECOVERED").when(near, "RECOVERED_NEAR").when(subclonal, "BELOW_CONSENSUS").when(covered, "NOT_RECOVERED").otherwise("NOT_ASSESSABLE")


def locus_relevance(start: Column, end: Column, low: Column, high: Column, flank: int, kind: Column) -> tuple[Column, Column]:
    """(relevance, structure) of an event [start, end] for a target [low, high]."""
    apart = F.greatest(F.lit(0), start - high, low - end)
    relevance = F.when(apart == 0, "ON_TARGET").when(apart <= flank, "FLANKING").otherwise("ELSEWHERE")
    structure = F.when(kind.isin("JC", "MOB", "AMP", "CON", "INV"), "STRUCTURAL").when(kind == "DEL", F.when((start <= low) & (end >= high), "DELETES_TARGET").otherwise("DELETION")).otherwise("SEQUENCE")
    return relevance, structure
