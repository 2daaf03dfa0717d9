"""Comparisons of two sets of records and checks of published tables, as DataFrames and a verdict."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.differential import missing_references
from helixframe.operators.intervals import band_join


def discrepancies(a: DataFrame, b: DataFrame, on: list[str], at: str, strand: str, tolerance: int) -> DataFrame:
    """(side, id, bucket) of the rows of a and b: exact, jitter (same strand, near), strand (near, other strand), or only.

    A row's best partner within the tolerance decides: first an equal place, then the same strand, then the other. Rows
    that share their place and strand with another of their own table are duplicates, but for the least id.
    """

    def judged(x: DataFrame, y: DataFrame, side: str) -> DataFrame:
        first = x.groupBy(*on, at, strand).agg(F.min("id").alias("_first"))
        own = x.select("id", *on, F.col(at).alias("_a"), F.col(strand).alias("_s"))
        other = y.select(*on, F.col(at).alias("_b"), F.col(strand).alias("_t")).distinct()
        off, same = F.abs(F.col("_a") - F.col("_b")), F.col("_s") == F.col("_t")
        best = band_join(own, other, on, "_a", "_b", tolerance).groupBy("id").agg(F.min(F.when(same & (off == 0), 0).when(same, 1).otherwise(2)).alias("_best"))
        rows = x.join(first, [*on, at, strand]).join(best, "id", "left")
        bucket = F.when(F.col("id") != F.col("_first"), "duplicate").when(F.col("_best") == 0, "exact").when(F.col("_best") == 1, "jitter").when(F.col("_best") == 2, "strand").otherwise("only")
        return rows.select(F.lit(side).alias("side"), "id", bucket.alias("bucket"))

    return judged(a, b, "a").unionByName(judged(b, a, "b"))


@dataclass
class Verdict:
    """What a gate found: counts by bucket, and whether it is passed."""

    counts: dict[str, int]
    passed: bool

    def to_json(self) -> str:
        return json.dumps({"passed": self.passed, "counts": dict(sorted(self.counts.items()))}, indent=1)


def comparison_gate(found: DataFrame, allowed: dict[str, int]) -> Verdict:
    """The verdict on discrepancies(): each bucket of each side, as side_bucket, has at most the allowed rows; exact ones are free."""
    counts = {f"{r.side}_{r.bucket}": r["count"] for r in found.groupBy("side", "bucket").count().collect()}  # ten rows at most
    return Verdict(counts, all(n <= allowed.get(k, 0) for k, n in counts.items() if not k.endswith("_exact")))


def release_gate(tables: dict[str, DataFrame], references: list[tuple[str, str, str, str]], unique: dict[str, list[str]], forbidden: dict[str, tuple[Column, str]]) -> Verdict:
    """Checks of published tables: references (table, column, other, key) that lead nowhere, keys that occur twice, texts that match a forbidden pattern."""
    counts = {}
    for table, column, other, key in references:
        counts[f"{table}.{column} not in {other}"] = missing_references(tables[table], column, tables[other], key).count()
    for table, keys in unique.items():
        counts[f"{table} repeats {'+'.join(keys)}"] = tables[table].groupBy(*keys).count().where("count > 1").count()
    for table, (text, pattern) in forbidden.items():
        counts[f"{table} holds {pattern}"] = tables[table].where(text.rlike(pattern)).count()
    return Verdict(counts, not any(counts.values()))
