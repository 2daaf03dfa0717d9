"""Scans along an axis that many tasks share: each takes a segment of positions, and what the segments before it add is carried on.

A window over a whole contig is one task's sort. Here a row's segment is its position over a width; a scan first sums up
each segment (a row each, combined map-side), carries these sums along the few segments of a group, and then runs
within segments. Results are those of the window over the whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Positions of a segment.
WIDTH = 1 << 16
_KINDS = {"sum": F.sum, "max": F.max, "min": F.min}
_JOINED = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "max": F.greatest, "min": F.least}


def segment(at: Column | str, width: int = WIDTH) -> Column:
    return F.floor((F.col(at) if isinstance(at, str) else at) / F.lit(width)).cast("long")


def running(df: DataFrame, by: list[str], at: str, values: dict[str, tuple[str, Column]], order: list | None = None, width: int = WIDTH, backward: bool = False, ties: bool = False) -> DataFrame:
    """Adds to each row, by group and in order of position, the sum, max or min of what comes up to and including it.

    values gives (kind, column) by the new column's name; nulls don't count, and a sum of none is 0. order refines the
    position (default: nothing more), backward runs from the end, and with ties rows of one position share what is
    summed over all of them. Null keys are a group.
    """
    rows = df.withColumn("_segment", segment(at, width))
    sums = rows.groupBy(*by, "_segment").agg(*(_KINDS[kind](c).alias(f"_own_{n}") for n, (kind, c) in values.items()))
    along = W.partitionBy(*by).orderBy(F.col("_segment").desc() if backward else F.col("_segment")).rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select(*(F.col(c).alias(f"_key_{i}") for i, c in enumerate([*by, "_segment"])), *(_KINDS[kind](f"_own_{n}").over(along).alias(f"_carry_{n}") for n, (kind, _) in values.items()))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_key_{i}")) for i, c in enumerate([*by, "_segment"])))
    order = [at] if ties else [at, *(order or [])]
    turned = [(F.col(c) if isinstance(c, str) else c).desc() if backward else c for c in order]
    within = W.partitionBy(*by, "_segment").orderBy(*turned)
    within = within.rangeBetween(W.unboundedPreceding, 0) if ties else within.rowsBetween(W.unboundedPreceding, 0)
    made = rows.join(carried, same).withColumns({n: _JOINED[kind](F.col(f"_carry_{n}"), _KINDS[kind](c).over(within)) for n, (kind, c) in values.items()})
    return made.select(*df.columns, *values)


def previous(df: DataFrame, by: list[str], at: str, columns: dict[str, Column], order: list[str] | None = None, width: int = WIDTH) -> DataFrame:
    """Adds columns of the row before, in order of position and `order`; null for a group's first."""
    key = F.struct(at, *(order or []))
    value = F.struct(*(c.alias(n) for n, c in columns.items()))
    rows = df.withColumn("_segment", segment(at, width))
    last = rows.groupBy(*by, "_segment").agg(F.max_by(value, key).alias("_last"))
    carried = last.select(*(F.col(c).alias(f"_key_{i}") for i, c in enumerate([*by, "_segment"])), F.lag("_last").over(W.partitionBy(*by).orderBy("_segment")).alias("_before"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_key_{i}")) for i, c in enumerate([*by, "_segment"])))
    within = W.partitionBy(*by, "_segment").orderBy(at, *(order or []))
    found = rows.join(carried, same).withColumns({"_lag": F.lag(value).over(within), "_first": F.row_number().over(within) == 1})
    found = found.withColumn("_lag", F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_lag")))
    return found.select(*df.columns, *(F.col(f"_lag.{n}").alias(n) for n in columns))


def stretches(df: DataFrame, by: list[str], at: str, tolerance: int, name: str = "stretch", width: int = WIDTH) -> DataFrame:
    """Adds the position at which a row's stretch begins: a new one does where the position before is farther than the tolerance."""
    rows = previous(df, by, at, {"_p": F.col(at)}, width=width)
    begins = F.coalesce(F.col(at) - F.col("_p") > tolerance, F.lit(True))
    return running(rows, by, at, {name: ("max", F.when(begins, F.col(at)))}, width=width, ties=True).drop("_p")


def around(df: DataFrame, by: list[str], at: str, reach: int, values: dict[str, Column], width: int = WIDTH) -> DataFrame:
    """Adds sums over the rows of a group within reach of each position; rows near a border are lent to the next segment."""
    width = max(width, reach)
    lent = df.withColumns({"_own": segment(at, width), "_segment": F.explode(F.sequence(segment(F.col(at) - reach, width), segment(F.col(at) + reach, width)))})
    near = W.partitionBy(*by, "_segment").orderBy(at).rangeBetween(-reach, reach)
    return lent.withColumns({n: F.sum(c).over(near) for n, c in values.items()}).where("_own = _segment").select(*df.columns, *values)
