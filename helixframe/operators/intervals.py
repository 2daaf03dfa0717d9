"""Joins by distance and runs along an axis.

A range condition alone plans as a nested loop; here each side gets the bins that it can meet as an equi key, so the
join is a hash or merge join that adaptive execution can split, and pairs that share several bins are counted in the
first only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.functions.geometry import interval_distance
from helixframe.operators import segments


def _bin(x: Column, width: int) -> Column:
    return F.floor(x / F.lit(width)).cast("long")


def band_join(left: DataFrame, right: DataFrame, on: list[str], left_at: str, right_at: str, tolerance: int) -> DataFrame:
    """Pairs with equal keys whose positions differ by at most the tolerance; columns of both sides, keys once.

    Bins are one tolerance wide: a left row looks into three, a right row lies in one, so no pair comes twice.
    """
    width = tolerance + 1
    a = left.withColumn("_bin", F.explode(F.array(*(_bin(F.col(left_at), width) + F.lit(k).cast("long") for k in (-1, 0, 1)))))
    b = right.withColumn("_bin", _bin(F.col(right_at), width))
    return a.join(b, [*on, "_bin"]).where(F.abs(F.col(left_at) - F.col(right_at)) <= tolerance).drop("_bin")


def window_join(left: DataFrame, right: DataFrame, on: list[str], left_span: tuple[str, str], right_span: tuple[str, str], within: int = 0, width: int = 10_000) -> DataFrame:
    """Pairs with equal keys whose closed intervals lie within a distance (0: they overlap), with the column distance.

    Intervals are put into every bin that they touch, the left ones widened by the distance; of the bins that a pair
    shares, the one where the later start lies counts. width should be near the usual length of an interval.
    """
    (a0, a1), (b0, b1) = left_span, right_span
    a = left.withColumn("_bin", F.explode(F.sequence(_bin(F.col(a0) - within, width), _bin(F.col(a1) + within, width))))
    b = right.withColumn("_bin", F.explode(F.sequence(_bin(F.col(b0), width), _bin(F.col(b1), width))))
    first = _bin(F.greatest(F.col(a0) - within, F.col(b0)), width)
    pairs = a.join(b, [*on, "_bin"]).where(F.col("_bin") == first)
    pairs = pairs.withColumn("distance", interval_distance(F.col(a0), F.col(a1), F.col(b0), F.col(b1)))
    return pairs.where(F.col("distance") <= within).drop("_bin")


def best_of(pairs: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first pair of each group in a total order, by a map-side combined minimum over structs."""
    names = [c for c in pairs.columns if c not in by]
    key = F.struct(*(c.alias(f"_o{i}") for i, c in enumerate(order)))
    return pairs.groupBy(*by).agg(F.min_by(F.struct(*names), key).alias("_best")).select(*by, "_best.*")


def nearest(points: DataFrame, features: DataFrame, on: list[str], at: str, start: str, end: str, name: str) -> DataFrame:
    """For each point, the closest feature that ends before it and the closest that begins after it, by an as-of union.

    Adds up_name, up_end, down_name, down_start, null where there is none. Of features with the same end the last name
    counts, of those with the same start the first. Rows are dealt by key and segment of the axis.
    """
    mark = lambda df, pos, kind, ids: df.select(*on, F.col(pos).alias("_pos"), F.lit(kind).alias("_kind"), *ids)
    other = [c for c in points.columns if c not in on]
    row = F.struct(*other).alias("_row")
    none = F.lit(None).cast(points.select(F.struct(*other).alias("r")).schema["r"].dataType).alias("_row")
    asked = points.select(*on, F.col(at).alias("_pos"), F.lit(1).alias("_kind"), row, F.lit(None).cast("string").alias("_name"))
    ends = features.select(*on, F.col(end).alias("_pos"), F.lit(2).alias("_kind"), none, F.col(name).cast("string").alias("_name"))
    starts = features.select(*on, F.col(start).alias("_pos"), F.lit(0).alias("_kind"), none, F.col(name).cast("string").alias("_name"))
    # up: rows before in order of (position, point before end at the same place); down: rows after, mirrored
    rows = asked.unionByName(ends).unionByName(starts)
    found = F.struct("_pos", "_name")
    rows = segments.running(rows, on, "_pos", {"_up": ("max", F.when(F.col("_kind") == 2, found))}, ["_kind", "_name"])
    rows = segments.running(rows, on, "_pos", {"_down": ("min", F.when(F.col("_kind") == 0, found))}, ["_kind", "_name"], backward=True)
    return rows.where("_kind = 1").select(*on, "_row.*", F.col("_up._name").alias("up_name"), F.col("_up._pos").alias("up_end"), F.col("_down._name").alias("down_name"), F.col("_down._pos").alias("down_start"))


def islands(df: DataFrame, by: list[str], at: str, breaks: Column) -> DataFrame:
    """Adds island: a number that grows at each row, in order of position, where breaks is true."""
    return segments.running(df, by, at, {"island": ("sum", F.when(breaks, 1).otherwise(0))})


def adjacent_runs(df: DataFrame, by: list[str], at: str) -> DataFrame:
    """Adds run: rows of a group with consecutive positions share one. Positions are distinct in a group."""
    return segments.running(df, by, at, {"run": ("sum", F.lit(1))}).withColumn("run", F.col(at) - F.col("run"))


def depth_of(intervals: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Depth along the axis as steps: (by, pos, depth), one row where the depth of closed intervals may change.

    +1 and -1 are summed by position before the running sum, so what is ordered has two rows an interval at most.
    """
    one = intervals.select(*by, F.col(start).alias("pos"), F.lit(1).alias("d")).union(intervals.select(*by, (F.col(end) + 1).alias("pos"), F.lit(-1).alias("d")))
    steps = one.groupBy(*by, "pos").agg(F.sum("d").alias("d"))
    return segments.running(steps, by, "pos", {"depth": ("sum", F.col("d"))}).select(*by, "pos", "depth")


def dense(df: DataFrame, by: list[str], at: str, bounds: DataFrame, values: list[str]) -> DataFrame:
    """One row for each position of bounds (by, low, high), with 0 for values that df lacks."""
    axis = bounds.select(*by, F.explode(F.sequence("low", "high")).alias(at))
    return axis.join(df, [*by, at], "left").select(*by, at, *(F.coalesce(v, F.lit(0)).alias(v) for v in values))


def coverage_cutoff(depth: DataFrame, by: list[str], value: str = "unique_depth") -> DataFrame:
    """(by, cutoff): a quarter of the upper median of the depths over 0, but 2 at least.

    Depths are counted first, so the ordered pass has a row for each distinct depth.
    """
    counts = depth.groupBy(*by, value).agg(F.count("*").alias("n"))
    up = W.partitionBy(*by).orderBy(value)
    some = counts.where(F.col(value) > 0).withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(W.partitionBy(*by)))
    middle = some.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(*by).agg(F.min(value).alias("median"))
    cut = middle.select(*by, F.greatest(F.lit(2), F.floor(F.col("median") / 4)).cast("long").alias("cutoff"))
    return depth.select(*by).distinct().join(cut, by, "left").select(*by, F.coalesce("cutoff", F.lit(2)).cast("long").alias("cutoff"))


def missing_coverage(depth: DataFrame, by: list[str], at: str, cutoff: DataFrame, least: int = 1, value: str = "unique_depth") -> DataFrame:
    """Spans that begin at a depth of 0 and last while it is under the cutoff: (by, start_0, end_0), end exclusive.

    depth is dense along the axis. Positions at the cutoff or over number the islands between them.
    """
    rows = depth.join(cutoff, by)
    low = F.col(value) < F.col("cutoff")
    marked = islands(rows, by, at, ~low).where(low)
    spans = marked.groupBy(*by, "island").agg(F.min(F.when(F.col(value) == 0, F.col(at))).alias("start_0"), (F.max(at) + 1).alias("end_0"))
    return spans.where(F.col("end_0") - F.col("start_0") >= least).select(*by, "start_0", "end_0")


def promoted_deletions(spans: DataFrame, depth: DataFrame, by: list[str], at: str, cutoff: DataFrame, least: int = 50, least_with_junction: int = 3, flank: int = 20, junctions: DataFrame | None = None) -> DataFrame:
    """Missing spans that are deletions: (by, start_0, end_0) of their cores.

    A core has unique depth 0 and total depth under the cutoff at both ends and total depth under it throughout; it
    touches no end of the sequence; both flanks reach the cutoff within `flank`, or junction endpoints (by, endpoint,
    1-based) lie at both; it has the least length.
    """
    ends = depth.groupBy(*by).agg(F.min(at).alias("_low"), F.max(at).alias("_high"))
    named = spans.withColumn("_span", F.struct("start_0", "end_0"))
    near = named.withColumn("_from", F.col("start_0") - flank).withColumn("_to", F.col("end_0") - 1 + flank)
    d = depth.withColumn("_at", F.col(at))
    inside = window_join(near.select(*by, "_span", "_from", "_to"), d, by, ("_from", "_to"), (at, "_at"), 0, 256).join(cutoff, by)
    gone = (F.col("unique_depth") == 0) & (F.col("total_depth") < F.col("cutoff"))
    within = (F.col(at) >= F.col("_span.start_0")) & (F.col(at) < F.col("_span.end_0"))
    cores = inside.groupBy(*by, "_span").agg(F.min(F.when(within & gone, F.col(at))).alias("a"), (F.max(F.when(within & gone, F.col(at))) + 1).alias("b")).where("a is not null")
    again = inside.join(cores, [*by, "_span"])
    p, covered = F.col(at), F.col("unique_depth") >= F.col("cutoff")
    facts = again.groupBy(*by, "_span", "a", "b").agg(
        F.bool_and(F.when((p >= F.col("a")) & (p < F.col("b")), F.col("total_depth") < F.col("cutoff")).otherwise(True)).alias("empty"),
        F.bool_or((p < F.col("a")) & (p >= F.col("a") - flank) & covered).alias("left"),
        F.bool_or((p >= F.col("b")) & (p < F.col("b") + flank) & covered).alias("right"),
    )
    facts = facts.join(ends, by).where("_span.start_0 > _low and _span.end_0 <= _high and a > _low and b <= _high")
    if junctions is not None:
        j = junctions.withColumn("_e", F.col("endpoint"))
        e = F.col("endpoint")
        sides = window_join(facts.withColumn("_a", F.col("a") - flank).withColumn("_b", F.col("b") + 1 + flank), j, by, ("_a", "_b"), ("endpoint", "_e"), 0, 256)
        sides = sides.groupBy(*by, "_span").agg(F.bool_or((F.abs(e - F.col("a")) <= flank) & (e <= F.col("a") + 1)).alias("jl"), F.bool_or((F.abs(e - F.col("b") - 1) <= flank) & (e >= F.col("b"))).alias("jr"))
        facts = facts.join(sides, [*by, "_span"], "left").withColumn("joined", F.coalesce(F.col("jl") & F.col("jr"), F.lit(False)))
    else:
        facts = facts.withColumn("joined", F.lit(False))
    size = F.col("b") - F.col("a")
    return facts.where("empty").where(F.when(F.col("joined"), size >= least_with_junction).otherwise(F.col("left") & F.col("right") & (size >= least))).select(*by, F.col("a").alias("start_0"), F.col("b").alias("end_0"))
