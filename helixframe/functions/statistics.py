"""Statistics of allele counts: closed forms as column expressions, exact tests as vectorised Arrow functions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Two-sided 95 % point of the normal distribution.
Z95 = 1.959963984540054


def wilson(alt: Column, depth: Column, z: float = Z95) -> Column:
    """struct(low, high): the score interval with continuity correction (Newcombe 1998, method 4); null at depth 0 or alt > depth."""
    a, n = alt.cast("double"), depth.cast("double")
    zz, one = F.lit(z * z), F.lit(1.0)
    denominator = 2.0 * (n + zz)

    def bound(sign: int, edge: Column) -> Column:
        under = zz + sign * 2.0 - one / n + 4.0 * (a / n) * (n - a - sign * 1.0)
        root = F.sqrt(F.greatest(under, F.lit(0.0)))
        value = (2.0 * a + zz + sign * 1.0 + sign * z * root) / denominator
        return F.when(edge, F.lit(0.0 if sign < 0 else 1.0)).otherwise(F.greatest(F.lit(0.0), F.least(one, value)))

    low, high = bound(-1, alt == 0), bound(1, alt == depth)
    return F.when((depth > 0) & (alt <= depth), F.struct(F.least(low, high).alias("low"), F.greatest(low, high).alias("high")))


def newcombe(af_e: Column, ci_e: Column, af_s: Column, ci_s: Column) -> Column:
    """struct(delta, low, high): difference of two proportions with the hybrid score interval, clamped to [-1, 1]."""
    delta = af_e - af_s
    down = F.sqrt((af_e - ci_e["low"]) * (af_e - ci_e["low"]) + (ci_s["high"] - af_s) * (ci_s["high"] - af_s))
    up = F.sqrt((ci_e["high"] - af_e) * (ci_e["high"] - af_e) + (af_s - ci_s["low"]) * (af_s - ci_s["low"]))
    return F.struct(delta.alias("delta"), F.greatest(F.lit(-1.0), delta - down).alias("low"), F.least(F.lit(1.0), delta + up).alias("high"))


def _log_choose(n: int, k: np.ndarray | int):
    lg = np.vectorize(math.lgamma, otypes=[float])
    return math.lgamma(n + 1) - lg(np.asarray(k) + 1.0) - lg(n - np.asarray(k) + 1.0)


def fisher_p(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p of [[a, b], [c, d]]: the chance of tables no likelier than the observed one; 1 with an empty margin."""
    top, bottom, left = a + b, c + d, a + c
    if not (top and bottom and left and b + d):
        return 1.0
    x = np.arange(max(0, left - bottom), min(top, left) + 1)
    log_p = _log_choose(top, x) + _log_choose(bottom, left - x) - float(_log_choose(top + bottom, left))
    p = np.exp(log_p)
    return float(min(1.0, p[p <= p[a - x[0]] * (1 + 1e-7)].sum()))


def binomial_upper_tail(k: int, n: int, rate: float) -> float:
    """P(X >= k) of n draws; the smaller tail is summed."""
    if k <= 0 or rate >= 1:
        return 1.0
    if rate <= 0 or k > n:
        return 0.0
    lower = k <= n * rate
    x = np.arange(0, k) if lower else np.arange(k, n + 1)
    p = float(np.exp(_log_choose(n, x) + x * math.log(rate) + (n - x) * math.log1p(-rate)).sum())
    return min(1.0, max(0.0, 1 - p if lower else p))


@F.pandas_udf(DoubleType())
def fisher_exact(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """fisher_p of columns; equal tables of a batch are computed once."""
    rows = pd.DataFrame({"a": a, "b": b, "c": c, "d": d})
    known = {t: fisher_p(*t) for t in set(rows.itertuples(index=False, name=None))}
    return pd.Series([known[t] for t in rows.itertuples(index=False, name=None)])


@F.pandas_udf(DoubleType())
def binomial_tail(k: pd.Series, n: pd.Series, rate: pd.Series) -> pd.Series:
    """binomial_upper_tail of columns; equal arguments of a batch are computed once. Null at depth 0 or k > n."""
    rows = list(zip(k, n, rate))
    known = {t: None if t[1] == 0 or t[0] > t[1] else binomial_upper_tail(*t) for t in set(rows)}
    return pd.Series([known[t] for t in rows], dtype=float)


def benjamini_hochberg(df: DataFrame, p: str, q: str, by: list[str] | None = None, tie: list[str] | None = None) -> DataFrame:
    """Adds the false-discovery q-value of a p-value column, over all rows or within groups.

    Distinct p-values are counted first (map-side), so that the ordered pass sees one row for each of them and not the
    table; a rank is the cumulative count, and tied p-values share the q-value of the last. Over all rows, the ordered
    passes run by ranges of p, so they never meet in one task.
    """
    by = by or []
    counts = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("_n"))
    if not by:
        from helixframe.operators.ranks import least_from, running_sum

        ranked = running_sum(counts, [p], "_n", "_rank")
        m = ranked.agg(F.max("_rank")).first()[0] or 0
        valued = ranked.withColumn("_v", F.least(F.lit(1.0), F.col(p) * F.lit(float(m)) / F.col("_rank").cast("double")))
        return df.join(least_from(valued, [p], "_v", q).select(p, q), p, "left")
    up, down = W.partitionBy(*by).orderBy(p), W.partitionBy(*by).orderBy(F.col(p).desc())
    ranked = counts.withColumn("_rank", F.sum("_n").over(up)).withColumn("_m", F.sum("_n").over(W.partitionBy(*by)))
    value = F.least(F.lit(1.0), F.col(p) * F.col("_m").cast("double") / F.col("_rank").cast("double"))
    adjusted = ranked.withColumn("_v", value).withColumn(q, F.min("_v").over(down)).select(*by, p, q)
    return df.join(adjusted, [*by, p], "left")
