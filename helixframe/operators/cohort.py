"""Many samples at once: recurrence, presence matrices, comparison with truth, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.operators.ranks import running_sum


def recurrence(observed: DataFrame, event: str, clone: str, clones: int) -> DataFrame:
    """(event, n_clones, scope): clone_specific, shared_subset or shared_all; repeated rows of a clone count once."""
    n = F.count_distinct(clone)
    scope = F.when(n == 1, "clone_specific").when(n == clones, "shared_all").otherwise("shared_subset")
    return observed.groupBy(event).agg(n.alias("n_clones"), scope.alias("scope"))


def presence_matrix(observed: DataFrame, event: str, clone: str, clones: list[str]) -> DataFrame:
    """One row an event, one 0/1 column clone_<id> for each of the given clones."""
    return observed.groupBy(event).agg(*(F.max(F.when(F.col(clone) == c, 1).otherwise(0)).alias(f"clone_{c}") for c in clones))


def confusion(rows: DataFrame, by: list[str], truth: Column, called: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1 for each group; null where a denominator is 0."""
    t, c = F.coalesce(truth, F.lit(False)), F.coalesce(called, F.lit(False))
    counts = rows.groupBy(*by).agg(F.count_if(t & c).alias("tp"), F.count_if(~t & c).alias("fp"), F.count_if(t & ~c).alias("fn"), F.count_if(~t & ~c).alias("tn"))
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(*by, "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def leftovers(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of either table that the other lacks, with side only_a or only_b: one full outer join of distinct keys."""
    left, right = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    return left.join(right, keys, "full_outer").where("_a is null or _b is null").select(*keys, F.when(F.col("_a").isNotNull(), "only_a").otherwise("only_b").alias("side"))


def spread(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, least, quartiles (interpolated), greatest of a value for each group."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("low"), q.alias("_q"), F.max(value).alias("high")).select(*by, "n", "low", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), "high")


def merged_metrics(rows: DataFrame, by: list[str], value: str, missing: str = "NOT_EVALUABLE") -> DataFrame:
    """The one value that a group's rows agree on, else a marker."""
    return rows.groupBy(*by).agg(F.when(F.count_distinct(value) == 1, F.min(F.col(value).cast("string"))).otherwise(missing).alias(value))


def numbered(rows: DataFrame, order: list[str], prefix: str, digits: int, name: str) -> DataFrame:
    """Adds display ids prefix_0001, … in a total order, counted by ranges of it."""
    counted = running_sum(rows.withColumn("_one", F.lit(1)), order, "_one", "_number")
    return counted.withColumn(name, F.format_string(f"{prefix}_%0{digits}d", F.col("_number"))).drop("_one", "_number")
