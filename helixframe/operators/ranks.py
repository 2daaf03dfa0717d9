"""Running sums and minima over a whole table in an order, without the table in one task.

Rows are dealt out by ranges of the order and summed within each; what the ranges before or after add is one number a
range, which the driver gathers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.plans.session import cut


def _ranged(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """df in ranges of the order, numbered in the column _range."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))


def _per_range(df: DataFrame, parts: DataFrame, value: Column, start) -> DataFrame:
    """df with _base: for each range, a value made of those of the ranges that come first in parts' order."""
    made, so_far = [], start
    for r in parts.collect():  # one row a range
        made.append((r[0], so_far))
        so_far = value(so_far, r[1])
    kind = "double" if isinstance(start, float) else "long"
    return df.join(F.broadcast(df.sparkSession.createDataFrame(made, f"_range int, _base {kind}")), "_range")


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of a whole-number column over all rows up to and including each, in a total order."""
    rows = _ranged(df, order)
    rows = _per_range(rows, rows.groupBy("_range").agg(F.sum(value)).orderBy("_range"), lambda a, b: a + b, 0)
    upto = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(value).over(upto) + F.col("_base")).drop("_range", "_base")


def least_from(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the least of a real column over each row and all after it, in a total order."""
    rows = _ranged(df, order)
    rows = _per_range(rows, rows.groupBy("_range").agg(F.min(value)).orderBy(F.col("_range").desc()), min, float("inf"))
    after = W.partitionBy("_range").orderBy(*order).rowsBetween(0, W.unboundedFollowing)
    return rows.withColumn(name, F.least(F.min(value).over(after), "_base")).drop("_range", "_base")
