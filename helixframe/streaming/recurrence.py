"""Clones that arrive over time: running recurrence of their events. The batch operators serve finite tables; this is
the same count kept by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recurrence_stream(observed: DataFrame, event: str, clone: str, at: str, late: str = "1 hour") -> DataFrame:
    """A stream of (event, clone, at) to a stream of (event, n_clones), updated as clones arrive.

    A clone's repeats within the watermark are dropped by event and clone, so the state is bounded by what is distinct
    and recent; the counts are exact for repeats that come no later.
    """
    once = observed.withWatermark(at, late).dropDuplicatesWithinWatermark([event, clone])
    return once.groupBy(event).agg(F.count("*").alias("n_clones"))


def windowed_counts(observed: DataFrame, by: str, at: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, by, n) by tumbling windows of event time; a window is final once the watermark passes it."""
    return observed.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
