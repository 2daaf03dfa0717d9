"""Intervals on sequences, 1-based and closed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the record format: kinds of events by what they cover.
POINT_KINDS, SPAN_KINDS, JUNCTION_KINDS = ("SNP", "INS", "MOB"), ("SUB", "DEL", "AMP", "CON", "INV"), ("JC",)
STRUCTURAL_KINDS = ("MOB", "JC", "AMP", "CON", "INV")
PRODUCT_KINDS = ("SNP", "SUB", "INS", "DEL", "MOB", "AMP", "CON", "INV", "JC")


def interval_distance(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """0 for intervals that overlap, 1 for neighbours, and so on."""
    return F.greatest(F.lit(0).cast("long"), a_start - b_end, b_start - a_end)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def is_structural(kind: Column, size: Column) -> Column:
    """Mobile elements, junctions, copies, conversions, inversions, and deletions of more than two bases."""
    return kind.isin(*STRUCTURAL_KINDS) | ((kind == "DEL") & F.coalesce(size > 2, F.lit(False)))


def event_intervals(kind: Column, fields: Column) -> Column:
    """array<struct<side, seq_id, start, end>> of a record's positional fields: one interval, or one for each side of a junction."""
    number = lambda i: F.get(fields, F.lit(i)).try_cast("long")
    text = lambda i: F.get(fields, F.lit(i))
    one = lambda side, seq, a, b: F.struct(F.lit(side).alias("side"), seq.alias("seq_id"), a.alias("start"), b.alias("end"))
    span = F.array(one(0, text(0), number(1), number(1) + F.greatest(number(2), F.lit(1)) - 1))
    point = F.array(one(0, text(0), number(1), number(1)))
    junction = F.array(one(1, text(0), number(1), number(1)), one(2, text(3), number(4), number(4)))
    return F.when(kind.isin(*SPAN_KINDS), span).when(kind.isin(*JUNCTION_KINDS), junction).when(kind.isin(*POINT_KINDS), point)


def circular_distance(a: Column, b: Column, length: Column) -> Column:
    d = F.abs(a - b)
    return F.least(d, length - d)
