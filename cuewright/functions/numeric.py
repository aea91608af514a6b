"""Numeric, vector and interval column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, digits: int) -> Column:
    """Rounding that both Spark and plain SQL can state: floor(x * 10^d + 0.5) / 10^d."""
    return F.floor(x * 10**digits + 0.5) / float(10**digits)


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero norm counts as one."""
    one = lambda n: F.when(n == 0, 1.0).otherwise(n)
    return dot(a, b) / (one(norm(a)) * one(norm(b)))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0))


def ranges_length(r: Column) -> Column:
    return F.aggregate(r, F.lit(0).cast("long"), lambda s, x: s + x["e"] - x["s"])


def ranges_overlap(a: Column, b: Column) -> Column:
    """Summed pairwise overlap of two lists of ranges (s, e)."""
    zero = F.lit(0).cast("long")
    return F.aggregate(a, zero, lambda s, x: s + F.aggregate(b, zero, lambda t, y: t + overlap(x["s"], x["e"], y["s"], y["e"])))


def iou(a: Column, b: Column) -> Column:
    inter = ranges_overlap(a, b)
    union = ranges_length(a) + ranges_length(b) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def coverage(a: Column, b: Column) -> Column:
    """Overlap as a share of the shorter list."""
    small = F.least(ranges_length(a), ranges_length(b))
    return F.when(small > 0, ranges_overlap(a, b) / small).otherwise(F.lit(0.0))


def upper_median(values: Column) -> Column:
    s = F.array_sort(values)
    return F.get(s, F.floor(F.size(s) / 2).cast("int"))
