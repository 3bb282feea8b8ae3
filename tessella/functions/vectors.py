"""Column expressions on arrays: products, distances, bounds, entropies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


def dot(x: Column, y: Column) -> Column:
    """Dot product; 0 where the lengths differ."""
    return F.when(F.size(x) == F.size(y), total(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")))).otherwise(0.0)


def distance(x: Column, y: Column) -> Column:
    return F.sqrt(total(F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double")))))


def argmax(x: Column) -> Column:
    """First place of the greatest element, from 0."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def within(x: Column, low: float, high: float) -> Column:
    return F.forall(x, lambda v: v.between(low, high))


def within_nested(x: Column, low: float, high: float) -> Column:
    return F.forall(x, lambda row: within(row, low, high))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def safe_ratio(a: Column, b: Column, otherwise: float | None = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise))


def wrapped(angle: Column) -> Column:
    """An angle difference brought to [-pi, pi)."""
    two_pi = 2 * F.pi()
    shifted = angle + F.pi()
    return shifted - F.floor(shifted / two_pi) * two_pi - F.pi()


def upper_median(x: Column) -> Column:
    """sorted[n // 2] of an array."""
    return F.get(F.array_sort(x), F.floor(F.size(x) / 2).cast("int"))
