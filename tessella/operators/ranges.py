"""Joins of values to ranges: the latest start before a value, and shares of a cumulative sum.

Values and starts are put in one order and cut into segments by range; the start
that is in force at the end of a segment is carried into those after it, so a
range that spans many segments is known in each, and neither a hot value, a wide
range nor a single group is one task's work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators.scans import SEGMENT_ROWS, segments


def as_of(points: DataFrame, starts: DataFrame, value: str, start: str, *keys: str, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """points with the other columns of the latest row of ``starts`` of their keys whose start is at most the value.

    Of equal starts the row with the greatest other columns counts; without one,
    or without a value, they are null; rows of ``starts`` without a start are none.
    Keys may be null. Other columns of the two differ in name.
    """
    brought = [c for c in starts.columns if c not in (start, *keys)]
    kind = points.schema[value].dataType
    held = starts.where(F.col(start).isNotNull()).select(*keys, F.col(start).cast(kind).alias("_at"), F.struct(F.col(start), *[F.col(c) for c in brought]).alias("_s"))
    own = points.select(*keys, F.col(value).alias("_at"), F.struct(*[F.col(c) for c in points.columns if c not in keys]).alias("_p"))
    both = own.withColumn("_point", F.lit(1)).unionByName(held.withColumn("_point", F.lit(0)), allowMissingColumns=True)
    found = segments(both, keys, ["_at", "_point"], segment_rows).scan({"_last": ("max", F.col("_s"))}).done().where("_point = 1")
    return found.select(*keys, "_p.*", *[F.col(f"_last.{c}").alias(c) for c in brought]).select(*points.columns, *brought)


def cumulative(rows: DataFrame, size: str, *order: str, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """rows with ``low`` and ``high``: each row's share [low, high) of the running sum of ``size`` in that order."""
    found = segments(rows, [], order, segment_rows).scan({"low": ("sum", F.col(size))}, inclusive=False).done()
    return found.withColumn("high", F.col("low") + F.coalesce(F.col(size), F.lit(0)))


def assigned(points: DataFrame, owners: DataFrame, value: str, size: str, *order: str, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """points with the columns of the owner in whose share of the cumulative sizes their value lies; null beyond.

    Owners of no size own nothing.
    """
    shares = cumulative(owners, size, *order, segment_rows=segment_rows).where("high > low")
    found = as_of(points, shares, value, "low", segment_rows=segment_rows)
    inside = F.col(value) < F.col("high")
    return found.select(*points.columns, *[F.when(inside, F.col(c)).alias(c) for c in owners.columns])
