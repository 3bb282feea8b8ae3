"""Running totals, row numbers and row frames of ordered groups of any size.

A window over a group is one task's work, and one search may hold most of the
rows. Here the rows are cut into segments by range of (keys, order), about
``segment_rows`` each, so a segment is a stretch of consecutive rows. Totals run
inside the segments; what a group has before a segment is carried in from the
totals of its earlier segments, a row a segment. Frames of rows before and after
are made in blocks of consecutive row numbers that bring along the rows of their
neighbours that their frames reach.

Input of at most ``segment_rows`` rows is one segment, and a plain window.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tessella.operators.percentiles import matched
from tessella.sources.tables import stage

SEGMENT_ROWS = 250_000
TOTALS: dict[str, Callable] = {"max": F.max, "min": F.min, "sum": F.sum}
#: A total of two parts, of which either may be null.
JOINED: dict[str, Callable] = {"max": F.greatest, "min": F.least, "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}


@dataclass(frozen=True)
class Segments:
    """Rows with the number of their segment in ``_segment``; in order of ``order`` in each group."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    several: bool

    def scan(self, totals: dict[str, tuple[str, Column]], inclusive: bool = True) -> Segments:
        """With a column for each total (kind, value): that of the rows before a row, and of itself if ``inclusive``.

        A total of no rows is null, and 0 for sums.
        """
        where = [*self.keys, "_segment"]
        upto = Window.partitionBy(*where).orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        rows = self.rows.withColumns({n: TOTALS[kind](value).over(upto) for n, (kind, value) in totals.items()})
        if self.several:
            each = self.rows.groupBy(*where).agg(*[TOTALS[kind](value).alias(f"_{n}") for n, (kind, value) in totals.items()])
            earlier = Window.partitionBy(*self.keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
            carried = each.select(*where, F.count("*").over(earlier).alias("_before"), *[TOTALS[kind](f"_{n}").over(earlier).alias(f"_{n}") for n, (kind, _) in totals.items()])
            # only a group that goes on from one segment to the next has any: a row a segment at most
            carried = stage(carried.where("_before > 0").drop("_before"), "carried")
            rows = matched(rows, carried, where, how="left")
            rows = rows.withColumns({n: JOINED[kind](F.col(n), F.col(f"_{n}")) for n, (kind, _) in totals.items()}).drop(*[f"_{n}" for n in totals])
        sums = {n: F.coalesce(n, F.lit(0)) for n, (kind, _) in totals.items() if kind == "sum"}
        return replace(self, rows=rows.withColumns(sums) if sums else rows)

    def done(self) -> DataFrame:
        return self.rows.drop("_segment")


def segments(rows: DataFrame, keys: tuple[str, ...] | list[str], order: tuple[str, ...] | list[str], segment_rows: int = SEGMENT_ROWS) -> Segments:
    """``rows`` cut for scans; several segments are written, so that all passes see the same ones."""
    n = rows.count()
    if n <= segment_rows:
        return Segments(rows.withColumn("_segment", F.lit(0)), tuple(keys), tuple(order), False)
    cut = rows.repartitionByRange(math.ceil(n / segment_rows), *keys, *order).withColumn("_segment", F.spark_partition_id())
    return Segments(stage(cut, "segments"), tuple(keys), tuple(order), True)


def numbered(rows: DataFrame, keys: tuple[str, ...] | list[str], order: tuple[str, ...] | list[str], segment_rows: int = SEGMENT_ROWS) -> Segments:
    """Segments with ``i``: the number of a row in its group, from 0."""
    return segments(rows, keys, order, segment_rows).scan({"i": ("sum", F.lit(1))}, inclusive=False)


def framed(rows: DataFrame, keys: tuple[str, ...] | list[str], order: tuple[str, ...] | list[str], before: int, after: int, columns: dict[str, Callable[[WindowSpec], Column]], segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """rows with ``i`` and, for each column, its function of the frame from ``before`` rows before to ``after`` rows after."""
    found = numbered(rows, keys, order, segment_rows)
    now, group = found.done(), list(keys)
    if found.several:
        size = max(segment_rows, before + after, 1)
        block = lambda i: F.floor(i / size)
        reach = F.array_distinct(F.array(block(F.col("i")), block(F.col("i") + before), block(F.col("i") - after)))
        now = now.withColumn("_block", F.explode(F.filter(reach, lambda b: b >= 0)))
        group.append("_block")
    frame = Window.partitionBy(*group).orderBy("i").rowsBetween(-before, after)
    now = now.withColumns({n: f(frame) for n, f in columns.items()})
    return now.where(F.col("_block") == F.floor(F.col("i") / size)).drop("_block") if found.several else now
