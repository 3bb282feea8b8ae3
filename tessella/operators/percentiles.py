"""Exact percentiles of groups of any size, by repeated histograms.

``F.percentile`` keeps every different value of a group in one buffer. Here no
buffer holds more than ``bins`` values: every order statistic that is asked for
lies in an interval of values; a histogram of the interval's rows, with the exact
least and greatest value of each bin, says which bin it is in, and that bin is
the next interval. An interval of at most ``bins`` rows is gathered and sorted.
All groups, columns and percentiles take part in each pass together; intervals
are a table, joined to the rows by group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.tables import release, stage

BINS = 4096
#: The greatest double.
MOST = 1.7976931348623157e308
#: What a row of an interval is.
INSIDE = "v BETWEEN low AND high"


def matched(a: DataFrame, b: DataFrame, names: list[str], also: Column | None = None, how: str = "inner") -> DataFrame:
    """Join on equal columns, nulls equal too, and on ``also``; other columns of the two differ in name."""
    right = b.select(*[F.col(n).alias(f"_{n}") for n in names], *[c for c in b.columns if c not in names])
    on = reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names])
    return a.join(right, on if also is None else on & also, how).drop(*[f"_{n}" for n in names])


def spread(v: Column) -> Column:
    """Rises with v as logarithms do, on both sides of 0."""
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * (F.log(F.abs(v)) + 745))  # -744.4: the least double


def share_of(v: Column, low: Column, high: Column, parts: int) -> Column:
    """Which of ``parts`` equal parts of [low, high] v is in; all are in the first without a width."""
    return F.when(high > low, F.least(F.floor((v - low) / F.nullif(high - low, F.lit(0.0)) * parts), F.lit(parts - 1))).otherwise(F.lit(0))


def bin_of(v: Column, low: Column, high: Column, bins: int) -> Column:
    """Bins in the order of the values; the ends of an interval are never in one bin.

    The sum of a place on a linear and one on a logarithmic scale: both rise with
    the value, so equal sums are equal places on both, and an interval narrows
    whether its values are even or of many magnitudes. -inf is bin -1, the upper
    end, inf and NaN are behind all others. Halves keep widths finite.
    """
    ends = [F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(limit)).otherwise(c) for c, limit in ((low, -MOST), (high, MOST))]
    half = max(1, bins // 2)
    places = share_of(v / 2, ends[0] / 2, ends[1] / 2, half) + share_of(spread(v), spread(ends[0]), spread(ends[1]), half)
    return F.when(F.isnan(v), 2 * half + 2).when(v == float("inf"), 2 * half + 1).when(v == -float("inf"), -1).when(v >= high, 2 * half).otherwise(places).cast("int")


def percentiles(rows: DataFrame, columns: list[str], shares: list[float], *keys: str, bins: int = BINS) -> DataFrame:
    """(keys, axis, share, value): percentiles of each column, interpolated; ``axis`` is its place in ``columns``.

    Nulls do not count, NaN is the greatest value; a column of a group without
    values has no row. The rows are written narrow once, and read again by each
    pass; a pass narrows an interval to about one in ``bins`` of its rows.
    """
    names = [*keys, "axis"]
    narrow = stage(rows.select(*keys, *[(F.col(c).cast("double") + F.lit(0.0)).alias(f"_{i}") for i, c in enumerate(columns)]), "narrow")
    long = narrow.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), F.col(f"_{i}").alias("v")) for i in range(len(columns))])).alias("x")).select(*keys, "x.*").where("v is not null")
    ends = long.groupBy(*names).agg(F.count("*").alias("m"), F.min("v").alias("low"), F.max("v").alias("high"))
    at = (F.col("m") - 1) * F.col("share")
    sides = F.when(at == F.floor(at), F.array(F.struct(F.floor(at).alias("rank"), F.lit(1.0).alias("weight")))).otherwise(F.array(F.struct(F.floor(at).alias("rank"), (F.ceil(at) - at).alias("weight")), F.struct(F.ceil(at).alias("rank"), (at - F.floor(at)).alias("weight"))))
    wanted = ends.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares]))).withColumn("side", F.explode(sides))
    state = stage(wanted.select(*names, "share", "side.weight", "side.rank", "m", "low", "high"), "intervals")
    is_open = (F.col("low") < F.col("high")) & (F.col("m") > bins)
    while not state.where(is_open).isEmpty():
        left = state.where(is_open)
        state, before = stage(narrowed(long, left, names, bins).unionByName(state.where(~is_open)), "intervals"), state
        release(before)
    few = state.where("low < high").select(*names, "low", "high").distinct()
    held = matched(long, few, names, F.expr(INSIDE)).groupBy(*names, "low", "high").agg(F.sort_array(F.collect_list("v")).alias("values"))
    value = F.when(F.col("low") < F.col("high"), F.get("values", F.col("rank").cast("int"))).otherwise(F.col("low"))
    found = matched(state, held, [*names, "low", "high"], how="left").select(*names, "share", "weight", value.alias("value"))
    out = stage(found.groupBy(*names, "share").agg(F.sum(F.col("weight") * F.col("value")).alias("value")), "percentiles")
    release(narrow, state)
    return out


def narrowed(long: DataFrame, state: DataFrame, names: list[str], bins: int) -> DataFrame:
    """The intervals' rows counted by bin, and of each interval the bin that its rank is in."""
    whole = [*names, "low", "high"]
    inside = matched(long, state.select(*whole).distinct(), names, F.expr(INSIDE))
    rows = inside.withColumn("bin", bin_of(F.col("v"), F.col("low"), F.col("high"), bins))
    counts = rows.groupBy(*whole, "bin").agg(F.count("*").alias("n"), F.min("v").alias("first"), F.max("v").alias("last"))
    upto = Window.partitionBy(*whole).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # an interval's bins
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    mine = (F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))
    found = matched(state.drop("m"), counts, whole, mine)
    return found.select(*names, "share", "weight", (F.col("rank") - F.col("before")).alias("rank"), F.col("n").alias("m"), F.col("first").alias("low"), F.col("last").alias("high"))
