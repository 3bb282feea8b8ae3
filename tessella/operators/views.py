"""What viewers show of an archive: chart points, shades, previews, filtered and sorted cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def scaled(value: Column, low: Column, high: Column, size: float, flat: float) -> Column:
    """``value`` from [low, high] to [0, size]; ``flat`` where there is no span."""
    return F.when(high > low, (value - low) * size / (high - low)).otherwise(flat)


def chart(rows: DataFrame, x: str, y: str, *keys: str, width: float = 300.0, height: float = 80.0) -> DataFrame:
    """(keys, x, px, py): points of a line in pixels, the origin at the top; rows without y are left out.

    The ends are one aggregate a chart, joined back, so no chart is one window.
    """
    own = rows.where(F.col(y).isNotNull())
    ends = own.groupBy(*keys).agg(F.min(x).alias("_x0"), F.max(x).alias("_x1"), F.min(y).alias("_y0"), F.max(y).alias("_y1"))
    whole = own.join(ends, list(keys)) if keys else own.crossJoin(F.broadcast(ends))
    px = scaled(F.col(x).cast("double"), F.col("_x0"), F.col("_x1"), width, 0.0)
    py = height - scaled(F.col(y).cast("double"), F.col("_y0"), F.col("_y1"), height, height / 2)
    return whole.select(*keys, x, px.alias("px"), py.alias("py"))


def shaded(coverage: DataFrame, levels: int = 4) -> DataFrame:
    """A coverage histogram (axis, bucket, n) with a shade 1 .. levels by the share of the axis's fullest bucket."""
    top = F.max("n").over(Window.partitionBy("axis"))
    return coverage.withColumn("shade", F.least(F.ceil(F.col("n") * float(levels) / top), F.lit(levels)).cast("int"))


def preview(best: DataFrame, *keys: str) -> DataFrame:
    """The first occupied cell of each archive."""
    rest = [c for c in best.columns if c not in keys]
    return best.groupBy(*keys).agg(F.min_by(F.struct(*rest), "cell").alias("_r")).select(*keys, "_r.*")


def cells(best: DataFrame, *keys: str, least: float | None = None, ranges: dict[str, tuple[float, float]] | None = None, by: str = "cell") -> DataFrame:
    """Occupied cells that a viewer keeps, with their place: of a least quality, with axes in ranges.

    Sorted by cell (that is by centroid), or by another column, greatest first.
    """
    rows = best if least is None else best.where(F.col("quality") >= least)
    for axis, (low, high) in (ranges or {}).items():
        rows = rows.where(F.col(axis).between(low, high))
    order = [F.col("cell")] if by == "cell" else [F.col(by).desc(), F.col("cell")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def page(best: DataFrame, centroids: DataFrame, run: str = "run_id") -> DataFrame:
    """(run, document): an archive's cards as one JSON list, in the order of the centroids; an archive has a bounded number of cells."""
    card = F.struct(F.col("cell"), "c0", "c1", "c2", F.round("quality", 4).alias("quality"), *[F.round(f"d{i}", 6).alias(f"d{i}") for i in range(3)], "arrival")
    rows = best.join(centroids.withColumnRenamed("idx", "cell"), "cell").select(run, card.alias("card"))
    return rows.groupBy(run).agg(F.to_json(F.array_sort(F.collect_list("card"))).alias("document"))


def colour(value: Column, palette: list[str]) -> Column:
    """The entry of a palette for a value of [0, 1]; values outside go to the ends."""
    at = F.least(F.greatest(F.floor(value * len(palette)), F.lit(0)), F.lit(len(palette) - 1))
    return F.get(F.array(*[F.lit(c) for c in palette]), at.cast("int"))
