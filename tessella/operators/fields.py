"""Descriptors of fields in long form: (entity, y, x, value), zero cells left out.

Each is a two-level aggregation by entity that combines before it shuffles; no
entity's cells need to be together, except for gradients, which look at
neighbours through one window an axis.
"""

from __future__ import annotations

from collections.abc import Iterator

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.vectors import clip
from tessella.session import ship

SECTORS, BLOCK, PEAK_SHARE, CLIP = 16, 8, 0.1, 100.0


def moments(field: DataFrame, *keys: str) -> DataFrame:
    """(keys, mass, com_y, com_x, gyradius) in one pass over the cells."""
    v, y, x = F.col("value"), F.col("y"), F.col("x")
    sums = field.groupBy(*keys).agg(F.sum(v).alias("mass"), F.sum(v * y).alias("my"), F.sum(v * x).alias("mx"), F.sum(v * (y * y + x * x)).alias("mr"))
    full = F.col("mass") > 0
    cy, cx = F.col("my") / F.col("mass"), F.col("mx") / F.col("mass")
    spread = F.greatest(F.col("mr") / F.col("mass") - cy * cy - cx * cx, F.lit(0.0))
    return sums.select(*keys, "mass", F.when(full, cy).alias("com_y"), F.when(full, cx).alias("com_x"), F.when(full, clip(F.sqrt(spread), 0.0, CLIP)).otherwise(0.0).alias("gyradius"))


def bounding_box(field: DataFrame, size: int, *keys: str, share: float = PEAK_SHARE) -> DataFrame:
    """(keys, compactness, bbox_fraction): mass in the box of cells over a share of the peak, and the box's area."""
    peak = field.groupBy(*keys).agg(F.max("value").alias("peak"), F.sum("value").alias("mass"))
    marked = field.join(peak, list(keys))
    lit = F.col("value") > share * F.col("peak")
    box = marked.where(lit).groupBy(*keys).agg(*[f(c).alias(f"{n}{c}") for c in ("y", "x") for f, n in ((F.min, "lo_"), (F.max, "hi_"))])
    inside = field.join(box, list(keys)).where(F.col("y").between(F.col("lo_y"), F.col("hi_y")) & F.col("x").between(F.col("lo_x"), F.col("hi_x")))
    held = inside.groupBy(*keys).agg(F.sum("value").alias("held"), F.first((F.col("hi_y") - F.col("lo_y") + 1) * (F.col("hi_x") - F.col("lo_x") + 1)).alias("area"))
    return peak.join(held, list(keys), "left").select(*keys, F.when(F.col("mass") > 0, F.col("held") / F.col("mass")).otherwise(0.0).alias("compactness"), (F.coalesce("area", F.lit(0)) / float(size * size)).alias("bbox_fraction"))


def rotational_symmetry(field: DataFrame, *keys: str, sectors: int = SECTORS) -> DataFrame:
    """Variance of mass over angular sectors about the centre, as a share of the greatest possible."""
    centre = moments(field, *keys)
    about = field.join(centre, list(keys))
    angle = F.atan2(F.col("y") - F.col("com_y"), F.col("x") - F.col("com_x"))
    sector = F.least(F.floor((angle + F.pi()) / (2 * F.pi()) * sectors), F.lit(sectors - 1)).cast("int")
    per = about.groupBy(*keys, sector.alias("sector")).agg(F.sum("value").alias("m"))
    sums = per.groupBy(*keys).agg(F.sum("m").alias("t"), F.sum(F.col("m") * F.col("m")).alias("q"))
    # sectors without mass count as zeros
    mean = F.col("t") / sectors
    variance = F.col("q") / sectors - mean * mean
    most = F.col("t") * F.col("t") / sectors - mean * mean
    return sums.select(*keys, F.when(most > 0, clip(variance / most, 0.0, CLIP)).otherwise(0.0).alias("rotational_symmetry"))


def coarse_entropy(field: DataFrame, size: int, *keys: str, block: int = BLOCK) -> DataFrame:
    """Entropy of mass over block x block coarse bins, as a share of its maximum; 0 without mass.

    The field is cropped to a multiple of ``block``.
    """
    edge = size - size % block
    step = edge // block
    if step == 0:
        return field.select(*keys).distinct().withColumn("spatial_entropy", F.lit(0.0))
    inside = (F.col("y") < edge) & (F.col("x") < edge)
    bins = field.where(inside).groupBy(*keys, F.floor(F.col("y") / step).alias("by"), F.floor(F.col("x") / step).alias("bx")).agg(F.sum("value").alias("m")).where("m > 0")
    # sum of -p ln p = ln t - sum(m ln m) / t: one aggregation, no second look at the total
    sums = bins.groupBy(*keys).agg(F.sum("m").alias("t"), F.sum(F.col("m") * F.log("m")).alias("s"))
    found = sums.select(*keys, clip((F.log("t") - F.col("s") / F.col("t")) / float(np.log(block * block)), 0.0, CLIP).alias("spatial_entropy"))
    return field.select(*keys).distinct().join(found, list(keys), "left").select(*keys, F.coalesce("spatial_entropy", F.lit(0.0)).alias("spatial_entropy"))


def dense(field: DataFrame, size: int, *keys: str) -> DataFrame:
    """All size x size cells of each entity, zeros filled in."""
    side = F.sequence(F.lit(0), F.lit(size - 1))
    grid = field.select(*keys).distinct().withColumn("y", F.explode(side)).withColumn("x", F.explode(side))
    return grid.join(field, [*keys, "y", "x"], "left").select(*keys, "y", "x", F.coalesce("value", F.lit(0.0)).alias("value"))


def growth_gradient(field: DataFrame, size: int, *keys: str) -> DataFrame:
    """Mass-weighted mean length of the gradient: central differences, one-sided at the edges."""
    full = dense(field, size, *keys)

    def slope(along: str, across: str) -> F.Column:
        w = Window.partitionBy(*keys, across).orderBy(along)
        before, after = F.lag("value").over(w), F.lead("value").over(w)
        return F.when(before.isNull(), after - F.col("value")).when(after.isNull(), F.col("value") - before).otherwise((after - before) / 2)

    sloped = full.withColumn("gy", slope("y", "x")).withColumn("gx", slope("x", "y"))
    length = F.sqrt(F.col("gy") * F.col("gy") + F.col("gx") * F.col("gx"))
    sums = sloped.groupBy(*keys).agg(F.sum("value").alias("t"), F.sum(F.col("value") * length).alias("g"))
    return sums.select(*keys, F.when(F.col("t") > 0, clip(F.col("g") / F.col("t"), 0.0, CLIP)).otherwise(0.0).alias("growth_gradient"))


def signal_statistics(signal: DataFrame, cells: int, initial: float, *keys: str) -> DataFrame:
    """(keys, signal_field_variance, signal_mass_ratio, dominant_channel, dominant_channel_fraction) of (keys, channel, y, x, value)."""
    per_cell = signal.groupBy(*keys, "y", "x").agg(F.sum("value").alias("v")).groupBy(*keys).agg(F.sum("v").alias("t"), F.sum(F.col("v") * F.col("v")).alias("q"))
    channel = signal.groupBy(*keys, "channel").agg(F.sum("value").alias("m"))
    top = channel.groupBy(*keys).agg(F.max("m").alias("top"), F.max_by("channel", F.struct(F.col("m"), -F.col("channel"))).alias("dominant_channel"), F.count("*").alias("channels"))
    mean = F.col("t") / cells
    return per_cell.join(top, list(keys)).select(*keys, (F.col("q") / cells - mean * mean).alias("signal_field_variance"), (clip(F.col("t") / initial, 0.0, CLIP) if initial > 0 else F.lit(0.0)).alias("signal_mass_ratio"), "dominant_channel", F.when(F.col("t") > 0, F.col("top") / F.col("t")).otherwise(1.0 / F.col("channels")).alias("dominant_channel_fraction"))


def grids(group: pa.Table, size: int) -> np.ndarray:
    out = np.zeros((size, size), np.float64)
    np.add.at(out, (group["y"].to_numpy(), group["x"].to_numpy()), group["value"].to_numpy())
    return out


def radial_entropy(field: np.ndarray, bins: int = 32) -> float:
    """Entropy of the radially binned magnitude spectrum without its mean, as a share of ln(bins)."""
    h, w = field.shape
    power = np.abs(np.fft.fftshift(np.fft.fft2(field)))
    power[h // 2, w // 2] = 0.0
    y, x = np.indices((h, w))
    radius = np.hypot(y - h // 2, x - w // 2)
    which = np.minimum((radius / radius.max() * bins).astype(int), bins - 1)
    mass = np.bincount(which.ravel(), weights=power.ravel(), minlength=bins)
    if mass.sum() <= 1e-12:
        return 0.0
    p = mass[mass > 0] / mass.sum()
    return float(-(p * np.log(p)).sum() / np.log(bins))


def compressibility(field: np.ndarray) -> float:
    """Size of the zlib-compressed 8-bit image of the field over its raw size."""
    peak = field.max()
    if peak <= 0:
        return 0.0
    raw = (np.clip(field / peak, 0, 1) * 255).astype(np.uint8).tobytes()
    return len(zlib.compress(raw, 6)) / len(raw)


def transforms(field: DataFrame, size: int, *keys: str) -> DataFrame:
    """(keys, spectral_entropy, png_compressibility): what needs the whole grid of an entity, one at a time."""
    ship(field.sparkSession)
    kinds = ", ".join(f"{k} {field.schema[k].dataType.simpleString()}" for k in keys)

    def whole(group: pa.Table) -> pa.Table:
        grid = grids(group, size)
        row = {k: group[k][:1].combine_chunks() for k in keys}
        return pa.table(row | {"spectral_entropy": [radial_entropy(grid)], "png_compressibility": [compressibility(grid)]})

    return field.select(*keys, "y", "x", F.col("value").cast("double")).groupBy(*keys).applyInArrow(whole, f"{kinds}, spectral_entropy double, png_compressibility double")


def compress_column(df: DataFrame, column: str, key: str) -> DataFrame:
    """(key, n_bytes, n_compressed) of a text or binary column, by zlib in Arrow batches."""
    ship(df.sparkSession)

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [x or b"" for x in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([len(zlib.compress(x, 6)) for x in raw], pa.int64())], names=[key, "n_bytes", "n_compressed"])

    return df.select(key, column).mapInArrow(sizes, f"{key} {df.schema[key].dataType.simpleString()}, n_bytes long, n_compressed long")
