"""Species on a grid: territory, contact, patches, interaction, outcome labels.

Long tables: ownership(run, snap, y, x, species, w), growth in a column g, mass
in a column m where there is one. ``keys`` are the columns before species.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators import ranges
from tessella.operators.components import components
from tessella.operators.percentiles import matched
from tessella.session import ship
from tessella.sources.tables import stage

#: Fixed thresholds: ownership that counts as presence in a cell, as being there or
#: away for interaction, as having an owner at all, and as receiving a signal.
MASK, PRESENT, ABSENT, OWNED, RECEIVING = 0.2, 0.3, 0.05, 0.1, 0.1
HOMO_SHARE = 0.01
#: Cells of a side of a tile that is labelled in one task.
TILE = 512


def territory(ownership: DataFrame, *keys: str) -> DataFrame:
    """Area and, with a column m, mass of each species."""
    mass = [F.sum(F.col("m") * F.col("w")).alias("mass")] if "m" in ownership.columns else []
    return ownership.groupBy(*keys, "species").agg(F.sum("w").alias("territory"), *mass)


def mass_summary(history: DataFrame, *keys: str) -> DataFrame:
    """Initial, final, peak and least mass, and turnover = mean absolute step change over the initial mass, of (keys, step, mass)."""
    change = F.abs(F.col("mass") - F.lag("mass").over(Window.partitionBy(*keys).orderBy("step")))
    rows = history.withColumn("change", change)
    return rows.groupBy(*keys).agg(F.min_by("mass", "step").alias("initial_mass"), F.max_by("mass", "step").alias("final_mass"), F.max("mass").alias("peak_mass"), F.min("mass").alias("min_mass"), F.avg("change").alias("mean_change")).withColumn("turnover", F.when(F.col("initial_mass") > 0, F.coalesce("mean_change", F.lit(0.0)) / F.col("initial_mass")).otherwise(0.0)).drop("mean_change")


def centres(ownership: DataFrame, *keys: str) -> DataFrame:
    w = F.col("w")
    s = ownership.groupBy(*keys, "species").agg(F.sum(w).alias("t"), F.sum(w * F.col("y")).alias("sy"), F.sum(w * F.col("x")).alias("sx"))
    return s.select(*keys, "species", F.when(F.col("t") > 0, F.col("sy") / F.col("t")).alias("com_y"), F.when(F.col("t") > 0, F.col("sx") / F.col("t")).alias("com_x"))


def pairs_of(rows: DataFrame, keys: tuple[str, ...], *columns: str) -> DataFrame:
    """Ordered pairs a <> b of the species of one place; species are few, so a self equi-join."""
    a = rows.select(*keys, F.col("species").alias("a"), *[F.col(c).alias(f"{c}_a") for c in columns])
    b = rows.select(*keys, F.col("species").alias("b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    return a.join(b, list(keys)).where("a <> b")


def com_distance(ownership: DataFrame, *keys: str) -> DataFrame:
    """Distance of each ordered pair of species; null where one is absent."""
    p = pairs_of(centres(ownership, *keys), keys, "com_y", "com_x")
    return p.select(*keys, "a", "b", F.hypot(F.col("com_y_a") - F.col("com_y_b"), F.col("com_x_a") - F.col("com_x_b")).alias("distance"))


def interface_area(ownership: DataFrame, *keys: str, mask: float = MASK) -> DataFrame:
    """Cells in which both species of an ordered pair exceed the mask; 0 for pairs without."""
    there = ownership.where(F.col("w") > mask).select(*keys, "y", "x", "species")
    shared = pairs_of(there, (*keys, "y", "x")).groupBy(*keys, "a", "b").agg(F.count("*").alias("cells"))
    every = pairs_of(ownership.select(*keys, "species").distinct(), keys)
    return every.join(shared, [*keys, "a", "b"], "left").select(*keys, "a", "b", F.coalesce("cells", F.lit(0)).cast("long").alias("interface_area"))


def contact(ownership: DataFrame, snap: str, *keys: str, mask: float = MASK) -> DataFrame:
    """Whether a pair ever touches."""
    area = interface_area(ownership, *keys, snap, mask=mask)
    return area.groupBy(*keys, "a", "b").agg(F.bool_or(F.col("interface_area") > 0).alias("contact"))


def ownership_entropy(ownership: DataFrame, *keys: str, owned: float = OWNED) -> DataFrame:
    """Mean entropy of the species' shares over owned cells, as a share of the log of the number of species."""
    cell = ownership.groupBy(*keys, "y", "x").agg(F.sum("w").alias("t"), F.sum(F.when(F.col("w") > 0, F.col("w") * F.log("w")).otherwise(0.0)).alias("s")).where(F.col("t") > owned)
    each = cell.select(*keys, (F.log("t") - F.col("s") / F.col("t")).alias("h"))
    species = ownership.groupBy(*keys).agg(F.countDistinct("species").alias("n"))
    mean = each.groupBy(*keys).agg(F.avg("h").alias("h"))
    return species.join(mean, list(keys), "left").select(*keys, F.when(F.col("n") > 1, F.coalesce("h", F.lit(0.0)) / F.log("n")).otherwise(0.0).alias("ownership_entropy"))


def labelled(mask: np.ndarray) -> np.ndarray:
    """4-connected components of a boolean grid, numbered from 1, by runs joined row to row."""
    h, w = mask.shape
    padded = np.zeros((h, w + 2), bool)
    padded[:, 1:-1] = mask
    edge = np.diff(padded.astype(np.int8), axis=1)
    row, start = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    up = np.arange(len(row))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    first = np.searchsorted(row, np.arange(h + 1))
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if start[i] < stop[j] and start[j] < stop[i]:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
            if stop[i] < stop[j]:
                i += 1
            else:
                j += 1
    roots = np.array([root(i) for i in range(len(row))], int)
    names = np.unique(roots, return_inverse=True)[1] + 1 if len(roots) else roots
    out = np.zeros((h, w), int)
    for y, a, b, n in zip(row, start, stop, names, strict=True):
        out[y, a:b] = n
    return out


def patches(ownership: DataFrame, size: int, *keys: str, mask: float | None = MASK, tile: int = TILE) -> DataFrame:
    """(keys, species, patch_count, patch_sizes) of cells above the mask; sizes descend.

    A grid is cut into tiles of ``tile`` x ``tile`` cells that are labelled apart, a
    task a tile. Labels that touch across the edges of tiles are joined, and their
    connected groups are the patches. A grid of one tile needs no joining.
    """
    ship(ownership.sparkSession)
    names = [*keys, "species"]
    kinds = ", ".join(f"{k} {ownership.schema[k].dataType.simpleString()}" for k in names)
    side = min(size, tile)
    across = -(-size // side)
    at = (F.floor(F.col("y") / side) * across + F.floor(F.col("x") / side)).cast("long")
    cells = ownership.select(*names, at.alias("tile"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.col("w").cast("double").alias("w"))

    def label(group: pa.Table) -> pa.Table:
        """A row for each patch of a tile, with its cells, and for each of its cells at the edge of the tile."""
        number = group["tile"][0].as_py()
        top, left = number // across * side, number % across * side
        grid = np.zeros((side, side), bool)
        lit = group["w"].to_numpy() > (mask or 0.0)
        grid[group["y"].to_numpy()[lit] - top, group["x"].to_numpy()[lit] - left] = True
        found = labelled(grid)
        sizes = np.bincount(found.ravel())[1:]
        y, x = np.nonzero(found)
        if across > 1:
            edge = (y == 0) | (x == 0) | (y == side - 1) | (x == side - 1)
            y, x = y[edge], x[edge]
        else:
            y, x = y[:0], x[:0]
        n, k = len(sizes), len(y)
        part = number * (side * side + 1) + np.r_[np.arange(1, n + 1), found[y, x]]
        gone = lambda count: pa.nulls(count, pa.int64())
        return pa.table({c: pa.concat_arrays([group[c][:1].combine_chunks()] * (n + k)) if n + k else group[c][:0].combine_chunks() for c in names} | {"part": pa.array(part, pa.int64()), "cells": pa.concat_arrays([pa.array(sizes, pa.int64()), gone(k)]), "y": pa.concat_arrays([gone(n), pa.array(top + y, pa.int64())]), "x": pa.concat_arrays([gone(n), pa.array(left + x, pa.int64())])})

    found = cells.groupBy(*names, "tile").applyInArrow(label, f"{kinds}, part long, cells long, y long, x long")
    if across > 1:
        found = stage(found, "tiles")
        edge = found.where("cells is null").select(*names, "part", "y", "x")
        steps = F.explode(F.array(F.struct(F.col("y"), (F.col("x") + 1).alias("x")), F.struct((F.col("y") + 1).alias("y"), F.col("x"))))
        beside = edge.select(*names, F.col("part").alias("other"), steps.alias("s")).select(*names, "other", "s.*")
        touching = matched(edge, beside, [*names, "y", "x"], F.expr("part <> other")).select(*names, "part", "other").distinct()
        whole = components(touching, "part", "other", *names)
        found = matched(found.where("cells is not null").drop("y", "x"), whole, [*names, "part"], how="left").groupBy(*names, F.coalesce("label", "part").alias("part")).agg(F.sum("cells").alias("cells"))
    counts = found.where("cells is not null").groupBy(*names).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("cells"), False).alias("sizes"))
    every = ownership.select(*names).distinct()
    return matched(every, counts, names, how="left").select(*names, F.coalesce("n", F.lit(0)).cast("long").alias("patch_count"), F.coalesce("sizes", F.array().cast("array<bigint>")).alias("patch_sizes"))


def homo_mask(mass: DataFrame, *keys: str) -> DataFrame:
    """mass (keys, snap, y, x, m) with w = m where it exceeds HOMO_SHARE of the run's peak, else 0."""
    peak = mass.groupBy(*keys).agg(F.max("m").alias("_peak"))
    joined = mass.join(peak, list(keys)) if keys else mass.crossJoin(F.broadcast(peak))
    return joined.withColumn("w", F.when(F.col("m") > HOMO_SHARE * F.col("_peak"), F.col("m")).otherwise(0.0)).drop("_peak")


def interaction(ownership: DataFrame, snap: str, *keys: str, present: float = PRESENT, absent: float = ABSENT, gate: bool = False, mask: float = MASK) -> DataFrame:
    """Mean growth of a where b is present less its mean where b is absent; null if either never occurs.

    With ``gate``, snapshots in which a pair does not touch are left out (a
    species with itself always counts).
    """
    place = (*keys, snap, "y", "x")
    a = ownership.select(*place, F.col("species").alias("a"), "g")
    b = ownership.select(*place, F.col("species").alias("b"), "w")
    both = a.join(b, list(place))
    if gate:
        touch = interface_area(ownership, *keys, snap, mask=mask).where("interface_area > 0").select(*keys, snap, "a", "b")
        self_pairs = ownership.select(*keys, snap, F.col("species").alias("a"), F.col("species").alias("b")).distinct()
        both = both.join(touch.unionByName(self_pairs), [*keys, snap, "a", "b"], "left_semi")
    here, away = F.avg(F.when(F.col("w") > present, F.col("g"))), F.avg(F.when(F.col("w") < absent, F.col("g")))
    return both.groupBy(*keys, "a", "b").agg((here - away).alias("coefficient"))


def signal_received(signal: DataFrame, ownership: DataFrame, *keys: str) -> DataFrame:
    """Mean of each signal channel over the cells that a species holds; 0 where it holds none."""
    held = ownership.where(F.col("w") > RECEIVING).select(*keys, "y", "x", "species")
    mean = signal.join(held, [*keys, "y", "x"]).groupBy(*keys, "species", "channel").agg(F.avg("value").alias("received"))
    every = ownership.select(*keys, "species").distinct().join(signal.select(*keys, "channel").distinct(), list(keys))
    return every.join(mean, [*keys, "species", "channel"], "left").select(*keys, "species", "channel", F.coalesce("received", F.lit(0.0)).alias("received"))


# --- outcomes ---------------------------------------------------------------------------------

EXCLUSION, MERGER, FRAGMENTATION, COEXISTENCE = "exclusion", "merger", "fragmentation", "coexistence"
PRIORITY = (EXCLUSION, MERGER, FRAGMENTATION, COEXISTENCE)
FULL_MERGER, CANNIBALISM, PARTIAL, STABLE = "full_merger", "cannibalism", "partial_clustering", "stable_isolation"
HOMO_PRIORITY = (FULL_MERGER, CANNIBALISM, FRAGMENTATION, PARTIAL, STABLE)


def hetero_label(territory_now: Column, territory_first: Column, entropy: Column, patch_count: Column, *, excluded: float = 0.05, merged: float = 0.85) -> Column:
    """Label of a species in a snapshot: nearly gone, else mixed ownership, else in several patches."""
    gone = (territory_first > 0) & (territory_now / F.nullif(territory_first, F.lit(0.0)) < excluded)
    return F.when(gone, EXCLUSION).when(entropy >= merged, MERGER).when(patch_count > 1, FRAGMENTATION).otherwise(COEXISTENCE)


def homo_label(count: Column, first_count: Column, largest: Column, first_median: Column) -> Column:
    return F.when(count == 1, FULL_MERGER).when(count > first_count, FRAGMENTATION).when((count < first_count) & (largest > 1.5 * first_median), CANNIBALISM).when(count < first_count, PARTIAL).otherwise(STABLE)


def debounced(labels: DataFrame, debounce: int, *keys: str, step: str = "step", label: str = "label") -> DataFrame:
    """labels with smooth: a label takes over at its ``debounce``-th consecutive row; the first holds at once."""
    by = Window.partitionBy(*keys).orderBy(step)
    changed = F.coalesce((F.col(label) != F.lag(label).over(by)).cast("int"), F.lit(1))
    runs = labels.withColumn("_run", F.sum(changed).over(by))
    place = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(step))
    marked = runs.withColumn("_place", place).withColumn("_commit", F.when((F.col("_place") >= debounce) | (F.col("_run") == 1), F.col(label)))
    return marked.withColumn("smooth", F.last("_commit", ignorenulls=True).over(by)).drop("_run", "_place", "_commit")


def windows(labels: DataFrame, *keys: str, step: str = "step", label: str = "smooth") -> DataFrame:
    """(keys, label, from_step, to_step) of maximal runs of one label."""
    by = Window.partitionBy(*keys).orderBy(step)
    changed = F.coalesce((F.col(label) != F.lag(label).over(by)).cast("int"), F.lit(1))
    runs = labels.withColumn("_run", F.sum(changed).over(by))
    return runs.groupBy(*keys, "_run").agg(F.first(label).alias("label"), F.min(step).alias("from_step"), F.max(step).alias("to_step")).drop("_run")


def final_label(found: DataFrame, *keys: str, priority: tuple[str, ...] = PRIORITY, species: str = "species") -> DataFrame:
    """Of the last windows of a run's species, the label of highest priority."""
    last = found.groupBy(*keys, species).agg(F.max_by("label", "to_step").alias("label"))
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("label"))
    return last.groupBy(*keys).agg(F.min_by("label", rank).alias("final_label"))


def as_of(steps: DataFrame, history: DataFrame, value: str, *keys: str) -> DataFrame:
    """Each (keys, step) with the last ``value`` of history at or before it; of one step's, the greatest."""
    known = history.where(F.col(value).isNotNull()).select(*keys, F.col("step").alias("_from"), value)
    return ranges.as_of(steps.select(*keys, "step"), known, "step", "_from", *keys)
