"""Where creatures start: spaced random points, a jittered grid where there is no room."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.session import ship

TRIES = 30


def spaced_points(n: int, low: float, high: float, gap: float, rng: np.random.Generator) -> np.ndarray:
    """Up to n points of the square [low, high)^2, no two closer than ``gap``.

    Dart throwing round a random active point, all tries of a point at once,
    against all points so far (there are few): no neighbour grid is needed.
    """
    if low >= high or n < 1:
        return np.empty((0, 2))
    points = [rng.uniform(low, high, 2)]
    active = [0]
    while active and len(points) < n:
        k = int(rng.integers(len(active)))
        angle, reach = rng.uniform(0, 2 * np.pi, TRIES), rng.uniform(gap, 2 * gap, TRIES)
        tries = points[active[k]] + reach[:, None] * np.stack([np.sin(angle), np.cos(angle)], axis=1)
        inside = ((tries >= low) & (tries < high)).all(axis=1)
        free = inside & ((((tries[:, None] - np.array(points)[None]) ** 2).sum(axis=2)) >= gap * gap).all(axis=1)
        if free.any():
            points.append(tries[int(np.argmax(free))])
            active.append(len(points) - 1)
        else:
            active.pop(k)
    return np.array(points)


def jittered(n: int, low: float, high: float, rng: np.random.Generator) -> np.ndarray:
    """Exactly n points, one in each cell of the smallest near-square grid."""
    cols = math.ceil(math.sqrt(n))
    rows = math.ceil(n / cols)
    cell = np.arange(n)
    place = np.stack([(cell // cols + rng.random(n)) / rows, (cell % cols + rng.random(n)) / cols], axis=1)
    return np.clip(np.rint(low + place * (high - low)), low, high - 1)


def positions(n: int, height: int, width: int, *, gap: float, patch: int, seed: int) -> np.ndarray:
    """n integer centres (y, x), clear of the border by a patch and two cells."""
    rng = np.random.default_rng(seed)
    side, margin = min(height, width), patch + 2
    found = spaced_points(n, margin, side - margin, gap, rng)
    found = np.rint(found) if len(found) >= n else jittered(n, margin, max(side - margin, margin + 1), rng)
    return (found[:n] * np.array([height / side, width / side])).astype(int)


def spawn_table(experiments: DataFrame) -> DataFrame:
    """(name, number, y, x, species) for experiments (name, grid_h, grid_w, min_dist, patch, seed, counts).

    ``counts`` has the creatures of each species; positions go to species in order.
    """
    ship(experiments.sparkSession)

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        r = pdf.iloc[0]
        n = int(sum(r["counts"]))
        at = positions(n, int(r["grid_h"]), int(r["grid_w"]), gap=float(r["min_dist"]), patch=int(r["patch"]), seed=int(r["seed"]))
        return pd.DataFrame({"name": r["name"], "number": np.arange(n), "y": at[:, 0], "x": at[:, 1]})

    placed = experiments.groupBy("name").applyInPandas(place, "name string, number long, y long, x long")
    bounds = experiments.select("name", F.posexplode("counts").alias("species", "n"), "counts")
    bounds = bounds.withColumn("lo", F.aggregate(F.slice("counts", F.lit(1), F.col("species")), F.lit(0).cast("long"), lambda a, v: a + v.cast("long"))).withColumn("hi", F.col("lo") + F.col("n"))
    return placed.join(bounds.select("name", "species", "lo", "hi"), "name").where((F.col("number") >= F.col("lo")) & (F.col("number") < F.col("hi"))).select("name", "number", "y", "x", "species")
