"""Patches by tiles against labels of the whole grid."""

import numpy as np
import pytest

from tessella.operators import ownership as O


def wanted(grid):
    sizes = sorted(np.bincount(O.labelled(grid).ravel())[1:].tolist(), reverse=True)
    return len(sizes), sizes


@pytest.mark.parametrize("size, tile", [(40, 8), (37, 10), (16, 512), (9, 1)])
def test_tiles_equal_the_whole_grid(spark, size, tile):
    rng = np.random.default_rng(size)
    grids = {("a", 1): rng.random((size, size)) < 0.6, ("a", 2): np.zeros((size, size), bool), (None, 1): rng.random((size, size)) < 0.4, ("c", 1): np.ones((size, size), bool)}
    spiral = np.zeros((size, size), bool)  # a snake over all tiles
    spiral[::2] = True
    spiral[1::4, -1] = spiral[3::4, 0] = True
    grids["snake", 1] = spiral
    rows = [(s, snap, y, x, 0.9 if g[y, x] else 0.1) for (s, snap), g in grids.items() for y in range(size) for x in range(size) if g[y, x] or (y + x) % 3 == 0]
    df = spark.createDataFrame(rows, "species string, snap int, y int, x int, w double").repartition(4)
    got = {(r["species"], r["snap"]): (r["patch_count"], r["patch_sizes"]) for r in O.patches(df, size, "snap", tile=tile).collect()}
    assert got == {k: wanted(g) for k, g in grids.items()}


def test_no_cells(spark):
    none = spark.createDataFrame([], "species string, snap int, y int, x int, w double")
    assert O.patches(none, 40, "snap", tile=8).count() == 0 and O.patches(none, 8, "snap").count() == 0
