"""Nearest centroids by the grid against a scan of all."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import calibration as C


def rows(rng, n, spread):
    inf, nan = float("inf"), float("nan")
    out = [(i, *(spread(rng) for _ in range(3))) for i in range(n)]
    return out + [(n, None, 1.0, 1.0), (n + 1, nan, 1.0, 1.0), (n + 2, inf, 0.0, 0.0), (n + 3, 1e6, -1e6, 0.0), (n + 4, None, None, None)]


SPREADS = {"even": lambda r: r.uniform(0, 10), "lattice": lambda r: float(r.randrange(8)), "clusters": lambda r: r.choice([0.0, 5.0, 1000.0]) + r.gauss(0, 0.01), "flat": lambda r: r.choice([1.0, 1.0, r.random()])}


@pytest.mark.parametrize("kind", SPREADS)
@pytest.mark.parametrize("block", [10**6, 70])
def test_grid_equals_scan(spark, monkeypatch, kind, block):
    rng = random.Random(len(kind))
    monkeypatch.setattr(C, "BLOCK", block)
    centres = [(i * 3, *(SPREADS[kind](rng) for _ in range(3))) for i in range(150)]
    points = rows(rng, 300, SPREADS[kind])
    df = spark.createDataFrame(points, "id long, d0 double, d1 double, d2 double").repartition(4)
    cdf = spark.createDataFrame(centres, "idx long, c0 double, c1 double, c2 double")
    got = {r["id"]: r["cell"] for r in C.nearest(df, cdf, scanned=0).collect()}
    scan = {r["id"]: r["cell"] for r in C.nearest(df, cdf, scanned=10**9).collect()}
    assert got == scan
    for i, *p in points[:300]:
        assert got[i] == min(centres, key=lambda c: (sum((a - b) ** 2 for a, b in zip(p, c[1:])), c[0]))[0]


def test_work_of_a_row_does_not_follow_the_centroids(spark):
    """Eight times the centroids, about as many to look at."""
    rng, looked = random.Random(1), []
    points = spark.createDataFrame([tuple(rng.random() for _ in range(3)) for _ in range(300)], "d0 double, d1 double, d2 double")
    for k in (512, 4096):
        cdf = spark.createDataFrame([(i, *(rng.random() for _ in range(3))) for i in range(k)], "idx long, c0 double, c1 double, c2 double")
        ends = C.bounds(points, cdf, C.AXES, ("c0", "c1", "c2"))
        packed = C.grid(cdf.agg(F.array_sort(F.collect_list(F.struct(F.col("idx").alias("i"), *[F.col(f"c{j}").alias(f"v{j}") for j in range(3)]))).alias("_cells")), ends)
        near = F.get("_grid", C.cell_number([F.col(a) for a in C.AXES], ends))
        looked.append(points.crossJoin(F.broadcast(packed)).agg(F.avg(F.size(near)).alias("n")).first()["n"])
        assert math.prod(n for *_, n in ends) <= 2 * k
    assert looked[1] < 1.6 * looked[0] < 512
