import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import calibration as C
from tessella.operators import percentiles as P

SHARES = [0.0, 0.05, 0.333, 0.5, 0.95, 1.0]


def wanted(values, share):
    v = sorted((x + 0.0 for x in values if x is not None), key=lambda x: (math.isnan(x), x))
    at = share * (len(v) - 1)
    lo, hi = math.floor(at), math.ceil(at)
    return v[lo] if lo == hi else (hi - at) * v[lo] + (at - lo) * v[hi]


@pytest.mark.parametrize("bins", [4, 64, 4096])
def test_equals_sorting(spark, bins):
    rng = random.Random(bins)
    inf, nan = float("inf"), float("nan")
    groups = {
        1: [rng.gauss(0, 1) for _ in range(700)],
        2: [rng.choice([1.5, 1.5, 2.0]) for _ in range(300)],
        3: [2.0 ** rng.randrange(-1074, 1023) * rng.choice([-1, 1]) for _ in range(300)],
        4: [None, 4.0],
        5: [None, None],
        6: [-inf, inf, nan, 1.0, -1e308, 1e308, 5e-324, 0.0, -0.0, *[inf] * 9, *[nan] * 9, *range(30)],
        None: [3.0, 1.0, 2.0],
    }
    rows = [(g, float(v) if v is not None else None, float(i)) for g, vs in groups.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g int, x double, y double").repartition(5)
    got = {(r["g"], r["axis"], r["share"]): r["value"] for r in P.percentiles(df, ["x", "y"], SHARES, "g", bins=bins).collect()}
    want = {(g, axis, s): wanted(vs, s) for g, xs in groups.items() for axis, vs in ((0, xs), (1, [float(i) for i in range(len(xs))])) for s in SHARES if any(v is not None for v in vs)}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == v or math.isnan(v) and math.isnan(got[k]) or math.isclose(got[k], v, rel_tol=1e-12), (k, v, got[k])


def test_no_buffer_beyond_the_bins(spark, monkeypatch):
    """10**6 different values: what is gathered, and each histogram, stays within the bins."""
    seen, plain = [], P.stage

    def watch(df, name):
        out = plain(df, name)
        if name == "intervals":
            seen.append(out.agg(F.max("m").alias("m")).first()["m"])
        return out

    monkeypatch.setattr(P, "stage", watch)
    rows = spark.range(10**6).select((F.xxhash64("id") / F.lit(2.0**63)).alias("x"))
    got = [r["value"] for r in P.percentiles(rows, ["x"], [0.05, 0.5], bins=256).orderBy("share").collect()]
    assert np.allclose(got, np.percentile([r["x"] for r in rows.collect()], [5, 50]), rtol=1e-12)
    assert seen[0] == 10**6 and seen[-1] <= 256 and len(seen) <= 4


def test_scales_of_runs_and_of_nothing(spark):
    rows = [(1, float(i), 2.0, None) for i in range(101)]
    got = {(r["run"], r["axis"]): (r["p5"], r["p95"], r["scale"]) for r in C.axis_scale(spark.createDataFrame(rows, "run int, d0 double, d1 double, d2 double"), "run").collect()}
    assert got == {(1, 0): (5.0, 95.0, 1 / 90), (1, 1): (2.0, 2.0, 1.0), (1, 2): (None, None, 1.0)}
    none = C.axis_scale(spark.createDataFrame([], "d0 double, d1 double, d2 double")).collect()
    assert [(r["axis"], r["p5"], r["scale"]) for r in none] == [(0, None, 1.0), (1, None, 1.0), (2, None, 1.0)]
