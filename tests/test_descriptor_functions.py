"""User descriptors that are functions of a trace, beside aggregates."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import descriptors as D
from tessella.operators import series


@pytest.fixture
def registry(monkeypatch):
    monkeypatch.setattr(series, "REGISTRY", {})


def traces(spark):
    rows = [(c, s, float((c or 0) * s), 1.0 - s, 0.1 * s, float(s % 3)) for c in (1, 2, None) for s in range(12)]
    return spark.createDataFrame(rows[::-1], "seed long, step int, com_y double, com_x double, bbox double, gyradius double").repartition(3)


MODULE = """
import numpy as np
from pyspark.sql import functions as F

SCALE = 2.0


def zigzag(trace):
    # turns of the radius, in the order of the steps
    return SCALE * np.sum(np.diff(np.sign(np.diff(trace["gyradius"]))) != 0)


DESCRIPTORS = [("zigzag", zigzag), ("wide", F.max("bbox"))]
"""


def test_functions_of_a_module(spark, registry, tmp_path):
    (tmp_path / "mine.py").write_text(MODULE)
    assert D.load_module(str(tmp_path / "mine.py")) == ["zigzag", "wide"]
    r = np.array([s % 3 for s in range(12)], float)
    turns = 2.0 * np.sum(np.diff(np.sign(np.diff(r))) != 0)
    got = {x["seed"]: (x["zigzag"], round(x["wide"], 6)) for x in series.user_descriptors(traces(spark), 50, "seed").collect()}
    assert got == {1: (turns, 1.1), 2: (turns, 1.1), None: (turns, 1.1)}


def test_values_are_clipped_and_finite(spark, registry):
    series.register("huge", lambda t: 1e9 * len(t["step"]))
    series.register("odd", lambda t: float("nan"))
    series.register("last", lambda t: t["com_y"][-1])
    got = {x["seed"]: (x["huge"], x["odd"], x["last"]) for x in series.user_descriptors(traces(spark), 50, "seed").where("seed is not null").collect()}
    assert got == {1: (100.0, 0.0, 11.0), 2: (100.0, 0.0, 22.0)}
    assert series.user_descriptors(traces(spark).limit(0), 50, "seed").count() == 0
    for bad in (("", F.max("bbox")), ("x", 3)):
        with pytest.raises(TypeError):
            series.register(*bad)
