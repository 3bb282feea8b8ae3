import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import pair_blocks, pairs

SCHEMA = "id long, run long, emission array<double>, receptor array<double>, d array<double>, quality double"


def made(spark, n, *, odd=False, copies=0, step=None):
    """Creatures with repeated vectors and ids; products meet the threshold exactly when there is a step."""
    rng = np.random.default_rng(n)
    e, r, d = np.abs(rng.normal(0, 0.2, (n, 16))), rng.normal(0, 0.2, (n, 16)), rng.normal(0, 0.3, (n, 3))
    if step:
        e, r = np.round(e / step) * step, np.round(r / step) * step
    e[:copies], r[:copies], d[:copies] = e[0], r[0], d[0]
    rows = [[int(i), int(i % 4), e[i].tolist(), r[i].tolist(), d[i].tolist(), 0.5 if i < copies else float(rng.random())] for i in range(n)]
    if odd:
        rows[3][2] = rows[3][3] = rows[3][4] = None
        rows[4][2] = rows[4][2][:9]
        rows[5][3][2] = math.nan
        rows[6][0] = rows[7][0]
        rows[8][1] = None
        rows[9][5] = None
        rows[10][0] = None
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def listed(df):
    return sorted([tuple("nan" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in df.collect()], key=str)


@pytest.mark.parametrize("shape", [{"n": 700}, {"n": 300, "odd": True}, {"n": 400, "copies": 200}, {"n": 300, "step": 0.1}])
def test_blocks_give_what_all_pairs_give(spark, monkeypatch, shape):
    monkeypatch.setattr(pair_blocks, "ROWS", 90)
    c = made(spark, **shape).cache()
    every = pairs.scored_pairs(c).cache()
    assert listed(pairs.mode_counts(c)) == listed(every.groupBy("mode").agg(F.count("*").alias("n")))
    names = ["mode", "rank", "id_a", "id_b", "ab", "ba", "distance", "avg_quality", "score"]
    assert listed(pairs.best_pairs(c, 5).select(names)) == listed(pairs.top_pairs(every, 5).select(names))
    good = pairs.top_pairs(pairs.scored_pairs(c, min_quality=0.5), 3)
    assert listed(pairs.best_pairs(c, 3, min_quality=0.5).select(names)) == listed(good.select(names))
    crossed = pairs.scored_pairs(c, cross="run").groupBy(F.least("run_a", "run_b").alias("lo"), F.greatest("run_a", "run_b").alias("hi")).agg(F.count("*").alias("n"), F.max("score").alias("best"))
    assert listed(pairs.cross_pairs(c, "run")) == listed(crossed)


def test_pairs_of_blocks_need_no_row_a_pair(spark, monkeypatch):
    """All pairs of 3,000 creatures go as a few rows of blocks: each two blocks once, a task's rows alike."""
    monkeypatch.setattr(pair_blocks, "ROWS", 500)
    at = pairs.block_pairs(made(spark, 3000)).select("block_a", "block_b").collect()
    assert len(at) == 21 == len({frozenset(r) for r in at})


def test_names_may_be_ids(spark):
    c = made(spark, 120).withColumn("id", F.concat(F.lit("c-"), F.col("id").cast("string")))
    names = ["mode", "rank", "id_a", "id_b"]
    assert listed(pairs.best_pairs(c, 4).select(names)) == listed(pairs.top_pairs(pairs.scored_pairs(c), 4).select(names))


def test_nulls_among_components_are_left_out_as_in_sql(spark):
    rows = [(1, 0, [1.0, None], [0.5, 2.0], [0.0, None, 1.0], 0.5), (2, 1, [None, 3.0], [0.25, None], [1.0, 5.0, None], 0.5)]
    found = pairs.best_pairs(spark.createDataFrame(rows, SCHEMA), 1).first()
    assert (found["ab"], found["ba"], found["distance"], found["mode"]) == (0.25, 6.0, 1.0, "competition")
