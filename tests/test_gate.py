"""The similarity gate in parallel against a plain fold, where the order of arrivals decides."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import archive as A


def plain(rows, centres, epsilon, before=None):
    out, runs = {}, {}
    for run, arrival, *d, q in sorted(rows, key=lambda r: r[1]):
        held = runs.setdefault(run, dict(before or {}))
        if q is None or d[0] is None:
            out[run, arrival] = (None, "rejected_filter")
            continue
        gap = lambda c: sum((a - b) ** 2 for a, b in zip(d, centres[c]))
        cell = min(range(len(centres)), key=lambda c: (gap(c), c))
        close = min((c for c in held if gap(c) < epsilon**2), key=lambda c: (gap(c), c), default=None)
        if cell in held:
            out[run, arrival] = (cell, "replaced" if q > held[cell] else "rejected_quality")
            held[cell] = max(q, held[cell])
        elif close is not None and not q > 1.2 * held[close]:
            out[run, arrival] = (cell, "rejected_similarity")
        else:
            out[run, arrival], held[cell] = (cell, "inserted"), q
    return out


def tables(spark, rows, centres):
    df = spark.createDataFrame(rows, "run_id long, arrival long, d0 double, d1 double, d2 double, quality double").repartition(4)
    return df, spark.createDataFrame([(i, *c) for i, c in enumerate(centres)], "idx int, c0 double, c1 double, c2 double")


def candidates(rng, n, span, runs=(1, 1, 1, 2, None)):
    return [(rng.choice(runs), i, rng.choice([None, *[rng.uniform(0, span)] * 15]), rng.uniform(0, span), 0.5, rng.choice([None, *[round(rng.random(), 2)] * 9])) for i in range(n)]


@pytest.mark.parametrize("epsilon, seed, before", [(0.9, 1, None), (1.6, 2, None), (3.0, 3, {4: 0.8, 9: 0.1}), (50.0, 4, None), (1.2, 5, {0: 0.5})])
def test_equals_the_plain_fold(spark, epsilon, seed, before):
    rng = random.Random(seed)
    centres = [(x + rng.uniform(-0.3, 0.3), y + rng.uniform(-0.3, 0.3), 0.5) for x in range(5) for y in range(5)]
    rows = candidates(rng, 500, 5.0)
    df, cdf = tables(spark, rows, centres)
    want = plain(rows, centres, epsilon, before)
    for how in (A.gated, A.gated_batch):
        got = {(r["run_id"], r["arrival"]): (r["cell"], r["status"]) for r in how(df, cdf, epsilon=epsilon, before=before).collect()}
        assert got == want
    assert epsilon > 2 or len({s for _, s in want.values()}) == 5


def test_order_decides_between_two_cells(spark):
    centres = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0)]
    for order in ([0, 1], [1, 0]):
        rows = [(1, order[0], 0.4, 0.0, 0.0, 0.5), (1, order[1], 0.6, 0.0, 0.0, 0.55)]
        df, cdf = tables(spark, rows, centres)
        got = {(r["run_id"], r["arrival"]): (r["cell"], r["status"]) for r in A.gated(df, cdf, epsilon=1.0).collect()}
        assert got == plain(rows, centres, 1.0)
        assert [s for _, s in got.values()].count("rejected_similarity") == 1


def test_one_run_is_folded_in_many_groups(spark, monkeypatch):
    """All rows are one search's; cells that are out of each other's reach are not in one group."""
    rng = random.Random(7)
    centres = [(3.0 * (i % 8) + rng.uniform(0, 1.2), 3.0 * (i // 8) + rng.uniform(0, 1.2), 0.5) for i in range(64)]
    rows = candidates(rng, 1500, 24.0, (1,))
    df, cdf = tables(spark, rows, centres)
    seen, found = [], A.labels
    monkeypatch.setattr(A, "labels", lambda edges, run: seen.append(found(edges, run)) or seen[-1])
    got = {(r["run_id"], r["arrival"]): (r["cell"], r["status"]) for r in A.gated(df, cdf, epsilon=2.0, segment_rows=200).collect()}
    assert got == plain(rows, centres, 2.0)
    sizes = [r["count"] for r in seen[0].groupBy("label").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 64


def test_labels_of_long_paths_and_none(spark):
    path = [(1, i, i + 1) for i in range(40)] + [(1, 100, 101), (2, 5, 5), (None, 3, 2)]
    got = {(r["run"], r["cell"]): r["label"] for r in A.labels(spark.createDataFrame(path, "run int, cell long, other long"), "run").collect()}
    assert got == {(1, i): 0 for i in range(41)} | {(1, 100): 100, (1, 101): 100, (2, 5): 5, (None, 3): 2, (None, 2): 2}
    df, cdf = tables(spark, [], [(0.0, 0.0, 0.0)])
    assert A.gated(df, cdf).count() == 0
    assert A.gated(df.select(F.lit("x").alias("run_id"), "arrival", "d0", "d1", "d2", "quality"), cdf, before={0: 1.0}).count() == 0
