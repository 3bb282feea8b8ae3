"""Scans and frames over segments against loops over sorted rows."""

import random

import pytest
from pyspark.sql import functions as F

from tessella.operators import archive, metrics, scans

STATUSES = archive.STATUSES


def log(n=400, seed=1):
    """Rows (run, arrival, created_at, quality, status, cell, d0); one run holds most of them."""
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 1, 2, None]), i, float(i + rng.random()), rng.choice([None, round(rng.random(), 2)]), rng.choice(STATUSES), rng.randrange(3), 1.0) for i in range(n)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "run int, arrival long, created_at double, quality double, status string, cell int, d0 double").repartition(5)


def runs(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r[1]):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("size", [30, 101, 10**6])
def test_running_totals_carry_over_segments(spark, size):
    rows = log()
    want = {}
    for run, rs in runs(rows).items():
        best = last = None
        for i, r in enumerate(rs):
            best = r[3] if best is None else max(best, r[3] if r[3] is not None else best)
            last = i if r[4] in ("inserted", "replaced") else last
            want[run, r[1]] = (best, None if last is None else i - last)
    got = metrics.best_so_far(frame(spark, rows), "run", segment_rows=size)
    assert {(r["run"], r["arrival"]): (r["best"], r["gap"]) for r in got.collect()} == want


@pytest.mark.parametrize("size", [25, 10**6])
def test_insertion_statuses_over_segments(spark, size):
    rows, want, held = log(), {}, {}
    for r in sorted(rows, key=lambda r: r[1]):
        k, q = (r[0], r[5]), r[3]
        want[r[1]] = "rejected_filter" if q is None else "inserted" if k not in held else "replaced" if q > held[k] else "rejected_quality"
        if q is not None:
            held[k] = max(q, held.get(k, q))
    got = archive.insertion_status(frame(spark, rows).drop("status"), "run", segment_rows=size)
    assert {r["arrival"]: r["status"] for r in got.collect()} == want


@pytest.mark.parametrize("size", [1, 49, 64, 10**6])
def test_frames_reach_over_the_edges_of_blocks(spark, size):
    rows = log()
    rate, share, last = {}, {}, {}
    for run, rs in runs(rows).items():
        for i, r in enumerate(rs):
            part = [x[4] for x in rs[max(0, i - 9) : i + 1]]
            last[run, r[1]] = tuple(part.count(s) for s in STATUSES)
            if i % 12 == 0:
                part = rs[max(0, i - 25) : i + 25]
                span = int(part[-1][2] * 1e6) - int(part[0][2] * 1e6)
                hits = sum(x[4] in ("inserted", "replaced") for x in part)
                rate[run, i] = hits * 60e6 / span if len(part) > 1 and span > 0 else 0.0
                share[run, i] = tuple(sum(x[4] == s for x in part) / len(part) for s in STATUSES)
    df = frame(spark, rows)
    got = {(r["run"], r["i"]): r["rate"] for r in metrics.rolling_rate(df, "run", segment_rows=size).collect()}
    assert got.keys() == rate.keys() and all(abs(got[k] - v) < 1e-4 * max(1, v) for k, v in rate.items())
    got = {(r["run"], r["i"]): tuple(r[s] for s in STATUSES) for r in metrics.rolling_share(df, "run", segment_rows=size).collect()}
    assert got.keys() == share.keys() and all(abs(a - b) < 1e-12 for k, v in share.items() for a, b in zip(got[k], v))
    assert {(r["run"], r["arrival"]): tuple(r[s] for s in STATUSES) for r in metrics.last_summary(df, "run", segment_rows=size).collect()} == last


def test_one_run_is_spread_over_segments(spark):
    rows = spark.range(10_000).select(F.lit(1).alias("run"), F.col("id").alias("arrival"), (F.col("id") % 97).alias("v"))
    found = scans.segments(rows, ["run"], ["arrival"], 500)
    sizes = [r["count"] for r in found.rows.groupBy("_segment").count().collect()]
    assert found.several and len(sizes) >= 15 and max(sizes) < 2000
    got = found.scan({"low": ("min", F.col("v")), "total": ("sum", F.col("v"))}, inclusive=False).done().where("arrival in (0, 1, 9999)").orderBy("arrival").collect()
    assert [(r["low"], r["total"]) for r in got] == [(None, 0), (0, 0), (0, sum(i % 97 for i in range(9999)))]
    assert scans.numbered(rows.limit(0), ["run"], ["arrival"]).done().count() == 0


@pytest.mark.parametrize("size", [7, 10**6])
def test_archives_are_numbered_over_all_runs(spark, size):
    best = spark.createDataFrame([(run, cell) for run in (3, 1, 2) for cell in range(9)], "run_id int, cell int").repartition(4)
    got = archive.union(best.where("run_id < 3"), best.where("run_id = 3").drop("cell").withColumn("cell", F.lit(4)).limit(1), segment_rows=size).orderBy("id").collect()
    assert [(r["run_id"], r["cell"], r["id"]) for r in got] == [(1, c, c) for c in range(9)] + [(2, c, 9 + c) for c in range(9)] + [(3, 4, 18)]
