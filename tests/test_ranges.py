"""Range joins against loops, with one hot value and ranges over many segments."""

import random

import pytest

from tessella.operators import ranges


@pytest.mark.parametrize("size", [16, 90, 10**6])
def test_the_latest_start(spark, size):
    rng = random.Random(4)
    points = [(rng.choice([1, 1, 1, 2, None]), rng.choice([50, 50, rng.randrange(-5, 120), None]), i) for i in range(300)]
    starts = [(rng.choice([1, 2, None, 9]), rng.choice([None, *[rng.randrange(100)] * 12]), rng.randrange(1000)) for _ in range(40)]
    df = spark.createDataFrame(points, "who int, at long, id int").repartition(3)
    sdf = spark.createDataFrame(starts, "who int, since int, name int").repartition(2)
    want = {}
    for who, at, i in points:
        known = [(s, n) for w, s, n in starts if w == who and s is not None and at is not None and s <= at]
        want[i] = max(known)[1] if known else None
    got = ranges.as_of(df, sdf, "at", "since", "who", segment_rows=size)
    assert got.columns == ["who", "at", "id", "name"] and {r["id"]: r["name"] for r in got.collect()} == want
    assert got.count() == len(points)


@pytest.mark.parametrize("size", [5, 10**6])
def test_shares_of_a_cumulative_sum(spark, size):
    owners = [(1, 3), (2, 0), (3, 40), (4, None), (5, 1), (6, 10)]
    points = [(i, v) for i, v in enumerate([*range(-2, 60), 7, 7, 7, None])]
    deal = [o for o, n in owners for _ in range(n or 0)]
    want = {i: deal[v] if v is not None and 0 <= v < len(deal) else None for i, v in points}
    got = ranges.assigned(spark.createDataFrame(points, "id int, v int"), spark.createDataFrame(owners, "owner int, n int"), "v", "n", "owner", segment_rows=size)
    assert {r["id"]: r["owner"] for r in got.collect()} == want
