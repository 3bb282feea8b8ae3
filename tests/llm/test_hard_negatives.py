import numpy as np
import pyspark.sql.functions as F
import pytest

from tessella.llm import hard_negatives as H

COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, anchor, positives=5, negatives=3, low=50, high=95):
    part = [(i, y, np.floor(256 * np.array(v, float)).astype(int)) for i, y, v, *_ in rows if i is not None and y is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    dims, out = max([len(v) for *_, v in part], default=0), []
    m = np.array([np.pad(v, (0, dims - len(v))) for *_, v in part]).reshape(len(part), dims)
    for a, (i, y, _) in enumerate(part):
        if not anchor(i):
            continue
        score = m @ m[a]
        order = sorted((b for b in range(len(part)) if b != a), key=lambda b: (-score[b], part[b][0]))
        for p in [b for b in order if part[b][1] == y][:positives]:
            inside = [b for b in order if part[b][1] != y and low * score[p] <= 100 * score[b] <= high * score[p]]
            out += [(i, part[p][0], k + 1, part[b][0], int(score[p]), int(score[b])) for k, b in enumerate(inside[:negatives])]
    return sorted(out)


def vectors(n, labels, dims, seed, spread=0.5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dims))
    y = rng.integers(0, labels, n)
    x = centres[y] + spread * rng.normal(size=(n, dims))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(int(i), int(y[i]), [float(np.float32(c)) for c in x[i]], "x") for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>, score string")


@pytest.mark.parametrize("n, labels, dims, spread", [(2600, 10, 16, 0.6), (1200, 3, 9, 2.0), (300, 1, 4, 0.3)])
def test_equals_brute_force(spark, n, labels, dims, spread):
    rows = vectors(n, labels, dims, n, spread)
    got = H.mine(frame(spark, rows).repartition(4), F.col("vec_id") % 50 == 0)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 50 == 0)


def test_hot_vectors_ties_repeats_and_rows_that_take_no_part(spark):
    rows = vectors(900, 4, 8, 5)
    hot = rows[0][2]
    rows = [(i, y, hot if i % 3 == 0 else v, z) for i, y, v, z in rows]  # one vector holds a third, of every label
    rows += [rows[50], rows[50], rows[7]]  # repeated rows, one of them an anchor
    rows += [(2000, 1, hot[:3], "short"), (2050, 1, [], "empty"), (2100, None, hot, ""), (None, 1, hot, ""), (2150, 1, None, ""), (2200, 1, [*hot[:-1], None], ""), (2250, 2, [*hot[:-1], float("nan")], ""), (2300, 2, [*hot[:-1], float("inf")], "")]
    got = H.mine(frame(spark, rows).repartition(3), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 50 == 0)
    again = H.mine(frame(spark, rows[::-1]).repartition(7), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_other_numbers_of_positives_and_windows(spark):
    rows = vectors(400, 5, 6, 8)
    got = H.mine(frame(spark, rows), F.col("vec_id") < 9, positives=2, negatives=7, low=10, high=100)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i < 9, 2, 7, 10, 100)


def test_no_rows(spark):
    rows = vectors(20, 2, 4, 1)
    assert H.mine(frame(spark, []), F.lit(True)).count() == 0
    assert H.mine(frame(spark, rows), F.lit(None).cast("boolean")).count() == 0
    assert H.mine(frame(spark, rows[:1]), F.lit(True)).count() == 0


def test_lookups_and_residual_norms_bound_every_score():
    rng = np.random.default_rng(3)
    v = rng.integers(-300, 300, (500, 10)).astype(np.int32)
    points = H.by_subspace(v, 5)
    books = np.stack([H.codebook(points[:, m]) for m in range(5)])
    codes, rest = H.encode(v, books)
    near = np.stack([books[m][codes[:, m]] for m in range(5)], axis=1).reshape(500, -1)
    table, exact = near @ v.T.astype(float), (v.astype(np.int64) @ v.T.astype(np.int64))
    bound = rest.astype(float) @ H.group_norms((points**2).sum(2)).T + 1e-6
    assert (np.abs(table - exact) <= bound).all()
    assert bound.mean() < 0.5 * np.abs(v.astype(float)).sum(1).mean() * 300  # and says something
