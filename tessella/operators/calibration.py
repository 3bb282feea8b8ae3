"""Fitting the behaviour space: axis scales, centroids, survivors."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import unit
from tessella.operators.percentiles import matched, percentiles
from tessella.sources.tables import stage

AXES = ("d0", "d1", "d2")
#: Survivors below which centroids are spread uniformly instead of fitted.
MIN_SURVIVORS = 20
#: Centroids that a row scans; beyond, a grid leaves it some of them.
SCANNED = 64
#: Centroids of one array.
BLOCK = 50_000


def survivors(rollouts: DataFrame) -> DataFrame:
    return rollouts.where(F.col("d0").isNotNull() & F.col("quality").isNotNull())


def axis_scale(rollouts: DataFrame, *keys: str) -> DataFrame:
    """(keys, axis, p5, p95, scale): one over the 5-95 span of each axis, 1 for a span of 0.

    Exact at any size of a group; an axis of a group without values has nulls.
    """
    found = percentiles(rollouts, list(AXES), [0.05, 0.95], *keys)
    wide = found.groupBy(*keys, "axis").agg(*[F.max(F.when(F.col("share") == s, F.col("value"))).alias(n) for s, n in ((0.05, "p5"), (0.95, "p95"))])
    groups = rollouts.select(*keys).distinct() if keys else rollouts.sparkSession.range(1).select()
    every = groups.withColumn("axis", F.explode(F.array(*[F.lit(i) for i in range(len(AXES))])))
    rows = matched(every, wide, [*keys, "axis"], how="left")
    span = F.col("p95") - F.col("p5")
    return rows.withColumn("scale", F.when(span > 0, 1 / span).otherwise(F.lit(1.0)))


def nearest(points: DataFrame, centroids: DataFrame, idx: str = "idx", axes: tuple[str, ...] = AXES, centre: tuple[str, ...] = ("c0", "c1", "c2"), scanned: int = SCANNED) -> DataFrame:
    """points with the idx of their nearest centroid (the lower idx of equals).

    Centroids go in blocks of BLOCK, each one array in every row's reach: no join
    by distance, no shuffle of the points. An archive's capacity makes one block;
    more are folded one after another. Beyond ``scanned`` centroids a row looks at
    those that its cell of a grid leaves; rows with a coordinate that is null or not
    finite look at all.
    """
    n = max(1, centroids.count())
    blocks = -(-n // BLOCK)
    ends = bounds(points, centroids, axes, centre) if n > scanned else None
    out = points.withColumn("_b", F.lit(None).cast(f"struct<d2:double,i:{centroids.schema[idx].dataType.simpleString()}>"))
    gap = lambda s: reduce(lambda a, b: a + b, [(s[f"v{k}"] - F.col(a)) * (s[f"v{k}"] - F.col(a)) for k, a in enumerate(axes)])
    one = lambda s: F.struct(gap(s).alias("d2"), s["i"].alias("i"))
    for b in range(blocks):
        mine = centroids if blocks == 1 else centroids.where(F.pmod(F.xxhash64(idx), F.lit(blocks)) == b)
        packed = mine.agg(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), *[F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(centre)]))).alias("_cells"))
        best = F.array_min(F.transform("_cells", one))
        if ends:
            packed = grid(packed, ends)
            near = F.transform(F.get("_grid", cell_number([F.col(a) for a in axes], ends)), lambda i: one(F.get("_cells", i)))
            best = F.when(reduce(lambda x, y: x & y, [finite(F.col(a)) for a in axes]), F.array_min(near)).otherwise(best)
        out = out.crossJoin(F.broadcast(packed)).withColumn("_b", F.least("_b", best)).drop("_cells", "_grid")
    return out.withColumn("cell", F.col("_b.i")).withColumn("cell_distance2", F.col("_b.d2")).drop("_b")


def finite(c: Column) -> Column:
    return F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False))


def bounds(points: DataFrame, centroids: DataFrame, axes: tuple[str, ...], centre: tuple[str, ...]) -> list[tuple[float, float, int]]:
    """(low, width, cells) of each axis of a grid that holds all finite points and centroids, about a cell a centroid."""
    found = []
    for df, names in ((points, axes), (centroids, centre)):
        inner = [F.when(finite(F.col(c)), F.col(c).cast("double")) for c in names]
        found.append(df.agg(F.count("*").alias("n"), *[f(c).alias(f"{n}{k}") for k, c in enumerate(inner) for n, f in (("lo", F.min), ("hi", F.max))]).first())
    each = max(1, round(min(found[1]["n"], BLOCK) ** (1 / len(axes))))
    out = []
    for k in range(len(axes)):
        lows, highs = [r[f"lo{k}"] for r in found if r[f"lo{k}"] is not None], [r[f"hi{k}"] for r in found if r[f"hi{k}"] is not None]
        low, width = (min(lows), max(highs) - min(lows)) if lows else (0.0, 0.0)
        out.append((low, width, each if 0 < width < float("inf") else 1))
    return out


def cell_number(at: list[Column], ends: list[tuple[float, float, int]]) -> Column:
    """The number of the grid cell of a point, the first axis fastest."""
    number, step = F.lit(0), 1
    for c, (low, width, n) in zip(at, ends, strict=True):
        if n > 1:
            number = number + F.greatest(F.least(F.floor((c.cast("double") - low) / width * n), F.lit(n - 1)), F.lit(0)) * step
        step *= n
    return number.cast("int")


def grid(packed: DataFrame, ends: list[tuple[float, float, int]]) -> DataFrame:
    """``packed`` with ``_grid``: for each cell the places in ``_cells`` of the centroids that may be nearest to a point in it.

    Of a cell's points none is farther than h, half a diagonal, from its middle. So
    the nearest of any of them is at most 2 h farther from the middle than the
    middle's own nearest.
    """
    half = math.sqrt(sum((w / n / 2) ** 2 for _, w, n in ends)) if all(w < float("inf") for _, w, _ in ends) else float("inf")
    slack = 1e-9 * sum(abs(low) + w for low, w, _ in ends)  # of rounding at the cells' edges
    total = math.prod(n for *_, n in ends)
    cells, step, middle = packed.sparkSession.range(total), 1, []
    for low, width, n in ends:
        middle.append(F.lit(low) + (F.floor(F.col("id") / step) % n + 0.5) * F.lit(width / n))
        step *= n
    away = F.transform("_cells", lambda s: F.sqrt(reduce(lambda a, b: a + b, [(s[f"v{k}"] - m) * (s[f"v{k}"] - m) for k, m in enumerate(middle)])))
    far = cells.crossJoin(F.broadcast(packed)).select("id", away.alias("away"))
    within = lambda least: F.filter(F.transform("away", lambda d, i: F.when(F.coalesce(d <= least + 2 * half + slack, F.lit(True)), i)), lambda i: i.isNotNull())
    near = F.transform(F.array(F.array_min("away")), within)[0]  # the least distance is taken once a cell, not once a centroid
    lists = far.select("id", near.alias("near")).agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "near"))), lambda s: s["near"]).alias("_grid"))
    return packed.crossJoin(F.broadcast(lists))


def kmeans(points: DataFrame, start: DataFrame, rounds: int = 30, axes: tuple[str, ...] = AXES) -> DataFrame:
    """Lloyd's algorithm from the given centroids (idx, c0, c1, c2); empty cells stay where they are."""
    spark = points.sparkSession
    points = stage(points.select(*axes), "points")  # read by every round
    schema = "idx long, c0 double, c1 double, c2 double"
    now = [(r["idx"], r["c0"], r["c1"], r["c2"]) for r in start.orderBy("idx").collect()]
    for _ in range(rounds):
        cells = spark.createDataFrame(now, schema)
        means = nearest(points, cells).groupBy("cell").agg(*[F.avg(a).alias(f"c{k}") for k, a in enumerate(axes)])
        found = {r["cell"]: (r["c0"], r["c1"], r["c2"]) for r in means.collect()}
        new = [(i, *found.get(i, c)) for i, *c in now]
        if new == now:
            break
        now = new
    return spark.createDataFrame(now, schema)


def spread_points(points: DataFrame, k: int, key: str) -> DataFrame:
    """k start centroids: the rows at even ranks in the order of a hash of ``key``."""
    order = Window.orderBy(F.xxhash64(key), key)
    return points.select(key, *AXES).orderBy(F.xxhash64(key), key).limit(k).select((F.row_number().over(order) - 1).cast("long").alias("idx"), *[F.col(a).alias(f"c{i}") for i, a in enumerate(AXES)])


def uniform_centroids(points: DataFrame, k: int, seed: int = 0, low: float = 0.0, high: float = 10.0) -> DataFrame:
    """k centroids uniform in the box of the points, or in [low, high]^3 without any."""
    ends = points.agg(*[f(a).alias(f"{n}{i}") for i, a in enumerate(AXES) for f, n in ((F.min, "lo"), (F.max, "hi"))])
    u = [unit(F.lit(seed), F.lit(i), F.col("id")) for i in range(3)]
    rows = points.sparkSession.range(k).crossJoin(F.broadcast(ends))
    return rows.select(F.col("id").alias("idx"), *[(F.coalesce(F.col(f"lo{i}"), F.lit(low)) + u[i] * (F.coalesce(F.col(f"hi{i}"), F.lit(high)) - F.coalesce(F.col(f"lo{i}"), F.lit(low)))).alias(f"c{i}") for i in range(3)])


def fit_centroids(points: DataFrame, k: int, key: str, rounds: int = 30, seed: int = 0) -> DataFrame:
    """min(k, points) fitted centroids; uniform ones with fewer than MIN_SURVIVORS points."""
    n = points.count()
    if n < MIN_SURVIVORS:
        return uniform_centroids(points, k, seed)
    return kmeans(points, spread_points(points, min(k, n), key), rounds)
