"""Pairs of creatures by what one emits and the other receives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.vectors import argmax, distance, dot
from tessella.operators import pair_blocks
from tessella.session import ship

THRESHOLD = 0.1
REPULSION, COMPETITION, PURSUIT, BLIND = pair_blocks.REPULSION, pair_blocks.COMPETITION, pair_blocks.PURSUIT, pair_blocks.BLIND


def mode(ab: Column, ba: Column, t: float = THRESHOLD) -> Column:
    """Both repelled, both attracted, one of each, or neither strong enough to tell."""
    return F.when((ab < -t) & (ba < -t), REPULSION).when((ab > t) & (ba > t), COMPETITION).when(((ab > t) & (ba < -t)) | ((ab < -t) & (ba > t)), PURSUIT).otherwise(BLIND)


def scored_pairs(creatures: DataFrame, *, key: str = "id", cross: str | None = None, min_quality: float = 0.0) -> DataFrame:
    """All pairs i < j with products both ways, mode, distance and score.

    A theta join of a filtered, projected table, for callers that need every pair
    as a row; ``mode_counts``, ``best_pairs`` and ``cross_pairs`` score pairs of
    blocks and give out totals only. ``cross`` leaves only pairs that differ in
    that column.
    """
    rows = creatures.where(F.col("quality") >= min_quality)
    names = [key, "emission", "receptor", "d", "quality", *([cross] if cross else [])]
    a = rows.select(*[F.col(c).alias(f"{c}_a") for c in names])
    b = rows.select(*[F.col(c).alias(f"{c}_b") for c in names])
    on = F.col(f"{key}_a") < F.col(f"{key}_b")
    if cross:
        on = on & (F.col(f"{cross}_a") != F.col(f"{cross}_b"))
    out = a.join(b, on)
    ab, ba = dot(F.col("emission_a"), F.col("receptor_b")), dot(F.col("emission_b"), F.col("receptor_a"))
    out = out.select(f"{key}_a", f"{key}_b", *([f"{cross}_a", f"{cross}_b"] if cross else []), ab.alias("ab"), ba.alias("ba"), distance(F.col("d_a"), F.col("d_b")).alias("distance"), ((F.col("quality_a") + F.col("quality_b")) / 2).alias("avg_quality"))
    return out.withColumn("mode", mode(F.col("ab"), F.col("ba"))).withColumn("score", F.abs("ab") + F.abs("ba") + pair_blocks.FAR * F.col("distance") + pair_blocks.GOOD * F.col("avg_quality"))


def top_pairs(pairs: DataFrame, k: int, key: str = "id") -> DataFrame:
    """The k best of each mode; ties by ids."""
    rank = F.row_number().over(Window.partitionBy("mode").orderBy(F.desc("score"), f"{key}_a", f"{key}_b"))
    return pairs.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def block_pairs(creatures: DataFrame, *, key: str = "id", cross: str | None = None, min_quality: float = 0.0) -> DataFrame:
    """Every two blocks of creatures once, and every block with itself: a Cartesian product of packed blocks."""
    ship(creatures.sparkSession)
    numbers = [*[F.col(c).cast("array<double>").alias(c) for c in ("emission", "receptor", "d")], F.col("quality").cast("double").alias("quality")]
    rows = creatures.where((F.col("quality") >= min_quality) & F.col(key).isNotNull()).select(key, *([cross] if cross else []), *numbers)
    packed = pair_blocks.pack(rows.where(F.col(cross).isNotNull()) if cross else rows)
    a, b = (packed.select(*[F.col(c).alias(f"{c}_{side}") for c in packed.columns]) for side in "ab")
    even = (F.col("block_a") + F.col("block_b")) % 2 == 0
    # which of two blocks is first alternates, so that every task gets as many pairs
    return a.hint("shuffle_replicate_nl").join(b, (F.col("block_a") == F.col("block_b")) | ((F.col("block_a") != F.col("block_b")) & ((F.col("block_a") < F.col("block_b")) == even)))


def mode_counts(creatures: DataFrame, *, key: str = "id", min_quality: float = 0.0) -> DataFrame:
    """(mode, n) of all pairs i < j."""
    counted = block_pairs(creatures, key=key, min_quality=min_quality).mapInArrow(pair_blocks.counter(key, THRESHOLD), "mode string, n long")
    return counted.groupBy("mode").agg(F.sum("n").alias("n"))


def best_pairs(creatures: DataFrame, k: int, *, key: str = "id", min_quality: float = 0.0) -> DataFrame:
    """top_pairs() of all scored_pairs(): each task keeps the k best of a mode of its blocks."""
    kind = creatures.schema[key].dataType
    numbers = ("ab", "ba", "distance", "avg_quality", "score")
    schema = T.StructType([T.StructField(f"{key}_a", kind), T.StructField(f"{key}_b", kind), T.StructField("mode", T.StringType()), *[T.StructField(c, T.DoubleType()) for c in numbers]])
    return top_pairs(block_pairs(creatures, key=key, min_quality=min_quality).mapInArrow(pair_blocks.best(key, k, THRESHOLD), schema), k, key)


def cross_pairs(creatures: DataFrame, cross: str, *, key: str = "id", min_quality: float = 0.0) -> DataFrame:
    """(lo, hi, n, best): of any two values of ``cross``, the number of pairs i < j and their best score."""
    kind = creatures.schema[cross].dataType
    schema = T.StructType([T.StructField("lo", kind), T.StructField("hi", kind), T.StructField("n", T.LongType()), T.StructField("best", T.DoubleType())])
    found = block_pairs(creatures, key=key, cross=cross, min_quality=min_quality).mapInArrow(pair_blocks.crossed(key, cross), schema)
    return found.groupBy("lo", "hi").agg(F.sum("n").alias("n"), F.max("best").alias("best"))


def emission_matrix(species: DataFrame, key: str = "species") -> DataFrame:
    """Product of every species' emission with every species' receptors, itself included; species are few."""
    a = species.select(F.col(key).alias("a"), "emission")
    b = species.select(F.col(key).alias("b"), "receptor")
    return a.join(b, F.lit(True), "cross").select("a", "b", dot(F.col("emission"), F.col("receptor")).alias("product"))


def dominant(rows: DataFrame, column: str = "channels") -> DataFrame:
    """rows with the first place of the greatest channel, and its share (1/C of nothing)."""
    total = F.aggregate(column, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return rows.withColumn("dominant_channel", argmax(F.col(column))).withColumn("dominant_fraction", F.when(total > 0, F.array_max(column) / total).otherwise(1.0 / F.size(column)))


def experiment_yaml(pairs: DataFrame, key: str = "id") -> DataFrame:
    """One block of an experiments file for each pair, best first."""
    rows = pairs.orderBy("mode", "rank")
    block = F.format_string("  - name: %s-%s-%s\n    sources:\n      - {creature_id: %s, n: 1}\n      - {creature_id: %s, n: 1}\n", F.col("mode"), F.col(f"{key}_a").cast("string"), F.col(f"{key}_b").cast("string"), F.col(f"{key}_a").cast("string"), F.col(f"{key}_b").cast("string"))
    return rows.select("mode", "rank", block.alias("yaml"))


def signal_creatures(creatures: DataFrame, min_quality: float = 0.0) -> DataFrame:
    """Creatures of a least quality that have a signal."""
    return creatures.where((F.col("quality") >= min_quality) & F.col("emission").isNotNull())
