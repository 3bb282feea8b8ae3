"""The search: calibration, then generations of random and mutated records into a gated archive."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions import params as P
from tessella.operators import archive as AR
from tessella.operators import calibration as C
from tessella.operators import descriptors as D
from tessella.operators.metrics import progress
from tessella.operators.quality import evaluate
from tessella.operators.series import TAIL
from tessella.operators.simulation import World, rollouts
from tessella.sources.tables import checkpoint_table, release, stage

#: Calibration rollouts of the presets, and more of them for a signal.
CALIBRATION, SIGNAL_CALIBRATION = {"dev": 50, "standard": 150, "pretty": 200}, 50


@dataclass(frozen=True)
class SearchConfig:
    """Settings of a search; ``batch`` times ``workers`` records make a generation."""

    budget: int = 500
    random_phase: int = 200
    batch: int = 1
    workers: int = 1
    calibration: int = 150
    cells: int = 1024
    base_seed: int = 0
    checkpoint_every: int = 100
    epsilon: float = AR.EPSILON
    descriptors: tuple[str, ...] = D.DEFAULT
    signal: bool = False

    def __post_init__(self) -> None:
        for name in ("budget", "batch", "workers", "calibration", "cells", "checkpoint_every"):
            if isinstance(getattr(self, name), bool) or getattr(self, name) < 1:
                raise ValueError(f"{name} must be 1 at least, not {getattr(self, name)!r}")
        if self.random_phase < 0 or self.epsilon < 0:
            raise ValueError("random_phase and epsilon cannot be negative")
        D.resolve(self.descriptors, self.signal)


def judged(records: DataFrame, world: World, config: SearchConfig) -> DataFrame:
    """Records with their descriptors, reason and quality."""
    trace = stage(rollouts(records, world, config.signal, lanes=min(8, config.batch), capture=True), "trace")
    described = D.describe(trace, world, config.descriptors, config.signal)
    tail = D.window_of(trace, 1, TAIL).groupBy("seed").agg(F.avg("bbox").alias("bbox_mean"))
    ends = trace.groupBy("seed").agg(F.min_by("mass", "step").alias("initial_mass"), F.max_by("mass", "step").alias("final_mass"), F.max_by("signal_total", "step").alias("final_signal"), F.max_by("compactness", "step").alias("compactness"))
    rows = described.join(ends, "seed").join(tail, "seed").withColumn("has_signal", F.lit(config.signal))
    done = stage(records.join(evaluate(rows), "seed"), "judged")
    release(trace)
    return done


def search(spark: SparkSession, world: World, config: SearchConfig | None = None, *, back: Callable[[dict], None] | None = None, checkpoint: str | None = None, **changes) -> tuple[DataFrame, DataFrame]:
    """(events, archive): every candidate with its status, and the best of each cell.

    A generation is one job; it is folded once, into the qualities of the cells
    held so far, and its rows are written before the next. ``back`` gets the
    counts after each generation; ``checkpoint`` is a table (read_checkpoint) of
    the archive, replaced every ``checkpoint_every`` candidates and at the end.
    """
    config = config or SearchConfig(**changes)
    first = judged(P.population(P.seeds(spark, config.base_seed, config.calibration, True), world.kernels, config.signal), world, config)
    alive = C.survivors(first)
    scale = [r["scale"] for r in C.axis_scale(alive).orderBy("axis").collect()] if alive.count() > 1 else [1.0, 1.0, 1.0]
    scaled = lambda df: df.withColumns({a: F.col(a) * float(s) for a, s in zip(C.AXES, scale, strict=True)})
    centroids = stage(C.fit_centroids(scaled(alive), config.cells, "seed"), "centroids")
    accepted = F.col("status").isin(AR.INSERTED, AR.REPLACED)
    parts, best, held, counts = [], None, {}, {"done": 0, "accepted": 0, "occupied": 0, "best": None}
    seed, end = config.base_seed, config.base_seed + config.budget
    since = 0
    while seed < end:
        n = min(config.batch * config.workers, end - seed)
        fresh = P.seeds(spark, seed, n)
        if best is None or not held or seed < config.base_seed + config.random_phase:
            records = P.population(fresh, world.kernels, config.signal).withColumn("parent", F.lit(None).cast("long"))
        else:
            drawn = stage(AR.random_parents(fresh.withColumnRenamed("seed", "child"), best, seed).withColumnRenamed("child", "seed"), "parents")
            kept = best.select(F.col("cell").alias("parent_cell"), *[m[0] for m in P.fields(config.signal)])
            records = P.mutate(drawn.join(kept, "parent_cell"), config.signal).join(drawn.select("seed", "parent"), "seed")
        done = C.nearest(scaled(judged(stage(records, "records"), world, config)), centroids).withColumn("run_id", F.lit("search")).withColumn("arrival", F.col("seed") - config.base_seed)
        status = AR.gated_batch(done, centroids, epsilon=config.epsilon, before=held).select("arrival", "status")
        part = stage(done.join(status, "arrival"), "events")
        parts.append(part)
        new = part.where(accepted)
        best = stage(AR.best_per_cell(new if best is None else best.unionByName(new)), "archive")
        held = {r["cell"]: r["quality"] for r in best.select("cell", "quality").collect()}  # bounded by the cells
        counts = {"done": counts["done"] + n, "accepted": counts["accepted"] + new.count(), "occupied": len(held), "best": max(held.values(), default=None)}
        if back:
            back(counts)
        seed, since = seed + n, since + n
        if checkpoint and (since >= config.checkpoint_every or seed >= end):
            checkpoint_table(best, checkpoint)
            since = 0
    events = parts[0]
    for part in parts[1:]:
        events = events.unionByName(part)
    return events, best


def eta(counts: dict, budget: int, elapsed: float) -> float | None:
    return progress(counts["done"], budget, elapsed)
