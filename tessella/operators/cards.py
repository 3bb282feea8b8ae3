"""Summaries for viewers: cards of runs and ecosystems, frames, lineage of names.

Only the data of pages and pictures is made here.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions.params import MASS_SPECS, SIGNAL_SPECS
from tessella.operators.simulation import PRESETS
from tessella.session import ship


# Decimal places of a creature's card. Parameters that are not named have four, and the radius stays.
PLACES = {"emission_rate": 5, "descriptors": 6, "quality": 4, "compute_seconds": 3}
PARAMETERS = tuple(name for name, *_ in MASS_SPECS + SIGNAL_SPECS if name != "radius")


def rounded_to(c: Column, kind: T.DataType, places: int) -> Column:
    """Every number of ``c``, however deep in arrays, to a number of places."""
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: rounded_to(x, kind.elementType, places))
    return F.round(c.cast("double"), places)


def creature_cards(creatures: DataFrame) -> DataFrame:
    """Creatures with the numbers that a card shows; nulls stay, other columns are as they were."""
    shown = {f.name: PLACES.get(f.name, 4) for f in creatures.schema if f.name in PARAMETERS or f.name in PLACES}
    return creatures.select(*[rounded_to(F.col(f.name), f.dataType, shown[f.name]).alias(f.name) if f.name in shown else F.col(f"`{f.name}`") for f in creatures.schema])


def preset_of(grid: Column) -> Column:
    """The preset with that grid side, else custom."""
    out = F.lit("custom")
    for name, (side, *_) in PRESETS.items():
        out = F.when(grid == side, name).otherwise(out)
    return out


def run_cards(totals: DataFrame, fills: DataFrame, configs: DataFrame, *keys: str) -> DataFrame:
    """One card a run: preset, candidates, insertions and fill in per cent; 0 for runs without a log."""
    rows = configs.join(totals, list(keys), "left").join(fills, list(keys), "left")
    return rows.select(*keys, preset_of(F.col("grid")).alias("preset"), F.coalesce("n", F.lit(0)).alias("candidates"), F.round(100 * F.coalesce("insertion_share", F.lit(0.0)), 1).alias("inserted_percent"), F.coalesce("occupied", F.lit(0)).alias("occupied"), F.round(100 * F.coalesce("fill", F.lit(0.0)), 1).alias("fill_percent"))


def source_names(sources: Column) -> Column:
    """A name of each source: its creature, or run and coordinates in older files."""
    return F.transform(sources, lambda s: F.coalesce(s["creature_id"], F.concat(s["run_id"], F.lit("["), F.array_join(F.transform(s["cell"], lambda v: v.cast("string")), ","), F.lit("]"))))


def mode_of(mode: Column, sources: Column) -> Column:
    return F.coalesce(mode, F.when(F.size(sources) > 1, "heterogeneous").otherwise("homogeneous"))


def ecosystem_cards(summaries: DataFrame) -> DataFrame:
    """Cards from summaries of any age: older ones have grid and n_creatures instead of sides and sources."""
    have = set(summaries.columns)
    old = lambda name, kind: F.col(name) if name in have else F.lit(None).cast(kind)
    return summaries.select("name", mode_of(old("mode", "string"), F.col("sources")).alias("mode"), F.coalesce(old("grid_h", "int"), old("grid", "int")).alias("grid_h"), F.coalesce(old("grid_w", "int"), old("grid", "int")).alias("grid_w"), F.coalesce(F.aggregate("sources", F.lit(0), lambda a, s: a + s["n"]), old("n_creatures", "int")).alias("creatures"), F.exists(F.coalesce(old("signal_total_history", "array<double>"), F.array().cast("array<double>")), lambda v: v > 0).alias("has_signal"))


def resolved(experiments: DataFrame) -> DataFrame:
    """experiments with the patch of each source filled in from the spawn settings."""
    return experiments.withColumn("sources", F.transform("sources", lambda s: s.withField("patch", F.coalesce(s["patch"], F.col("patch")))))


def sampled_frames(steps: DataFrame, n: int, *keys: str) -> DataFrame:
    """The rows of about n steps at even distances, the first and the last among them."""
    ends = steps.groupBy(*keys).agg(F.min("step").alias("_a"), F.max("step").alias("_b"))
    wanted = ends.select(*keys, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(F.col("_a") + i * (F.col("_b") - F.col("_a")) / max(n - 1, 1)).cast("long")))).alias("step"))
    return steps.join(wanted, [*keys, "step"], "left_semi")


def snapshots(steps: DataFrame, every: int, *keys: str) -> DataFrame:
    """Every ``every``-th step and the last."""
    last = steps.groupBy(*keys).agg(F.max("step").alias("_last"))
    joined = steps.join(last, list(keys)) if keys else steps.crossJoin(F.broadcast(last))
    return joined.where((F.col("step") % every == 0) | (F.col("step") == F.col("_last"))).drop("_last")


def quantised(field: np.ndarray, side: int) -> np.ndarray:
    """A field averaged down to side x side and scaled to bytes by its peak."""
    h, w = field.shape
    rows, cols = np.linspace(0, h, side + 1).astype(int), np.linspace(0, w, side + 1).astype(int)
    sums = np.add.reduceat(np.add.reduceat(field, rows[:-1], axis=0), cols[:-1], axis=1)
    mean = sums / np.outer(np.diff(rows), np.diff(cols))
    return np.round(255 * np.clip(mean / max(mean.max(), 1e-12), 0, 1)).astype(np.uint8)


def require_signal(descriptors: list[str], has_signal: bool, signal_only: frozenset[str] = frozenset({"signal_field_variance", "signal_mass_ratio", "dominant_channel_fraction"})) -> None:
    """Refuse descriptors of the signal field for worlds without one."""
    wrong = sorted(signal_only.intersection(descriptors)) if not has_signal else []
    if wrong:
        raise ValueError(f"descriptors {wrong} need a signal field")


def isolated(df: DataFrame, key: str, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply ``work`` to each group of ``key``; a group that fails gives one row with its error, and the others go on."""
    ship(df.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return work(pdf).assign(error=None)
        except Exception as e:  # noqa: BLE001  the error is the result
            return pd.DataFrame([{n: None for n in names} | {key: pdf[key].iloc[0], "error": f"{type(e).__name__}: {e}"}])

    return df.groupBy(key).applyInPandas(run, f"{schema}, error string")


def dispatched(submitted: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Every submitted key, in order, with done, failed or lost."""
    state = results.groupBy(key).agg(F.bool_or(F.col("error").isNotNull()).alias("_failed"), F.max("error").alias("error"))
    return submitted.join(state, key, "left").select(key, "submission", F.when(F.col("_failed").isNull(), "lost").when(F.col("_failed"), "failed").otherwise("done").alias("state"), "error").orderBy("submission")
