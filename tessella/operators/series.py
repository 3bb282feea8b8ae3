"""Descriptors of ordered traces: (creature, step, com_y, com_x, bbox, gyradius).

All of them come from one window over (creature, step) and one aggregation, so
asking for eight costs one shuffle. ``tail`` is the number of last steps.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.vectors import clip, wrapped
from tessella.operators.percentiles import matched
from tessella.session import ship

TAIL = 50
CLIP = 100.0
MOVING = 1e-4


def framed(trace: DataFrame, tail: int, *keys: str) -> DataFrame:
    """trace with differences to the step before and rn, the place from the end.

    Differences do not reach across the edges of tail frames: a tail's first
    row has none.
    """
    by = Window.partitionBy(*keys).orderBy("step")
    n = F.count("*").over(Window.partitionBy(*keys))
    rn = n - F.row_number().over(by) + 1
    out = trace.withColumn("n_steps", n).withColumn("rn", rn)
    for c in ("com_y", "com_x", "gyradius"):
        out = out.withColumn(f"d_{c}", F.col(c) - F.lag(c).over(by))
    out = out.withColumn("speed", F.sqrt(F.col("d_com_y") * F.col("d_com_y") + F.col("d_com_x") * F.col("d_com_x")))
    out = out.withColumn("angle", F.atan2("d_com_y", "d_com_x"))
    return out.withColumn("speed_before", F.lag("speed").over(by)).withColumn("turn", wrapped(F.col("angle") - F.lag("angle").over(by)))


def descriptors(trace: DataFrame, tail: int = TAIL, *keys: str) -> DataFrame:
    """One row per creature: velocity, oscillation, mass_asymmetry, displacement_ratio,
    angular_velocity, morphological_instability, activity, persistence_score."""
    keys = keys or ("creature",)
    rows = framed(trace, tail, *keys)
    last = F.col("rn") <= tail
    inner = F.col("rn") < tail  # steps whose difference lies in the tail
    both = F.col("rn") < tail - 1
    when = lambda c, v: F.when(c, v)
    moving = both & (F.col("speed") > MOVING) & (F.col("speed_before") > MOVING)
    older = (F.col("rn") > tail) & (F.col("rn") <= 2 * tail)
    older_inner = (F.col("rn") > tail) & (F.col("rn") < 2 * tail)
    ax, ay = F.avg(when(inner, F.abs("d_com_x"))), F.avg(when(inner, F.abs("d_com_y")))
    first_y, first_x = (F.min_by(c, when(last, F.col("step"))) for c in ("com_y", "com_x"))
    last_y, last_x = (F.max_by(c, "step") for c in ("com_y", "com_x"))
    moved = F.sqrt((last_y - first_y) * (last_y - first_y) + (last_x - first_x) * (last_x - first_x))
    path = F.sum(when(inner, F.col("speed")))
    zero = lambda c: F.coalesce(clip(c, 0.0, CLIP), F.lit(0.0))
    drift = F.greatest(F.abs(F.avg(when(inner, F.col("speed"))) - F.avg(when(older_inner, F.col("speed")))), F.abs(F.avg(when(last, F.col("gyradius"))) - F.avg(when(older, F.col("gyradius")))))
    return rows.groupBy(*keys).agg(
        F.max("n_steps").alias("n_steps"),
        zero(F.avg(when(inner, F.col("speed")))).alias("velocity"),
        zero(F.var_pop(when(last, F.col("bbox")))).alias("oscillation"),
        zero(F.when(ax + ay > 0, F.abs(ax - ay) / (ax + ay))).alias("mass_asymmetry"),
        zero(F.when(path > 0, moved / path)).alias("displacement_ratio"),
        zero(F.when(F.count(when(moving, F.lit(1))) >= 2, F.avg(when(moving, F.abs("turn"))))).alias("angular_velocity"),
        zero(F.var_pop(when(last, F.col("gyradius")))).alias("morphological_instability"),
        zero(F.avg(when(inner, F.abs("d_gyradius")))).alias("activity"),
        F.when(F.max("n_steps") >= 2 * tail, zero(drift)).otherwise(0.0).alias("persistence_score"),
    )


#: User descriptors: name -> aggregate over framed rows, or function of a trace.
REGISTRY: dict[str, Column | Callable[[dict[str, np.ndarray]], float]] = {}
TRACE = ("step", "com_y", "com_x", "bbox", "gyradius")


def register(name: str, descriptor: Column | Callable[[dict[str, np.ndarray]], float]) -> None:
    """Add or replace a descriptor: an aggregate expression over framed() rows, or a function.

    A function gets the columns of TRACE as arrays in order of the steps and
    returns a number; it runs in a task for each creature, and what is not finite
    counts as 0.
    """
    if not name or not (isinstance(descriptor, Column) or callable(descriptor)):
        raise TypeError("a descriptor has a name and an aggregate column or a function")
    REGISTRY[name] = descriptor


def user_descriptors(trace: DataFrame, tail: int = TAIL, *keys: str) -> DataFrame:
    keys = keys or ("creature",)
    columns = {n: d for n, d in REGISTRY.items() if isinstance(d, Column)}
    functions = {n: d for n, d in REGISTRY.items() if n not in columns}
    out = framed(trace, tail, *keys).groupBy(*keys).agg(*[c.alias(n) for n, c in columns.items()]) if columns else None
    if functions:
        more = computed(trace, functions, *keys)
        out = more if out is None else matched(out, more, list(keys))
    return out


def computed(trace: DataFrame, functions: dict[str, Callable[[dict[str, np.ndarray]], float]], *keys: str) -> DataFrame:
    """(keys, a column a function) of each trace; a trace has as many rows as its rollout kept steps."""
    ship(trace.sparkSession)
    kinds = [f"{k} {trace.schema[k].dataType.simpleString()}" for k in keys]

    def run(group: pa.Table) -> pa.Table:
        order = np.argsort(group["step"].to_numpy(), kind="stable")
        arrays = {c: group[c].to_numpy()[order] for c in TRACE}
        values = {n: float(f(arrays)) for n, f in functions.items()}
        found = {n: pa.array([min(max(v, 0.0), CLIP) if np.isfinite(v) else 0.0]) for n, v in values.items()}
        return pa.table({k: group[k][:1].combine_chunks() for k in keys} | found)

    return trace.select(*keys, *TRACE).groupBy(*keys).applyInArrow(run, ", ".join([*kinds, *[f"`{n}` double" for n in functions]]))
