"""Filter-then-rank of rollouts: cheap tests first, one reason for a rejection, a score for the rest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.vectors import clip

#: Fixed limits of the filters and weights of the score.
ALIVE_LOW, ALIVE_HIGH, CREATURE_FLOOR = 0.5, 2.0, 0.05
BBOX_LIMIT, DRIFT_LIMIT, WINDOW = 0.6, 0.2, 50
WEIGHTS = (0.6, 0.4)
SIGNAL_WEIGHTS = (0.5, 0.3, 0.2)


def not_finite(*values: Column) -> Column:
    bad = F.lit(False)
    for v in values:
        bad = bad | F.coalesce(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(False))
    return bad


def alive(initial: Column, mass: Column, signal: Column) -> Column:
    """Total mass within half and double the initial one, and a floor on the creature's own mass."""
    all_mass = mass + F.coalesce(signal, F.lit(0.0))
    return all_mass.between(ALIVE_LOW * initial, ALIVE_HIGH * initial) & ((initial <= 0) | (mass >= CREATURE_FLOOR * initial))


def stability(drift: Column) -> Column:
    return clip(1.0 - drift / DRIFT_LIMIT, 0.0, 1.0)


def score(compactness: Column, drift: Column, has_signal: Column, mass: Column, initial: Column) -> Column:
    compact = clip(compactness, 0.0, 1.0)
    plain = WEIGHTS[0] * compact + WEIGHTS[1] * stability(drift)
    activity = F.when(initial > 0, clip(mass / initial, 0.0, 1.0)).otherwise(0.0)
    with_signal = SIGNAL_WEIGHTS[0] * compact + SIGNAL_WEIGHTS[1] * stability(drift) + SIGNAL_WEIGHTS[2] * activity
    return F.when(has_signal, with_signal).otherwise(plain)


def evaluate(rollouts: DataFrame) -> DataFrame:
    """``rollouts`` with reason (null: accepted) and quality (null unless accepted).

    Needs initial_mass, final_mass, final_signal, bbox_mean (null: no tail),
    n_steps, drift, compactness, has_signal. d0..d2 of rows that are rejected
    before descriptors are known become null; unstable rows keep theirs.
    """
    c = F.col
    reason = (
        F.when(not_finite(c("final_mass"), c("bbox_mean")), "nan_state")
        .when(~alive(c("initial_mass"), c("final_mass"), c("final_signal")), "dead")
        .when(c("bbox_mean").isNull() | (c("bbox_mean") >= BBOX_LIMIT), "exploded")
        .when(c("final_mass") <= 0, "no_descriptors")
        .when((c("n_steps") < 2 * WINDOW) | (c("drift") > DRIFT_LIMIT), "unstable")
    )
    out = rollouts.withColumn("reason", reason)
    known = c("reason").isNull() | (c("reason") == "unstable")
    for d in ("d0", "d1", "d2"):
        if d in rollouts.columns:
            out = out.withColumn(d, F.when(known, c(d)))
    return out.withColumn("quality", F.when(c("reason").isNull(), score(c("compactness"), c("drift"), c("has_signal"), c("final_mass"), c("initial_mass"))))
