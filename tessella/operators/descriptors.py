"""The descriptors that a search may use as its three axes.

Those of a trace come from series.py, those of a final field from fields.py, and
those of the signal from the rollout's last row. User descriptors are aggregate
columns over framed traces (series.register, or a module's DESCRIPTORS).
"""

from __future__ import annotations

import importlib.util
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.vectors import clip
from tessella.operators import fields, series
from tessella.operators.simulation import World

ARITY = 3
SERIES, ROW, FIELD, SIGNAL, USER = "series", "row", "field", "signal", "user"


@dataclass(frozen=True)
class Descriptor:
    """What a viewer shows of a descriptor, and where its values come from."""

    key: str
    label: str
    short: str
    direction: str
    source: str

    @property
    def signal_only(self) -> bool:
        return self.source == SIGNAL


# Names, short names and directions of the descriptors.
REGISTRY = {
    d.key: d
    for d in (
        Descriptor("velocity", "velocity", "vel.", "faster", SERIES),
        Descriptor("gyradius", "gyradius", "gyr.", "larger", ROW),
        Descriptor("spectral_entropy", "spectral entropy", "spec.ent.", "higher entropy", FIELD),
        Descriptor("oscillation", "oscillation", "osc.", "more pulsing", SERIES),
        Descriptor("compactness", "compactness", "comp.", "more compact", ROW),
        Descriptor("mass_asymmetry", "mass asymmetry", "asym.", "more asymmetric", SERIES),
        Descriptor("png_compressibility", "PNG compressibility", "compress.", "less compressible", FIELD),
        Descriptor("rotational_symmetry", "rotational symmetry", "rot.sym.", "more asymmetric", FIELD),
        Descriptor("persistence_score", "persistence score", "persist.", "less stable", SERIES),
        Descriptor("displacement_ratio", "displacement ratio", "displ.", "more glider-like", SERIES),
        Descriptor("angular_velocity", "angular velocity", "ang.vel.", "faster rotation", SERIES),
        Descriptor("growth_gradient", "growth gradient", "grad.", "higher gradient", FIELD),
        Descriptor("morphological_instability", "morphological instability", "morph.", "more unstable", SERIES),
        Descriptor("activity", "activity", "act.", "more active", SERIES),
        Descriptor("spatial_entropy", "spatial entropy", "spat.ent.", "more diffuse", FIELD),
        Descriptor("signal_field_variance", "signal field variance", "sig.var.", "more localized", SIGNAL),
        Descriptor("signal_mass_ratio", "signal mass ratio", "sig.ratio", "more accumulated", SIGNAL),
        Descriptor("dominant_channel_fraction", "dominant channel fraction", "dom.ch.", "more specialized", SIGNAL),
    )
}
DEFAULT = ("velocity", "gyradius", "spectral_entropy")


def metadata(key: str) -> Descriptor:
    """What to show of a descriptor; of one that is not known, its key."""
    return REGISTRY.get(key) or Descriptor(key, key.replace("_", " "), key, "more", USER)


def resolve(names: tuple[str, ...], signal: bool = False) -> tuple[Descriptor, ...]:
    """Three different known descriptors; those of the signal need a world with one."""
    if len(names) != ARITY or len(set(names)) != ARITY:
        raise ValueError(f"a search has {ARITY} different descriptors, not {list(names)}")
    unknown = sorted(set(names) - set(REGISTRY) - set(series.REGISTRY))
    if unknown:
        raise ValueError(f"unknown descriptors {unknown}; known: {sorted({*REGISTRY, *series.REGISTRY})}")
    found = tuple(metadata(n) for n in names)
    wrong = [d.key for d in found if d.signal_only and not signal]
    if wrong:
        raise ValueError(f"descriptors {wrong} need a signal field")
    return found


def load_module(path: str) -> list[str]:
    """Register the user descriptors of a Python file: DESCRIPTORS, a list of (name, aggregate column or function of a trace)."""
    spec = importlib.util.spec_from_file_location("user_descriptors", path)
    if spec is None or spec.loader is None:
        raise ValueError(f"{path} is no Python file")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    found = getattr(module, "DESCRIPTORS", None)
    if not isinstance(found, list):
        raise TypeError(f"{path} has no list DESCRIPTORS")
    for entry in found:
        if not (isinstance(entry, tuple) and len(entry) == 2 and (isinstance(entry[1], Column) or callable(entry[1]))):
            raise TypeError(f"{path}: {entry!r} is no pair of a name and an aggregate column or a function")
        series.register(*entry)
    return [n for n, _ in found]


def window_of(trace: DataFrame, first: int, last: int) -> DataFrame:
    """Steps of each seed whose place from the end is first .. last, as a trace of its own."""
    by = Window.partitionBy("seed")
    rn = F.count("*").over(by) - F.row_number().over(by.orderBy("step")) + 1
    return trace.withColumn("_rn", rn).where(F.col("_rn").between(first, last)).drop("_rn")


def field_values(final: DataFrame, world: World, wanted: list[str]) -> DataFrame | None:
    """(seed, descriptors) of final fields (seed, field)."""
    if not wanted:
        return None
    cells = final.select("seed", F.posexplode("field").alias("at", "value")).where("value > 0").select("seed", F.expr(f"at div {world.width}").cast("int").alias("y"), (F.col("at") % world.width).alias("x"), "value")
    makers = {
        "spectral_entropy": lambda: fields.transforms(cells, world.height, "seed").select("seed", "spectral_entropy"),
        "png_compressibility": lambda: fields.transforms(cells, world.height, "seed").select("seed", "png_compressibility"),
        "rotational_symmetry": lambda: fields.rotational_symmetry(cells, "seed"),
        "growth_gradient": lambda: fields.growth_gradient(cells, world.height, "seed"),
        "spatial_entropy": lambda: fields.coarse_entropy(cells, world.height, "seed"),
    }
    out = final.select("seed")
    for name in wanted:
        out = out.join(makers[name]().select("seed", name), "seed", "left")
    return out


def describe(trace: DataFrame, world: World, names: tuple[str, ...], signal: bool = False, tail: int = series.TAIL) -> DataFrame:
    """(seed, d0, d1, d2, n_steps, drift) of captured traces.

    ``drift`` is the greatest change of an axis between the last two windows of
    ``tail`` steps; the axes of the final field do not change.
    """
    found = resolve(names, signal)
    own = trace.select("seed", "step", "com_y", "com_x", "bbox", "gyradius")

    def of(rows: DataFrame) -> DataFrame:
        out = series.descriptors(rows, tail, "seed")
        if any(d.source == USER for d in found):
            out = out.join(series.user_descriptors(rows, tail, "seed"), "seed")
        return out

    moving = [d.key for d in found if d.source in (SERIES, USER)]
    late = of(own).select("seed", "n_steps", *moving)
    early = of(window_of(own, tail + 1, 2 * tail)).select("seed", *[F.col(n).alias(f"{n}_before") for n in moving])
    final = trace.where("field is not null")
    first = trace.groupBy("seed").agg(F.min_by("signal_total", "step").alias("_s0"))
    total = F.aggregate("channels", F.lit(0.0), lambda a, v: a + v)
    row = {
        "gyradius": clip(F.col("gyradius"), 0.0, 100.0),
        "compactness": clip(F.col("compactness"), 0.0, 100.0),
        "signal_field_variance": clip(F.col("signal_variance"), 0.0, 100.0),
        "signal_mass_ratio": F.when(F.col("_s0") > 0, clip(F.col("signal_total") / F.col("_s0"), 0.0, 100.0)).otherwise(0.0),
        "dominant_channel_fraction": F.when(total > 0, F.array_max("channels") / total).otherwise(1.0 / F.greatest(F.size("channels"), F.lit(1))),
    }
    out = late.join(early, "seed", "left").join(final.join(first, "seed").select("seed", *[row[d.key].alias(d.key) for d in found if d.key in row]), "seed", "left")
    more = field_values(final, world, [d.key for d in found if d.source == FIELD])
    if more is not None:
        out = out.join(more, "seed", "left")
    drift = F.greatest(F.lit(0.0), F.lit(0.0), *[F.coalesce(F.abs(F.col(n) - F.col(f"{n}_before")), F.lit(0.0)) for n in moving])
    return out.select("seed", *[F.coalesce(F.col(d.key), F.lit(0.0)).alias(f"d{i}") for i, d in enumerate(found)], "n_steps", drift.alias("drift"))
