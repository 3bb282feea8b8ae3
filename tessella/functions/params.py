"""Parameter records: specifications, uniform prior, Gaussian mutation, range checks.

Drawing uses numpy's seeded generator inside Arrow batches, so a record is the
same for a seed on any worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.vectors import within, within_nested
from tessella.session import ship

CHANNELS = 16
CALIBRATION_BASE = 10_000_000

# Fixed values (the radius is called R elsewhere; column names ignore case): name, shape (scalar, k kernels, k x 3, channels, 3), low, high, sigma.
MASS_SPECS = (
    ("radius", "scalar", 2.0, 25.0, 2.3),
    ("r", "k", 0.2, 1.0, 0.08),
    ("m", "k", 0.05, 0.5, 0.045),
    ("s", "k", 0.001, 0.18, 0.0179),
    ("h", "k", 0.01, 1.0, 0.099),
    ("a", "k3", 0.0, 1.0, 0.1),
    ("b", "k3", 0.001, 1.0, 0.0999),
    ("w", "k3", 0.01, 0.5, 0.049),
)
SIGNAL_SPECS = (
    ("emission_vector", "c", 0.0, 1.0, 0.1),
    ("receptor_profile", "c", -1.0, 1.0, 0.2),
    ("emission_rate", "scalar", 0.0001, 0.01, 0.001),
    ("decay_rates", "c", 0.0, 0.9, 0.05),
    ("alpha_coupling", "scalar", -1.0, 1.0, 0.15),
    ("beta_modulation", "scalar", -1.0, 1.0, 0.15),
    ("signal_kernel_r", "scalar", 0.2, 1.0, 0.08),
    ("signal_kernel_a", "3", 0.0, 1.0, 0.1),
    ("signal_kernel_b", "3", 0.001, 1.0, 0.0999),
    ("signal_kernel_w", "3", 0.01, 0.5, 0.049),
)
KIND = {"scalar": "double", "k": "array<double>", "c": "array<double>", "3": "array<double>", "k3": "array<array<double>>"}


def fields(signal: bool) -> tuple:
    return MASS_SPECS + (SIGNAL_SPECS if signal else ())


def schema(signal: bool) -> str:
    return ", ".join(f"{n} {KIND[s]}" for n, s, *_ in fields(signal))


def spec_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*MASS_SPECS, *SIGNAL_SPECS], "name string, shape string, low double, high double, sigma double")


def size_of(shape: str, kernels: int):
    return {"scalar": None, "k": kernels, "k3": (kernels, 3), "c": CHANNELS, "3": 3}[shape]


def draw(seed: int, kernels: int, signal: bool) -> dict:
    """Uniform in every range, in the order of the specifications."""
    rng = np.random.default_rng(seed)
    out = {}
    for name, shape, low, high, _ in fields(signal):
        v = rng.uniform(low, high, size=size_of(shape, kernels))
        out[name] = float(v) if shape == "scalar" else v.tolist()
    return out


def mutated(parent: dict, seed: int) -> dict:
    """parent plus Gaussian noise of each field's sigma, clipped to its range."""
    rng = np.random.default_rng(seed)
    out = {}
    for name, shape, low, high, sigma in fields("emission_vector" in parent):
        v = np.asarray(parent[name], float)
        v = np.clip(v + rng.normal(0.0, sigma, size=v.shape or None), low, high)
        out[name] = float(v) if shape == "scalar" else v.tolist()
    return out


def counts(kernels: int, signal: bool) -> list[int]:
    """Numbers that each field of a record has."""
    return [int(np.prod(size_of(shape, kernels) or 1)) for _, shape, *_ in fields(signal)]


def arrow_record(seeds: pa.Array, flat: list[np.ndarray], kernels: int, signal: bool) -> dict[str, pa.Array]:
    """Columns of a batch, of one (records, numbers) matrix for each field."""
    out, n = {"seed": seeds}, len(seeds)
    for (name, shape, *_), v in zip(fields(signal), flat, strict=True):
        column = pa.array(np.ascontiguousarray(v).ravel(), pa.float64())
        if shape == "k3":
            column = pa.ListArray.from_arrays(pa.array(np.arange(0, n * kernels * 3 + 1, 3, dtype=np.int32)), column)
        if shape != "scalar":
            many = size_of(shape, kernels)
            many = many[0] if shape == "k3" else many
            column = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * many), column)
        out[name] = column
    return out


def drawn(seeds: list[int], kernels: int, signal: bool) -> list[np.ndarray]:
    """draw() of each seed, a (records, numbers) matrix for each field: one call of the generator for a record."""
    size = counts(kernels, signal)
    whole = np.empty((len(seeds), sum(size)))
    for row, s in zip(whole, seeds, strict=True):
        np.random.default_rng(s).random(out=row)
    return [low + (high - low) * v for (_, _, low, high, _), v in zip(fields(signal), np.split(whole, np.cumsum(size)[:-1], axis=1), strict=True)]


def noised(parents: list[np.ndarray], seeds: list[int], signal: bool) -> list[np.ndarray]:
    """mutated() of each parent, where all have as many numbers."""
    size = [v.shape[1] for v in parents]
    whole = np.empty((len(seeds), sum(size)))
    for row, s in zip(whole, seeds, strict=True):
        np.random.default_rng(s).standard_normal(out=row)
    return [np.clip(v + sigma * z, low, high) for (_, _, low, high, sigma), v, z in zip(fields(signal), parents, np.split(whole, np.cumsum(size)[:-1], axis=1), strict=True)]


def flat_fields(b: pa.RecordBatch, signal: bool) -> tuple[list[np.ndarray], int] | None:
    """(a matrix for each field, kernels) of a batch's records; None if they differ in size or lack a number."""
    out, kernels = [], -1
    for name, shape, *_ in fields(signal):
        column = b.column(name)
        if shape != "scalar":
            if column.null_count or not len(column):
                return None
            length = column.value_lengths().to_numpy()
            if (length != length[0]).any() or shape in ("k", "k3") and kernels not in (-1, length[0]):
                return None
            kernels, column = int(length[0]) if shape in ("k", "k3") else kernels, column.flatten()
        if shape == "k3":
            if column.null_count or (column.value_lengths().to_numpy() != 3).any():
                return None
            column = column.flatten()
        if column.null_count or len(column) % b.num_rows:
            return None
        out.append(column.to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
    want = counts(kernels, signal)
    return (out, kernels) if [v.shape[1] for v in out] == want else None


def seeds(spark: SparkSession, base: int, n: int, calibration: bool = False) -> DataFrame:
    start = CALIBRATION_BASE + base if calibration else base
    return spark.range(start, start + n).withColumnRenamed("id", "seed")


def population(seed_rows: DataFrame, kernels: int = 10, signal: bool = False) -> DataFrame:
    """(seed, parameters) drawn from the prior for each seed."""
    ship(seed_rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = arrow_record(b.column(0), drawn(b.column(0).to_pylist(), kernels, signal), kernels, signal)
            yield pa.RecordBatch.from_pydict(columns, arrow_schema(signal))

    return seed_rows.select(F.col("seed").cast("long")).mapInArrow(run, f"seed long, {schema(signal)}")


def arrow_schema(signal: bool) -> pa.Schema:
    kind = {"double": pa.float64(), "array<double>": pa.list_(pa.float64()), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}
    return pa.schema([("seed", pa.int64()), *[(n, kind[KIND[s]]) for n, s, *_ in fields(signal)]])


def mutate(parents: DataFrame, signal: bool = False, before: tuple[str, ...] = ()) -> DataFrame:
    """(seed, parameters) of a child for each row (seed, parent's parameters); ``before`` are fields of the parent to keep, as <name>_before."""
    ship(parents.sparkSession)
    names = [n for n, *_ in fields(signal)]
    kept = {f"{n}_before": n for n in before}
    whole = arrow_schema(signal)
    for c, n in kept.items():
        whole = whole.append(pa.field(c, whole.field(n).type))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if found := flat_fields(b, signal):
                columns = arrow_record(b.column("seed"), noised(found[0], b.column("seed").to_pylist(), signal), found[1], signal)
            else:
                rows = [{"seed": r["seed"]} | mutated({n: r[n] for n in names}, r["seed"]) for r in b.to_pylist()]
                made = pa.RecordBatch.from_pylist(rows, arrow_schema(signal))
                columns = dict(zip(made.schema.names, made.columns, strict=True))
            yield pa.RecordBatch.from_pydict(columns | {c: b.column(n).cast(whole.field(c).type) for c, n in kept.items()}, whole)

    kinds = {n: KIND[shape] for n, shape, *_ in fields(signal)}
    return parents.select(F.col("seed").cast("long"), *names).mapInArrow(run, f"seed long, {schema(signal)}" + "".join(f", {c} {kinds[n]}" for c, n in kept.items()))


def in_range(signal: bool = False) -> Column:
    """Every element of every parameter lies in its range."""
    ok = F.lit(True)
    for name, shape, low, high, _ in fields(signal):
        c = F.col(name)
        ok = ok & (c.between(low, high) if shape == "scalar" else within_nested(c, low, high) if shape == "k3" else within(c, low, high))
    return ok
