"""Mass-conserving continuous cellular automata, run inside Arrow map functions.

The grid numerics are numpy: ring kernels applied by FFT, growth, flow along
gradients, and transport that deposits every cell's box on the cells below it.
One task runs whole rollouts; a step is never a Spark job.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.functions import params as P
from tessella.operators.spawn import positions
from tessella.session import ship

#: Offset and slope of the kernel's radius and cut, and the flow's limits.
RADIUS_OFFSET, CUT_SLOPE, MAX_RATE = 15.0, 10.0, 0.1


@dataclass(frozen=True)
class World:
    """Grid and integration settings."""

    height: int = 96
    width: int = 96
    steps: int = 200
    kernels: int = 10
    border: str = "wall"
    reach: int = 5
    dt: float = 0.2
    sigma: float = 0.65

    def __post_init__(self) -> None:
        if min(self.height, self.width, self.steps, self.kernels) < 1 or self.border not in ("wall", "torus"):
            raise ValueError(f"not a world: {self}")


#: Fixed presets: grid side and steps, without and with a signal field.
PRESETS = {"dev": (96, 200, 300), "standard": (192, 500, 800), "pretty": (384, 500, 800)}


def preset(name: str, signal: bool = False, **changes) -> World:
    side, steps, signal_steps = PRESETS[name]
    return replace(World(side, side, signal_steps if signal else steps), **changes)


def rings(world: World, scale: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Normalised kernels in Fourier space: three Gaussian rings inside a soft disk, one for each scale."""
    y = np.arange(world.height) - world.height // 2
    x = np.arange(world.width) - world.width // 2
    distance = np.hypot(y[:, None], x[None, :])[None] / scale[:, None, None]
    disk = 1.0 / (1.0 + np.exp(np.minimum((distance - 1.0) * CUT_SLOPE, 500.0)))
    waves = (b[:, None, None, :] * np.exp(-((distance[..., None] - a[:, None, None, :]) ** 2) / w[:, None, None, :])).sum(axis=-1)
    kernel = disk * waves
    kernel /= kernel.sum(axis=(1, 2), keepdims=True)
    return np.fft.rfft2(np.roll(kernel, (-(world.height // 2), -(world.width // 2)), axis=(1, 2)))


class Species:
    """Kernels and growth of one parameter record, with its signal couplings if it has any."""

    def __init__(self, record: dict, world: World):
        v = {k: np.asarray(x, float) for k, x in record.items() if x is not None}
        scale = (v["radius"] + RADIUS_OFFSET) * v["r"]
        self.world, self.spectrum = world, rings(world, scale, v["a"], v["b"], v["w"])
        self.m, self.s, self.h = (v[c][:, None, None] for c in "msh")
        self.signal = v if "emission_vector" in v else None
        if self.signal:
            self.signal_spectrum = rings(world, (v["radius"] + RADIUS_OFFSET) * v["signal_kernel_r"].reshape(1), v["signal_kernel_a"][None], v["signal_kernel_b"][None], v["signal_kernel_w"][None])[0]

    def growth(self, mass_spectrum: np.ndarray) -> np.ndarray:
        u = np.fft.irfft2(self.spectrum * mass_spectrum[None], s=(self.world.height, self.world.width))
        return ((2.0 * np.exp(-(((u - self.m) / self.s) ** 2) / 2.0) - 1.0) * self.h).sum(axis=0)

    def response(self, signal: np.ndarray) -> np.ndarray:
        """What the receptors read of the blurred signal field (channels, h, w)."""
        blurred = np.fft.irfft2(self.signal_spectrum[None] * np.fft.rfft2(signal), s=signal.shape[1:])
        return np.tensordot(self.signal["receptor_profile"], blurred, 1)

    def rate(self, response: np.ndarray) -> float:
        beta = float(self.signal["beta_modulation"])
        base = float(self.signal["emission_rate"])
        return float(np.clip(base * (1.0 + beta * response.mean()), 0.0, MAX_RATE)) if beta else base


def gradient(f: np.ndarray, border: str) -> tuple[np.ndarray, np.ndarray]:
    """Sobel slopes along y and x of one field or a stack of them; outside a wall there is zero."""
    p = np.zeros((*f.shape[:-2], f.shape[-2] + 2, f.shape[-1] + 2), f.dtype)
    p[..., 1:-1, 1:-1] = f
    if border == "torus":
        p[..., 0, 1:-1], p[..., -1, 1:-1] = f[..., -1, :], f[..., 0, :]
        p[..., 0], p[..., -1] = p[..., -2], p[..., 1]
    down, right = p[..., 2:, :] - p[..., :-2, :], p[..., :, 2:] - p[..., :, :-2]
    return down[..., :-2] + 2 * down[..., 1:-1] + down[..., 2:], right[..., :-2, :] + 2 * right[..., 1:-1, :] + right[..., 2:, :]


def transport(world: World, fields: np.ndarray, fy: np.ndarray, fx: np.ndarray) -> np.ndarray:
    """Each cell's content, spread over a box of half-width sigma about where the flow takes it.

    ``fields`` is (n, h, w), or (n, lanes, h, w) with a flow (lanes, h, w) for
    each lane. A box meets a bounded number of cells on each axis, so the content
    is deposited on those alone, weighted by overlap.
    """
    h, w, s = world.height, world.width, world.sigma
    if fy.ndim == 2:
        return transport(world, fields[:, None], fy[None], fx[None])[:, 0]
    most = world.reach - s
    target, spans = [], []
    for flow, size, axis in ((fy, h, 0), (fx, w, 1)):
        at = np.arange(size) + 0.5
        at = (at[:, None] if axis == 0 else at[None, :]) + np.minimum(np.maximum(world.dt * flow, -most), most)
        at = np.mod(at, size) if world.border == "torus" else np.minimum(np.maximum(at, s), size - s)
        first = np.floor(at - s).astype(int)
        n = int(np.floor(2 * s)) + 2
        cells = first[None] + np.arange(n)[:, None, None, None]
        overlap = np.maximum(np.minimum(at[None] + s, cells + 1.0) - np.maximum(at[None] - s, cells), 0.0) / (2 * s)
        spans.append(overlap)
        target.append(np.mod(cells, size) if world.border == "torus" else np.minimum(np.maximum(cells, 0), size - 1))
    target[0] = target[0] * w + (np.arange(len(fy)) * (h * w))[:, None, None]
    out = np.zeros((len(fields), fy.size))
    for i in range(len(spans[0])):
        for j in range(len(spans[1])):
            share = spans[0][i] * spans[1][j]
            cell = (target[0][i] + target[1][j]).ravel()
            for k, f in enumerate(fields):
                out[k] += np.bincount(cell, weights=(f * share).ravel(), minlength=fy.size)
    return out.reshape(fields.shape)


@dataclass
class State:
    mass: np.ndarray
    owned: np.ndarray | None = None
    signal: np.ndarray | None = None
    growth: list | None = None
    #: Of each species in this step: the sum that it emitted, and that its receptors read.
    emitted: list | None = None
    heard: list | None = None


def step(world: World, species: list[Species], now: State) -> State:
    """One step of one or more species on shared mass and signal.

    Mass moves up the growth gradient and away from crowding. With several
    species growth is blended by ownership (evenly in empty cells), and
    ownership moves with the mass. Emission drains the emitter's mass.
    """
    mass, signal = now.mass, now.signal
    spectrum = np.fft.rfft2(mass)
    n = len(species)
    owned = now.owned
    if owned is None:
        shares = np.ones((1, *mass.shape))
    else:
        total = owned.sum(axis=0)
        shares = np.where(total < 1e-8, 1.0 / n, owned)
    blend, emitted, growth = np.zeros_like(mass), np.zeros_like(mass), []
    sent, read = [0.0] * n, [0.0] * n
    added = None if signal is None else np.zeros_like(signal)
    for k, one in enumerate(species):
        g = one.growth(spectrum)
        if signal is not None and one.signal is not None:
            heard = one.response(signal)
            g = g * np.maximum(1.0 + float(one.signal["alpha_coupling"]) * heard, 0.0)
            out = np.minimum(np.maximum(g, 0.0) * shares[k] * one.rate(heard), np.maximum(mass, 0.0) * shares[k])
            added += one.signal["emission_vector"][:, None, None] * out[None]
            emitted += out
            sent[k], read[k] = float(out.sum()), float(heard.sum())
        growth.append(g)
        blend += shares[k] * g
    mass = mass - emitted
    uy, ux = gradient(blend, world.border)
    ay, ax = gradient(mass, world.border)
    crowd = np.clip(mass * mass, 0.0, 1.0)
    fy, fx = uy * (1 - crowd) - ay * crowd, ux * (1 - crowd) - ax * crowd
    if owned is None:
        moved, owned = transport(world, mass[None], fy, fx)[0], None
    else:
        parts = transport(world, np.concatenate([mass[None], owned * mass[None]]), fy, fx)
        moved = parts[0]
        owned = np.where(moved > 1e-8, parts[1:] / np.maximum(moved, 1e-8), 0.0)
        sums = owned.sum(axis=0)
        owned = np.where(sums > 0, owned / np.maximum(sums, 1e-12), 0.0)
    if signal is not None:
        decay = next((one.signal["decay_rates"] for one in species if one.signal is not None), np.zeros(len(signal)))
        signal = (signal + added) * (1.0 - decay[:, None, None])
    return State(moved, owned, signal, growth, sent, read)


def first_mass(world: World, seed: int, fraction: int = 3) -> np.ndarray:
    """A square patch of uniform noise in the middle of an empty grid."""
    side = min(world.height, world.width) // fraction
    mass = np.zeros((world.height, world.width))
    y, x = (world.height - side) // 2, (world.width - side) // 2
    mass[y : y + side, x : x + side] = np.random.default_rng(seed).random((side, side, 1), dtype=np.float32)[..., 0]
    return mass


def first_signal(world: World, seed: int, level: float = 0.01, cut: float = 0.2) -> np.ndarray:
    """Low-passed noise in every channel, clipped at zero, of a given mean size."""
    rng = np.random.default_rng(seed)
    noise = np.fft.rfft2(rng.normal(size=(P.CHANNELS, world.height, world.width)))
    fy, fx = np.fft.fftfreq(world.height), np.fft.rfftfreq(world.width)
    noise *= np.hypot(fy[:, None], fx[None, :]) < cut
    field = np.fft.irfft2(noise, s=(world.height, world.width))
    return np.maximum(field * level / np.maximum(np.abs(field).mean(axis=(1, 2), keepdims=True), 1e-12), 0.0)


def measures(mass: np.ndarray) -> tuple[float, float, float, float, float, float]:
    """mass, centre (y, x), bounding-box share, gyradius and compactness (mass inside the box) of a field."""
    total = float(mass.sum())
    h, w = mass.shape
    if total <= 0 or not np.isfinite(total):
        return total, float("nan"), float("nan"), 0.0, 0.0, 0.0
    y, x = np.arange(h), np.arange(w)
    rows, cols = mass.sum(axis=1), mass.sum(axis=0)
    cy, cx = float(rows @ y) / total, float(cols @ x) / total
    lit = mass > 0.1 * mass.max()
    ys, xs = np.flatnonzero(lit.any(axis=1)), np.flatnonzero(lit.any(axis=0))
    box = (ys[-1] - ys[0] + 1) * (xs[-1] - xs[0] + 1) / (h * w)
    spread = float(rows @ (y - cy) ** 2 + cols @ (x - cx) ** 2) / total
    inside = float(mass[ys[0] : ys[-1] + 1, xs[0] : xs[-1] + 1].sum())
    return total, cy, cx, float(box), float(np.sqrt(max(spread, 0.0))), inside / total


class Lanes:
    """Kernels and couplings of several records, stacked along a leading axis, for one species a world."""

    def __init__(self, records: list[dict], world: World):
        kinds = [Species(r, world) for r in records]
        self.world = world
        self.spectrum = np.stack([k.spectrum for k in kinds])
        self.m, self.s, self.h = (np.stack([getattr(k, c) for k in kinds]) for c in "msh")
        self.signal = any(k.signal for k in kinds)
        if self.signal:
            # a record without signals gets zeros and couples to nothing
            of = lambda name, shape: np.stack([k.signal[name].reshape(shape) if k.signal else np.zeros(shape) for k in kinds])
            self.emission, self.receptor, self.decay = (of(c, P.CHANNELS) for c in ("emission_vector", "receptor_profile", "decay_rates"))
            self.alpha, self.beta, self.base = (of(c, ()) for c in ("alpha_coupling", "beta_modulation", "emission_rate"))
            self.signal_spectrum = np.stack([k.signal_spectrum if k.signal else np.zeros_like(k.spectrum[0]) for k in kinds])

    def step(self, mass: np.ndarray, signal: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
        """One step of every lane: (lanes, h, w) masses and (lanes, channels, h, w) signals."""
        size = (self.world.height, self.world.width)
        u = np.fft.irfft2(self.spectrum * np.fft.rfft2(mass)[:, None], s=size)
        g = ((2.0 * np.exp(-(((u - self.m) / self.s) ** 2) / 2.0) - 1.0) * self.h).sum(axis=1)
        if signal is not None and self.signal:
            blurred = np.fft.irfft2(self.signal_spectrum[:, None] * np.fft.rfft2(signal), s=size)
            heard = np.einsum("lc,lchw->lhw", self.receptor, blurred)
            g = g * np.maximum(1.0 + self.alpha[:, None, None] * heard, 0.0)
            rate = np.where(self.beta != 0, np.clip(self.base * (1.0 + self.beta * heard.mean(axis=(1, 2))), 0.0, MAX_RATE), self.base)
            out = np.minimum(np.maximum(g, 0.0) * rate[:, None, None], np.maximum(mass, 0.0))
            signal = (signal + self.emission[:, :, None, None] * out[:, None]) * (1.0 - self.decay[:, :, None, None])
            mass = mass - out
        uy, ux = gradient(g, self.world.border)
        ay, ax = gradient(mass, self.world.border)
        crowd = np.clip(mass * mass, 0.0, 1.0)
        moved = transport(self.world, mass[None], uy * (1 - crowd) - ay * crowd, ux * (1 - crowd) - ax * crowd)[0]
        return moved, signal


def signal_batch(world: World, seeds: list[int]) -> np.ndarray:
    """first_signal() of each seed, stacked."""
    return np.stack([first_signal(world, s) for s in seeds])


TRACE = "seed long, step int, mass double, com_y double, com_x double, bbox double, gyradius double, compactness double, signal_total double"
FINAL = "field array<double>, middle array<double>, channels array<double>, signal_variance double"


def rollouts(records: DataFrame, world: World, signal: bool = False, *, lanes: int = 1, capture: bool = False) -> DataFrame:
    """Trace rows of every parameter record (seed, parameters).

    A task runs ``lanes`` rollouts at a time, stacked. With ``capture``, rows of
    the last step also have its mass field and that of the middle of the rollout,
    row by row, the sums of the signal's channels, and the variance of the signal
    over space; other rows have nulls.
    """
    ship(records.sparkSession)
    names = [n for n, *_ in P.fields(signal)]
    columns = [c.split()[0] for c in f"{TRACE}, {FINAL}".split(", ")]

    def trace(group: list[dict]) -> pa.RecordBatch:
        seeds = [r["seed"] for r in group]
        kinds = Lanes([{n: r[n] for n in names} for r in group], world)
        mass = np.stack([first_mass(world, s) for s in seeds])
        field = signal_batch(world, seeds) if signal else None
        rows, middle = [], mass
        for t in range(world.steps + 1):
            if t:
                mass, field = kinds.step(mass, field)
            if t == world.steps // 2:
                middle = mass
            for k, s in enumerate(seeds):
                last = (None,) * 4
                if capture and t == world.steps:
                    last = (mass[k].ravel().tolist(), middle[k].ravel().tolist(), field[k].sum(axis=(1, 2)).tolist() if signal else None, float(field[k].sum(axis=0).var()) if signal else None)
                rows.append((s, t, *measures(mass[k]), float(field[k].sum()) if signal else 0.0, *last))
        cols = dict(zip(columns, map(list, zip(*rows, strict=True)), strict=True))
        return pa.RecordBatch.from_pydict({c: pa.array(cols[c], t) for c, t in TYPES.items() if capture or c in TRACE})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = b.to_pylist()
            for k in range(0, len(held), lanes):
                yield trace(held[k : k + lanes])

    return records.select("seed", *names).mapInArrow(run, f"{TRACE}, {FINAL}" if capture else TRACE)


TYPES = {"seed": pa.int64(), "step": pa.int32(), **dict.fromkeys(("mass", "com_y", "com_x", "bbox", "gyradius", "compactness", "signal_total"), pa.float64()), "field": pa.list_(pa.float64()), "middle": pa.list_(pa.float64()), "channels": pa.list_(pa.float64()), "signal_variance": pa.float64()}


ECOSYSTEM = "name string, step int, snap int, species int, y int, x int, w double, m double, g double"
HISTORY = "name string, step int, species int, mass double, territory double, signal_total double, emitted double, received double"
SIGNAL = "name string, step int, snap int, species int, channel int, mean double, received double"
TRAJECTORY = "name string, step int, snap int, y int, x int, m double"


def evolve(pdf: pd.DataFrame, world: World, names: list[str], signal: bool) -> Iterator[tuple[int, int | None, State]]:
    """(step, number of the snapshot or None, state) of one experiment's rows, from step 0 on."""
    kinds = [Species({n: (np.stack([np.asarray(v, float) for v in row[n]]) if n in ("a", "b", "w") else row[n]) for n in names}, world) for row in pdf.to_dict("records")]
    first = pdf.iloc[0]
    counts = [int(n) for n in pdf["n"]]
    patch = int(pdf["patch"].max())
    centres = positions(sum(counts), world.height, world.width, gap=float(first["min_dist"]), patch=patch, seed=int(first["seed"]))
    mass = np.zeros((world.height, world.width))
    owned = np.zeros((len(kinds), world.height, world.width))
    who = np.repeat(np.arange(len(kinds)), counts)
    for i, ((y, x), k) in enumerate(zip(centres, who, strict=True)):
        half = int(pdf["patch"].iloc[k]) // 2
        at = np.s_[max(y - half, 0) : y + half, max(x - half, 0) : x + half]
        mass[at] = np.random.default_rng(int(first["seed"]) + 1000 + i).random(mass[at].shape)
        owned[:, at[0], at[1]] = 0.0
        owned[k, at[0], at[1]] = 1.0
    none = [0.0] * len(kinds)
    now = State(mass, owned, first_signal(world, int(first["seed"])) if signal else None, None, none, none)
    every, snap = int(first["snapshot_every"]), 0
    yield 0, None, now
    for t in range(1, world.steps + 1):
        now = step(world, kinds, now)
        if t % every == 0 or t == world.steps:
            yield t, snap, now
            snap += 1
        else:
            yield t, None, now


def per_experiment(experiments: DataFrame, world: World, signal: bool, schema: str, rows) -> DataFrame:
    """``rows(name, species numbers, step, snap, state)`` of each experiment's steps, as a table.

    ``experiments`` has one row per species: name, species, n, patch, min_dist,
    seed, snapshot_every and its parameters.
    """
    ship(experiments.sparkSession)
    names = [n for n, *_ in P.fields(signal)]
    columns = [c.split()[0] for c in schema.split(", ")]
    whole = {c.split()[0]: "int32" for c in schema.split(", ") if c.endswith(" int")}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("species").reset_index(drop=True)
        numbers = [int(k) for k in pdf["species"]]
        parts = [r for t, snap, now in evolve(pdf, world, names, signal) for r in rows(pdf["name"].iloc[0], numbers, t, snap, now)]
        return pd.concat(parts or [pd.DataFrame(columns=columns)])[columns].astype(whole)

    return experiments.groupBy("name").applyInPandas(run, schema)


def ecosystems(experiments: DataFrame, world: World, signal: bool = False) -> DataFrame:
    """Ownership and growth in long form, at the snapshots of every experiment; empty cells are left out."""

    def rows(name, numbers, t, snap, now) -> list[pd.DataFrame]:
        if snap is None:
            return []
        y, x = np.nonzero(now.mass > 1e-8)
        return [pd.DataFrame({"name": name, "step": t, "snap": snap, "species": k, "y": y, "x": x, "w": now.owned[i, y, x], "m": now.mass[y, x], "g": now.growth[i][y, x]}) for i, k in enumerate(numbers)]

    return per_experiment(experiments, world, signal, ECOSYSTEM, rows)


def ecosystem_histories(experiments: DataFrame, world: World, signal: bool = False) -> DataFrame:
    """Every step's mass, territory, emission and reception of each species, and the signal's total (0 without a signal)."""

    def rows(name, numbers, t, snap, now) -> list[pd.DataFrame]:
        held = (now.owned * now.mass[None]).sum(axis=(1, 2))
        return [pd.DataFrame({"name": name, "step": t, "species": numbers, "mass": held, "territory": now.owned.sum(axis=(1, 2)), "signal_total": float(now.signal.sum()) if signal else 0.0, "emitted": now.emitted, "received": now.heard})]

    return per_experiment(experiments, world, signal, HISTORY, rows)


def ecosystem_signals(experiments: DataFrame, world: World, received: float = 0.1) -> DataFrame:
    """At each snapshot, the mean of each channel over space, and over the cells of which a species owns more than ``received`` (0 where it has none)."""

    def rows(name, numbers, t, snap, now) -> list[pd.DataFrame]:
        if snap is None:
            return []
        mean, out = now.signal.mean(axis=(1, 2)), []
        for i, k in enumerate(numbers):
            mine = now.owned[i] > received
            heard = now.signal[:, mine].mean(axis=1) if mine.any() else np.zeros(len(mean))
            out.append(pd.DataFrame({"name": name, "step": t, "snap": snap, "species": k, "channel": np.arange(len(mean)), "mean": mean, "received": heard}))
        return out

    return per_experiment(experiments, world, True, SIGNAL, rows)


def trajectories(experiments: DataFrame, world: World, signal: bool = False) -> DataFrame:
    """Mass of every cell that has any, at each snapshot: the long form of a trajectory array."""

    def rows(name, numbers, t, snap, now) -> list[pd.DataFrame]:
        if snap is None:
            return []
        y, x = np.nonzero(now.mass > 1e-8)
        return [pd.DataFrame({"name": name, "step": t, "snap": snap, "y": y, "x": x, "m": now.mass[y, x]})]

    return per_experiment(experiments, world, signal, TRAJECTORY, rows)


def world_of(record: dict, height: int, width: int, steps: int, border: str) -> World:
    """The world of an experiment: as many kernels as its first creature has."""
    return World(height, width, steps, len(record["r"]), border)
