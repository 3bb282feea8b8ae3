"""Pairs of creatures by blocks: a row holds some thousand creatures, a task scores two rows' pairs tile by tile.

Products come from matrix multiplication. Where one lies within its error of a
threshold, or a bound of the score reaches the best so far, the pair is
calculated again in the order of the channels, so results are those of the
pair's own expressions. Null components are left out of sums, as SQL does; a sum
of nulls alone is null, and so is its score. NaN is greater than all numbers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessella.sources.tables import stage

REPULSION, COMPETITION, PURSUIT, BLIND = "repulsion", "competition", "pursuit", "blind"
MODES = (BLIND, REPULSION, COMPETITION, PURSUIT)
#: Weights of distance and of mean quality in a score.
FAR, GOOD = 0.3, 0.5
#: Creatures of a block, at least and at most, and so many blocks while they are not larger than that.
ROWS, MOST_ROWS, BLOCKS = 4096, 32768, 48
#: Pairs of a tile; its few arrays stay in a core's cache.
TILE = (64, 1024)


def pack(rows: DataFrame) -> DataFrame:
    """One row a block: its number, and each column of ``rows`` as an array. Written once, so that both sides see the same blocks."""
    n = rows.count()
    blocks = max(1, min(math.ceil(n / ROWS), BLOCKS), math.ceil(n / MOST_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        whole = [b for b in batches if b.num_rows]
        if whole:
            table = pa.Table.from_batches(whole).combine_chunks()
            ends = pa.array([0, table.num_rows], pa.int32())
            columns = {c: pa.ListArray.from_arrays(ends, table.column(c).chunk(0)) for c in table.column_names}
            yield pa.RecordBatch.from_pydict({"block": pa.array([TaskContext.get().partitionId()], pa.int64())} | columns)

    schema = T.StructType([T.StructField("block", T.LongType()), *[T.StructField(f.name, T.ArrayType(f.dataType)) for f in rows.schema]])
    return stage(rows.repartition(blocks).mapInArrow(run, schema), "creature_blocks")


class Matrix:
    """Arrays of numbers as a matrix: zero where there is none, with ``valid`` unless all are there; ``size`` is -1 of a null array."""

    def __init__(self, lists: pa.ListArray):
        self.size = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
        flat, n = lists.flatten(), len(lists)
        width = max(int(self.size.max()), 0)
        if not flat.null_count and (self.size == width).all():
            self.values, self.valid = np.ascontiguousarray(flat.to_numpy(zero_copy_only=False).reshape(n, width)), None
        else:
            length = np.maximum(self.size, 0)
            row = np.repeat(np.arange(n), length)
            at = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
            self.values, self.valid = np.zeros((n, width)), np.zeros((n, width), bool)
            self.values[row, at] = flat.fill_null(0.0).to_numpy(zero_copy_only=False)
            self.valid[row, at] = flat.is_valid().to_numpy(zero_copy_only=False)
        self.plain = self.valid is None and bool((np.abs(self.values) < 1e100).all())
        self.columns = np.ascontiguousarray(self.values.T)
        self.norm = float(np.sqrt((self.values * self.values).sum(axis=1).max())) if self.plain else math.inf

    def there(self, c: int, rows: np.ndarray) -> np.ndarray:
        if c >= len(self.columns):
            return np.zeros(len(rows), bool)
        return np.ones(len(rows), bool) if self.valid is None else self.valid[rows, c]


class Side:
    """One block's creatures."""

    def __init__(self, row: dict[str, pa.Array], key: str, cross: str | None = None):
        self.ids = row[key].to_numpy(zero_copy_only=False)
        self.runs = row[cross].to_numpy(zero_copy_only=False) if cross else None
        self.emission, self.receptor, self.d = (Matrix(row[c]) for c in ("emission", "receptor", "d"))
        self.quality = row["quality"].to_numpy(zero_copy_only=False)
        self.plain = self.emission.plain and self.receptor.plain and self.d.plain and bool(np.isfinite(self.quality).all())


def summed(x: Matrix, y: Matrix, i: np.ndarray, j: np.ndarray, term: Callable) -> np.ndarray:
    """Sums of ``term`` over the channels of rows i and j, in their order; -inf stands for null."""
    out = np.zeros(len(i))
    if x.valid is None and y.valid is None and len(x.columns) == len(y.columns):
        for a, b in zip(x.columns, y.columns, strict=True):
            out += term(a[i], b[j])
        return out
    some = np.zeros(len(i), bool)
    for c in range(min(len(x.columns), len(y.columns))):
        both = x.there(c, i) & y.there(c, j)
        out += np.where(both, term(x.columns[c][i], y.columns[c][j]), 0.0)
        some |= both
    return np.where(some, out, -np.inf)


def product(x: Matrix, y: Matrix, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(product, whether it is null); 0 where the lengths differ or an array is null."""
    out = summed(x, y, i, j, np.multiply)
    alike = (x.size[i] == y.size[j]) & (x.size[i] > 0)
    none = alike & np.isneginf(out) & ((x.valid is not None) | (y.valid is not None))
    if none.any():
        none[none] = [not any((x.there(c, i[[p]]) & y.there(c, j[[p]]))[0] for c in range(len(x.columns))) for p in np.flatnonzero(none)]
    return np.where(alike & ~none, out, 0.0), none


def exact(x: Side, y: Side, i: np.ndarray, j: np.ndarray) -> dict[str, np.ndarray]:
    """ab, ba, distance, avg_quality and score of creatures i of x and j of y; -inf is a null distance or score."""
    ab, no_ab = product(x.emission, y.receptor, i, j)
    ba, no_ba = product(y.emission, x.receptor, j, i)
    square = summed(x.d, y.d, i, j, lambda a, b: (a - b) * (a - b))
    apart = np.sqrt(np.where(np.isneginf(square), 0.0, square))
    mean = (x.quality[i] + y.quality[j]) / 2
    score = np.abs(ab) + np.abs(ba) + FAR * apart + GOOD * mean
    return {"ab": np.where(no_ab, -np.inf, ab), "ba": np.where(no_ba, -np.inf, ba), "distance": np.where(np.isneginf(square), -np.inf, apart), "avg_quality": mean, "score": np.where(no_ab | no_ba | np.isneginf(square), -np.inf, score), "_ab": ab, "_ba": ba}


def modes(ab: np.ndarray, ba: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which pairs are repulsion, competition and pursuit; all others are blind."""
    up_a, up_b, down_a, down_b = ~(ab <= t), ~(ba <= t), ab < -t, ba < -t
    return down_a & down_b, up_a & up_b, (up_a & down_b) | (down_a & up_b)


class Tile:
    """Products of some rows of x with some of y; ``keep`` is false at pairs that do not count, or None if all do."""

    def __init__(self, x: Side, y: Side, rows: slice, cols: slice, keep: np.ndarray | None):
        self.x, self.y, self.rows, self.cols, self.keep = x, y, rows, cols, keep
        self.shape = (rows.stop - rows.start, cols.stop - cols.start)

    def index(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, q = np.nonzero(found)
        return p + self.rows.start, q + self.cols.start


class Pairs:
    """The tiles of two blocks, or of one with itself."""

    def __init__(self, x: Side, y: Side, same: bool, t: float):
        self.x, self.y, self.same, self.t = x, y, same, t
        self.plain = x.plain and y.plain and x.emission.values.shape[1] == y.receptor.values.shape[1] and y.emission.values.shape[1] == x.receptor.values.shape[1] and x.d.values.shape[1] == y.d.values.shape[1]
        both = np.concatenate([x.ids, y.ids]) if not same else x.ids
        unique, self.codes = np.unique(both, return_inverse=True)
        self.repeated = len(unique) < len(both)
        if self.plain:
            self.error = 1e-15 * max(x.emission.values.shape[1], 1) * max(x.emission.norm * y.receptor.norm, y.emission.norm * x.receptor.norm)
            self.buffers = [np.empty(TILE[0] * TILE[1]) for _ in range(3)]
            square = [(one.d.values * one.d.values).sum(axis=1) for one in (x, y)]
            # squared distances as one product, raised by their error
            rise, ones = 1e-14 * (1e-290 + float(square[0].max() + square[1].max())), [np.ones(len(v)) for v in square]
            self.far = (np.column_stack([-2.0 * x.d.values, square[0], ones[0]]), np.ascontiguousarray(np.column_stack([y.d.values, ones[1], square[1] + rise]).T))
            self.slack = 4 * self.error + 1e-12 * (1.0 + float(np.sqrt(square[0].max()) + np.sqrt(square[1].max()) + np.abs(x.quality).max() + np.abs(y.quality).max()))
            self.part = (x.quality * (GOOD / 2), y.quality * (GOOD / 2))

    def __iter__(self) -> Iterator[Tile]:
        n, m = len(self.x.ids), len(self.y.ids)
        for top in range(0, n, TILE[0]):
            rows, left = slice(top, min(top + TILE[0], n)), 0
            while left < m:
                # the first tile is small: without a best so far, all its pairs are calculated again
                cols = slice(left, min(left + (TILE[1] if top or left else 128), m))
                left = cols.stop
                if self.same and cols.stop - 1 <= rows.start:
                    continue
                keep = None
                if self.same and cols.start < rows.stop:
                    keep = np.arange(cols.start, cols.stop)[None, :] > np.arange(rows.start, rows.stop)[:, None]
                if self.repeated:
                    others = self.codes[: len(self.x.ids)][rows][:, None] != self.codes[0 if self.same else len(self.x.ids) :][cols][None, :]
                    keep = others if keep is None else keep & others
                yield Tile(self.x, self.y, rows, cols, keep)

    def products(self, tile: Tile, settle: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(ab, ba, None) of a tile, settled at the threshold; of creatures with nulls or no numbers, with the scores."""
        x, y, size = self.x, self.y, tile.shape[0] * tile.shape[1]
        if not self.plain:
            i, j = (v.ravel() for v in np.meshgrid(np.arange(tile.rows.start, tile.rows.stop), np.arange(tile.cols.start, tile.cols.stop), indexing="ij"))
            with np.errstate(invalid="ignore", over="ignore"):
                whole = exact(x, y, i, j)
            return tuple(whole[c].reshape(tile.shape) for c in ("_ab", "_ba", "score"))
        ab, ba, near = (b[:size].reshape(tile.shape) for b in self.buffers)
        np.dot(x.emission.values[tile.rows], y.receptor.columns[:, tile.cols], out=ab)
        np.dot(x.receptor.values[tile.rows], y.emission.columns[:, tile.cols], out=ba)
        if settle:
            for v, one, other in ((ab, x.emission, y.receptor), (ba, x.receptor, y.emission)):
                np.abs(v, out=near)
                near -= self.t
                np.abs(near, out=near)
                if near.min(initial=math.inf) <= self.error:
                    at = near <= self.error
                    v[at] = summed(one, other, *tile.index(at), np.multiply)
        return ab, ba, None

    def bound(self, tile: Tile, ab: np.ndarray, ba: np.ndarray) -> np.ndarray:
        """No less than a pair's score, when the slack is added, and hardly more. Overwrites ab and ba."""
        out = self.buffers[2][: ab.size].reshape(ab.shape)
        np.abs(ab, out=out)
        np.abs(ba, out=ba)
        out += ba
        np.dot(self.far[0][tile.rows], self.far[1][:, tile.cols], out=ba)
        np.maximum(ba, 0.0, out=ba)
        np.sqrt(ba, out=ba)
        ba *= FAR
        out += ba
        out += self.part[0][tile.rows][:, None]
        out += self.part[1][tile.cols][None, :]
        return out


def sides(batches: Iterator[pa.RecordBatch], key: str, cross: str | None = None) -> Iterator[tuple[Side, Side, bool]]:
    names = [key, *([cross] if cross else []), "emission", "receptor", "d", "quality"]
    for b in batches:
        for k in range(b.num_rows):
            x, y = (Side({c: b.column(f"{c}_{side}")[k].values for c in names}, key, cross) for side in "ab")
            yield x, y, b.column("block_a")[k].as_py() == b.column("block_b")[k].as_py()


def counter(key: str, t: float) -> Callable:
    """A map over pairs of blocks to (mode, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = dict.fromkeys(MODES, 0)
        for x, y, same in sides(batches, key):
            whole = Pairs(x, y, same, t)
            for tile in whole:
                ab, ba, _ = whole.products(tile)
                rest = int(np.count_nonzero(tile.keep)) if tile.keep is not None else ab.size
                for name, at in zip(MODES[1:], modes(ab, ba, t), strict=True):
                    many = int(np.count_nonzero(at if tile.keep is None else at & tile.keep))
                    n[name] += many
                    rest -= many
                n[BLIND] += rest
        yield pa.RecordBatch.from_pydict({"mode": pa.array([m for m in MODES if n[m]], pa.string()), "n": pa.array([n[m] for m in MODES if n[m]], pa.int64())})

    return run


def best(key: str, k: int, t: float) -> Callable:
    """A map over pairs of blocks to the k best pairs of each mode that a task has met; ties by ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, least = None, dict.fromkeys(MODES, -math.inf)
        kind = None
        for b in batches:
            kind = b.schema.field(f"{key}_a").type.value_type
            for x, y, same in sides(iter([b]), key):
                whole = Pairs(x, y, same, t)
                for tile in whole:
                    ab, ba, score = whole.products(tile)
                    found = modes(ab, ba, t)
                    of = dict(zip(MODES, (~(found[0] | found[1] | found[2]), *found), strict=True))
                    high, slack = (whole.bound(tile, ab, ba), whole.slack) if score is None else (score, 0.0)
                    at = np.zeros(tile.shape, bool)
                    for m in MODES:
                        at |= of[m] & ~(high < least[m] - slack)
                    if tile.keep is not None:
                        at &= tile.keep
                    if not at.any():
                        continue
                    i, j = tile.index(at)
                    name = np.select([of[m][at] for m in MODES], MODES, "")
                    with np.errstate(invalid="ignore", over="ignore"):
                        v = exact(x, y, i, j)
                    good = ~(v["score"] < np.select([name == m for m in MODES], [least[m] for m in MODES]))
                    if not good.any():
                        continue
                    i, j = i[good], j[good]
                    swap = x.ids[i] > y.ids[j]
                    rows = pd.DataFrame({"a": np.where(swap, y.ids[j], x.ids[i]), "b": np.where(swap, x.ids[i], y.ids[j]), "mode": name[good], "ab": np.where(swap, v["ba"][good], v["ab"][good]), "ba": np.where(swap, v["ab"][good], v["ba"][good])} | {c: v[c][good] for c in ("distance", "avg_quality", "score")})
                    rows["_nan"] = rows["score"].isna()
                    rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
                    held = rows.sort_values(["mode", "_nan", "score", "a", "b"], ascending=[True, False, False, True, True]).groupby("mode").head(k)
                    for m, own in held.groupby("mode"):
                        if len(own) == k:
                            least[m] = math.inf if own["_nan"].iloc[-1] else float(own["score"].iloc[-1])
        if held is not None:
            number = lambda c: pa.array(held[c].to_numpy(float), pa.float64(), mask=np.isneginf(held[c].to_numpy(float)) & np.isneginf(held["score"].to_numpy(float)), from_pandas=False)
            yield pa.RecordBatch.from_pydict({f"{key}_a": pa.array(held["a"].tolist(), kind), f"{key}_b": pa.array(held["b"].tolist(), kind), "mode": pa.array(held["mode"].tolist(), pa.string())} | {c: number(c) for c in ("ab", "ba", "distance", "avg_quality", "score")})

    return run


def crossed(key: str, cross: str) -> Callable:
    """A map over pairs of blocks to (lo, hi, n, best) of any two different values of ``cross``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kind = b.schema.field(f"{cross}_a").type.value_type
            for x, y, same in sides(iter([b]), key, cross):
                whole = Pairs(x, y, same, math.inf)
                names, codes = np.unique(np.concatenate([x.runs, y.runs]), return_inverse=True)
                of_x, of_y, many = codes[: len(x.ids)], codes[len(x.ids) :], len(names)
                top, wild = np.full((many, many), -math.inf), np.zeros((many, many), bool)
                limit = top.copy()
                np.fill_diagonal(limit, math.inf)
                for tile in whole:
                    ab, ba, score = whole.products(tile, settle=False)
                    high, slack = (whole.bound(tile, ab, ba), whole.slack) if score is None else (score, 0.0)
                    g, h = of_x[tile.rows], of_y[tile.cols]
                    at = ~(high <= (limit[g] - slack)[:, h]) & (g[:, None] != h[None, :])
                    if tile.keep is not None:
                        at &= tile.keep
                    if not at.any():
                        continue
                    i, j = tile.index(at)
                    with np.errstate(invalid="ignore", over="ignore"):
                        s = exact(x, y, i, j)["score"]
                    lo, hi = np.minimum(of_x[i], of_y[j]), np.maximum(of_x[i], of_y[j])
                    odd = np.isnan(s)
                    wild[lo[odd], hi[odd]] = True
                    np.maximum.at(top, (lo[~odd], hi[~odd]), s[~odd])
                    limit[lo, hi] = limit[hi, lo] = np.where(wild[lo, hi], math.inf, top[lo, hi])
                n = np.outer(np.bincount(of_x, minlength=many), np.bincount(of_y, minlength=many))
                if whole.repeated:
                    ids = int(whole.codes.max()) + 1
                    own = lambda c, g: np.bincount(c * many + g, minlength=ids * many).reshape(ids, many)
                    n -= own(whole.codes[: len(x.ids)], of_x).T @ own(whole.codes[0 if same else len(x.ids) :], of_y)
                n = np.triu(n if same else n + n.T, 1)
                lo, hi = np.nonzero(n)
                value = np.where(wild, math.nan, top)[lo, hi]
                yield pa.RecordBatch.from_pydict({"lo": pa.array(names[lo].tolist(), kind), "hi": pa.array(names[hi].tolist(), kind), "n": pa.array(n[lo, hi], pa.int64()), "best": pa.array(value, pa.float64(), mask=np.isneginf(value), from_pandas=False)})

    return run
