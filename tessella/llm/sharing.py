"""Hashes that several owners hold, found fragment by fragment of the hash space.

Workers cut their batches by fragment. A hash that occurs once in a batch goes
on with its owner; one that occurs more often goes on once, and its owners go
to a group of their own that need not meet anyone. So the rows of a hash in one
place grow with the number of batches, not of owners.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm import arrays as A

#: Hashes of one batch and of one row of a bundle: bound a worker's memory and the size of a row.
BATCH, BUNDLE_GRAMS = 200_000, 25_000
MAX_OWNERS = 65_000
MANY = 0xFFFF
KEY = "n int, hi long, lo long"
KEY_DTYPE = np.dtype([("n", "<i4"), ("hi", "<i8"), ("lo", "<i8")])
SLICE = pa.schema([("grp", pa.int32()), ("grams", pa.binary()), ("owners", pa.binary()), ("keys", pa.binary())])
SLICE_TYPE = "grp int, grams binary, owners binary, keys binary"
BUNDLE = pa.schema([("bucket", pa.int32()), ("salt", pa.int32()), ("keys", pa.binary()), ("sizes", pa.binary()), ("grams", pa.binary())])
BUNDLE_TYPE = "bucket int, salt int, keys binary, sizes binary, grams binary"
OWNED = pa.schema([("n", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("grams", pa.binary())])
OWNED_TYPE = f"{KEY}, grams binary"
#: Owners whose hashes meet in one task, about.
BUCKET = 20_000


def fragment_of(h: np.ndarray, fragments: int) -> np.ndarray:
    return ((h >> A.U64(32)) * A.U64(fragments) >> A.U64(32)).astype(np.int64)


def packed(h: np.ndarray) -> bytes:
    """Sorted hashes, their high and low bytes apart: the high ones compress well."""
    b = h.view(np.uint8).reshape(-1, 8)
    return b[:, 6:].tobytes() + b[:, :6].tobytes()


def unpacked(blob: np.ndarray) -> np.ndarray:
    n = len(blob) // 8
    out = np.empty((n, 8), np.uint8)
    out[:, 6:], out[:, :6] = blob[: 2 * n].reshape(n, 2), blob[2 * n :].reshape(n, 6)
    return out.reshape(-1).view(A.U64)


def cut(grams: np.ndarray, owner: np.ndarray, table: np.ndarray, fragments: int) -> pa.RecordBatch:
    """Slices of one batch by fragment.

    Group g < fragments: each hash of that fragment once, with its owner or
    MANY. Group g >= fragments: all owners of hashes that occur again here.
    ``table`` has the owners' keys.
    """
    if not len(grams):
        return pa.RecordBatch.from_pylist([], SLICE)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order].astype(np.uint16)
    first = np.ones(len(grams), bool)
    first[1:] = grams[1:] != grams[:-1]
    begin = np.flatnonzero(first)
    count = np.diff(np.r_[begin, len(grams)])
    many = count > 1
    one = np.where(many, MANY, owner[begin]).astype(np.uint16)
    each = grams[begin]
    part = fragment_of(each, fragments)
    bounds = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
    rows = []

    def put(group: int, g: np.ndarray, o: np.ndarray) -> None:
        used = np.unique(o[o != MANY])
        local = np.searchsorted(used, o).astype(np.uint16)
        local[o == MANY] = MANY
        rows.append((group, packed(g), local.tobytes(), table[used].tobytes()))

    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        put(int(part[a]), each[a:b], one[a:b])
    common = np.repeat(many, count)
    if common.any():
        put(fragments + int(table["hi"][0]) % fragments, grams[common], owner[common])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SLICE.types, strict=True)], schema=SLICE)


class Sharer:
    """Collects (hash, owner) of documents and gives them out in batches cut by fragment."""

    def __init__(self, fragments: int):
        self.fragments = fragments
        self.clear()

    def clear(self) -> None:
        self.grams, self.owners, self.tables, self.held, self.base = [], [], [], 0, 0

    def add(self, grams: np.ndarray, owner: np.ndarray, table: np.ndarray) -> Iterator[pa.RecordBatch]:
        if self.grams and (self.held + len(grams) > BATCH or self.base + len(table) > MAX_OWNERS):
            yield from self.flush()
        self.grams.append(grams)
        self.owners.append(owner + self.base)
        self.tables.append(table)
        self.held += len(grams)
        self.base += len(table)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield cut(np.concatenate(self.grams), np.concatenate(self.owners), np.concatenate(self.tables), self.fragments)
        self.clear()


def idents(table: np.ndarray) -> np.ndarray:
    return A.mix(table["hi"].view(A.U64) ^ A.mix(table["lo"].view(A.U64) + table["n"].astype(A.U64)))


def blobs(column: pa.ChunkedArray, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) for x in column]


def bundles(grams: np.ndarray, who: np.ndarray, table: np.ndarray, owners: np.ndarray, buckets: int, salt: int) -> pa.Table:
    """One row for each bucket of owners: their keys, numbers of hashes, and hashes."""
    order = np.lexsort((grams, who, who % A.U64(buckets)))
    grams, owners, who = grams[order], owners[order], who[order]
    new = np.r_[True, (grams[1:] != grams[:-1]) | (who[1:] != who[:-1])]
    grams, owners, who = grams[new], owners[new], who[new]
    begin = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    size = np.diff(np.r_[begin, len(grams)]).astype(np.uint32)
    bucket = (who[begin] % A.U64(buckets)).astype(np.int64)
    # rows of some BUNDLE_GRAMS, and of one owner at least
    turn = begin // BUNDLE_GRAMS
    first = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (turn[1:] != turn[:-1])])
    rows = []
    for a, b in zip(first, np.r_[first[1:], len(begin)], strict=True):
        end = begin[b] if b < len(begin) else len(grams)
        rows.append((int(bucket[a]), salt, table[owners[begin[a:b]]].tobytes(), size[a:b].tobytes(), grams[begin[a] : end].tobytes()))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), BUNDLE.types, strict=True)], schema=BUNDLE)


def entries(group: pa.Table, fragments: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, owner of each, owners' keys) of a group's slices, of hashes that are there several times.

    In a fragment, hashes are sorted, one of a whole batch has the owner -1, and
    those that come once, which are most, are left out; a group of owners of
    hashes that a batch repeats is taken as it is.
    """
    grams = np.concatenate([unpacked(x) for x in blobs(group["grams"], np.uint8)])
    owners, tables, base = [], [], 0
    for local, table in zip(blobs(group["owners"], np.uint16), blobs(group["keys"], KEY_DTYPE), strict=True):
        owners.append(np.where(local == MANY, -1, local.astype(np.int32) + base).astype(np.int32))
        tables.append(table)
        base += len(table)
    owners, table = np.concatenate(owners), np.concatenate(tables)
    if group["grp"][0].as_py() < fragments and len(grams):
        order = np.argsort(grams, kind="stable")
        grams = grams[order]
        same = grams[1:] == grams[:-1]
        several = np.flatnonzero((np.r_[False, same] | np.r_[same, False]) | (owners[order] < 0))
        grams, owners = grams[several], owners[order[several]]
    return grams, owners, table


def shared_grams(group: pa.Table, fragments: int, buckets: int, salts: int, within: bool = False) -> pa.Table:
    """The hashes of a group that several owners hold, by owner; ``within``: or one owner in several rows."""
    number = group["grp"][0].as_py()
    grams, owners, table = entries(group, fragments)
    if not len(table) or not len(grams):
        return BUNDLE.empty_table()
    ident = idents(table)
    if number < fragments:
        keep = held_by_several(grams, owners, ident, within) & (owners >= 0)
        grams, owners = grams[keep], owners[keep]
    if not len(grams):
        return BUNDLE.empty_table()
    return bundles(grams, ident[owners], table, owners, buckets, number % salts)


def held_by_several(grams: np.ndarray, owners: np.ndarray, ident: np.ndarray, within: bool = False) -> np.ndarray:
    """Which entries of sorted hashes have another owner, or are of a hash that a batch repeats."""
    begin = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
    count = np.diff(np.r_[begin, len(grams)])
    if within:  # an owner that spans batches has a row in each
        several = count > 1
    else:
        who = np.where(owners < 0, A.U64(0), ident[owners])
        several = np.minimum.reduceat(who, begin) != np.maximum.reduceat(who, begin)
    several |= np.minimum.reduceat(owners, begin) < 0
    return np.repeat(several, count)


def unbundled(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, owner of each, owners' keys) of all rows of a group."""
    table = np.concatenate(blobs(group["keys"], KEY_DTYPE))
    size = np.concatenate(blobs(group["sizes"], np.uint32))
    return np.concatenate(blobs(group["grams"], A.U64)), np.repeat(np.arange(len(table)), size), table


def rebundled(group: pa.Table, buckets: int) -> pa.Table:
    grams, owners, table = unbundled(group)
    return bundles(grams, idents(table)[owners], table, owners, buckets, 0)


def by_owner(group: pa.Table, num: int, den: int) -> pa.Table:
    """One row for each owner of a bucket that shares num/den of its n hashes at least."""
    grams, owners, table = unbundled(group)
    who = idents(table)[owners]
    order = np.lexsort((grams, who))
    grams, owners, who = grams[order], owners[order], who[order]
    new = np.r_[True, (grams[1:] != grams[:-1]) | (who[1:] != who[:-1])]
    grams, owners, who = grams[new], owners[new], who[new]
    begin = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
    size = np.diff(np.r_[begin, len(grams)])
    mine = table[owners[begin]]
    keep = size * den >= mine["n"].astype(np.int64) * num
    mine, size, begin = mine[keep], size[keep], begin[keep]
    return pa.Table.from_arrays([pa.array(mine["n"]), pa.array(mine["hi"]), pa.array(mine["lo"]), A.binary_rows(grams[A.ranges(begin, size)], size)], schema=OWNED)


def sharing_owners(parts: DataFrame, owners: int, fragments: int, num: int = 0, den: int = 1, salts: int | None = None, within: bool = False) -> DataFrame:
    """(n, hi, lo, grams): the hashes that each owner shares with others.

    ``parts`` has the slices of cut(); ``owners`` about counts the owners. An
    owner in very many batches is put together on two levels. A hash that one
    owner alone has more than once comes out if both are in one batch; with
    ``within``, always (and owners that come in several rows share all theirs).
    """
    buckets = max(1, -(-owners // BUCKET))
    salts = salts or max(1, math.isqrt(fragments // 64))
    found = parts.groupBy("grp").applyInArrow(lambda t: shared_grams(t, fragments, buckets, salts, within), BUNDLE_TYPE)
    if salts > 1:
        found = found.groupBy("bucket", "salt").applyInArrow(lambda t: rebundled(t, buckets), BUNDLE_TYPE)
    return found.groupBy("bucket").applyInArrow(lambda t: by_owner(t, num, den), OWNED_TYPE)
