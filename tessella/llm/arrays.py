"""Vectorised byte and word kernels shared by the corpus operators.

A text column arrives from Arrow as UTF-8 bytes plus offsets, so every kernel
works on one uint8 array for many documents; nothing here loops over words.
"""

from __future__ import annotations

import ctypes
import ctypes.util
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: malloc_trim of the GNU C library, where there is one.
_trim = getattr(ctypes.CDLL(ctypes.util.find_library("c") or None), "malloc_trim", None)
#: Bytes of text that one kernel call expands at a time; bounds worker memory.
CHUNK_BYTES = 1 << 20

_rng = np.random.default_rng(20240229)
BYTE_KEYS = _rng.integers(1, 2**64, 256, dtype=U64)
#: Odd multiplier of the polynomial hash, and its inverse modulo 2**64.
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(int(BASE), -1, 2**64))
#: The first 0 .. 8 bytes of a little-endian word of 8.
TAIL_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], U64)
GRAM_KEYS = _rng.integers(1, 2**63, 64, dtype=U64) * U64(2) + U64(1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every bit of the result depends on all bits."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h = h * U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def utf8_views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1 entries) of a string or binary array; nulls are empty."""
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    n = len(column)
    if not n:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    if column.null_count:
        # a null slot may span bytes in theory; give it none
        lengths = np.diff(off)
        if lengths[column.is_null().to_numpy(zero_copy_only=False)].any():
            filled = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
            return utf8_views(filled)
    return raw[off[0] : off[-1]], off - off[0]


def give_back() -> None:
    """Return freed memory to the system: Python workers wait for their next task with what they keep."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut record batches into slices of about ``size`` bytes of text; a long document is a slice of its own."""
    for batch in batches:
        data, off = utf8_views(batch.column(batch.schema.get_field_index(text)))
        n, at = batch.num_rows, 0
        while at < n:
            to = int(np.searchsorted(off, off[at] + size, side="right")) - 1
            to = min(max(to, at + 1), n)
            yield batch.slice(at, to - at), data[off[at] : off[to]], off[at : to + 1] - off[at]
            at = to
        del batch, data, off
    give_back()


def lower_ascii_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_ascii_table()
#: Words of [^\x20\x09-\x0D]+
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in lower-cased text
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def words(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document), n + 1 entries in the last.

    Words never run across documents. ``data`` holds the documents back to back.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    mask = is_word[data]
    begin = mask.copy()
    begin[1:] &= ~mask[:-1]
    inner = off[(off > 0) & (off < n)]
    begin[inner] = mask[inner]
    starts = np.flatnonzero(begin)
    stop = mask.copy()
    stop[:-1] &= ~mask[1:]
    stop[inner - 1] = mask[inner - 1]
    ends = np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes.

    A word is read as blocks of 8 bytes; each block is mixed with its number
    before they are summed, so no two texts collide by their construction, as
    they may under a polynomial modulo 2**64.
    """
    if not len(starts):
        return np.empty(0, U64)
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    at = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    length = ends - starts
    blocks = np.maximum((length + 7) >> 3, 1)
    first = np.cumsum(blocks) - blocks
    number = np.arange(int(blocks.sum()), dtype=np.int64) - np.repeat(first, blocks)
    value = at[np.repeat(starts, blocks) + 8 * number]
    last = first + blocks - 1
    value[last] &= TAIL_MASKS[length - 8 * (blocks - 1)]
    return mix(np.add.reduceat(mix(value ^ mix(number.astype(U64) + BASE)), first) + length.astype(U64))


def hash_grams(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words of one sequence; len - k + 1 entries."""
    n = len(word_hashes) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = word_hashes[:n] * GRAM_KEYS[0]
    for j in range(1, k):
        out += word_hashes[j : j + n] * GRAM_KEYS[j]
    return mix(out)


def hash_grams_at(word_hashes: np.ndarray, places: np.ndarray, k: int) -> np.ndarray:
    """hash_grams() at the given places only."""
    out = word_hashes[places] * GRAM_KEYS[0]
    for j in range(1, k):
        out += word_hashes[places + j] * GRAM_KEYS[j]
    return mix(out)


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values; len - w + 1 entries."""
    n = len(values)
    if n < w:
        return np.empty(0, values.dtype)
    pad = -n % w
    top = np.iinfo(values.dtype).max
    v = np.concatenate([values, np.full(pad, top, values.dtype)]).reshape(-1, w)
    prefix = np.minimum.accumulate(v, axis=1).ravel()
    suffix = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - w + 1], prefix[w - 1 : n])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(start, start + length)."""
    lengths = np.asarray(lengths, np.int64)
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    first = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - first, lengths)


def binary_rows(flat: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary column whose row i holds the next lengths[i] elements of ``flat``."""
    flat = np.ascontiguousarray(flat)
    off = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(np.asarray(lengths, np.int64) * flat.dtype.itemsize, out=off[1:])
    if off[-1] >= 2**31:
        raise ValueError("a batch of binary rows holds over 2 GiB")
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(flat)])
