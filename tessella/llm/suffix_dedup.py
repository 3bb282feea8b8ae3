"""Exact removal of repeated byte strings by a distributed merge sort of suffixes.

Only suffixes at anchors are sorted: of the GRAM-byte strings in each window of
LENGTH bytes, the one with the least hash (leftmost of equals) anchors it, so
equal windows are anchored at equal places. Anchors whose gram occurs once in
the corpus are dropped first; the grams of the rest are found in fragments of
the hash space, where a long text has an entry for each batch that it spans.

The suffixes that are left (the text from the anchor to the end of its last
window, then the text before it read backwards) are sorted in runs by the
workers, front-coded (length of the prefix shared with the one before, and the
rest), and sent by gram to mergers. A merger combines its runs with a loser tree
that carries shared-prefix lengths: a head that shares more with the last output
wins without a look at its bytes, and others are compared from their common
prefix on. In the sorted order, windows at one distance before their anchors
are equal where the shared prefixes are long enough and the bytes before the
anchors agree; all but the first of equal windows are removed.

Equal suffixes of one run with equal windows are sent once, as their first copy:
the others repeat it, so all their windows go at once. A passage of a third of
all documents so costs a merger a row for each run, not for each copy, and the
suffixes at its ends, which differ.

Cases: a null or empty text has no bytes and no spans; texts under LENGTH bytes
stay; rows that repeat a doc_id and its text are all judged as that one document,
and rows of one doc_id with different texts do not precede each other where they
start alike; a null doc_id precedes all others; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import arrays as A
from tessella.llm.sharing import KEY_DTYPE, SLICE_TYPE, Sharer, sharing_owners
from tessella.llm.stage import bounded_batches, release, save

LENGTH, GRAM = 100, 32
WINDOW = LENGTH - GRAM + 1
#: Window starts of one piece of a long text; anchors of one run and of one merger, about.
PIECE, RUN, MERGE = 1 << 18, 60_000, 80_000
#: Grams of one fragment of the first exchange, about.
FRAGMENT = 1_000_000
PLACE_BITS = 24
#: Stands for a null id, which so precedes all others.
NO_ID = -(1 << 63)
#: Bytes of text at a time: the kernels hold about a hundred bytes for each.
CHUNK = 1 << 18
_POWERS = A.powers(A.BASE, 1)
_INVERSE = A.powers(A.BASE_INV, 1)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes at each place."""
    global _POWERS, _INVERSE
    if len(_POWERS) < len(data) + 1:
        _POWERS, _INVERSE = A.powers(A.BASE, len(data) + 1), A.powers(A.BASE_INV, len(data) + 1)
    sums = np.zeros(len(data) + 1, A.U64)
    np.cumsum(A.BYTE_KEYS[data] * _POWERS[: len(data)], out=sums[1:])
    h = sums[GRAM:] - sums[:-GRAM]
    h *= _INVERSE[: len(h)]
    return A.mix(h)


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, place, least and most distance to its windows' starts, gram) of each anchor.

    Anchors have the least hashes, so these are mixed once more: fragments of the
    hash space get as many of them each.
    """
    starts = np.maximum(np.diff(off) - LENGTH + 1, 0)
    if not starts.any():
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, A.U64),)
    h = gram_hashes(data)
    low = A.U64((1 << PLACE_BITS) - 1)
    least = A.sliding_min((h & ~low) | np.arange(len(h), dtype=A.U64), WINDOW)
    valid = A.ranges(off[:-1], starts)
    at = (least[valid] & low).astype(np.int64)
    doc = np.repeat(np.arange(len(starts)), starts)
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    last = np.r_[first[1:], len(at)] - 1
    place = at[first]
    return doc[first], place, place - valid[last], place - valid[first], A.mix(h[place])


def pieces(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, place in the text): a long text is cut into overlapping pieces."""
    if len(off) == 2 and len(data) > 2 * PIECE:
        for a in range(0, len(data) - LENGTH + 1, PIECE):
            part = data[a : a + PIECE + LENGTH - 1]
            yield part, np.array([0, len(part)]), a
    else:
        yield data, off, 0


def owners(part: pa.RecordBatch) -> np.ndarray:
    table = np.zeros(part.num_rows, KEY_DTYPE)
    table["hi"], table["lo"] = part.column(0).to_numpy(), part.column(1).to_numpy()
    return table


def gram_slices(batches: Iterator[pa.RecordBatch], fragments: int) -> Iterator[pa.RecordBatch]:
    sharer = Sharer(fragments)
    for part, data, off in A.chunks(batches, size=CHUNK):
        table = owners(part)
        for piece, edges, _ in pieces(data, off):
            doc, _, _, _, h = anchors(piece, edges)
            yield from sharer.add(h, doc, table)
    yield from sharer.flush()


# --- sorted runs ---------------------------------------------------------------------------

RUNS = pa.schema([("grp", pa.int32()), ("docs", pa.binary()), ("doc", pa.binary()), ("place", pa.binary()), ("least", pa.binary()), ("most", pa.binary()), ("shared", pa.binary()), ("text", pa.binary())])
RUN_TYPE = "grp int, docs binary, doc binary, place binary, least binary, most binary, shared binary, text binary"
DOC_DTYPE = np.dtype([("id", "<i8"), ("key", "<i8")])
#: Most bytes of a suffix: right of its anchor, and left of it.
LONGEST = LENGTH + WINDOW - 1


class Runs:
    """Collects suffixes at anchors and gives them out as front-coded sorted runs.

    A suffix is bytes ``size`` of one buffer; nothing here is an object for each.
    """

    def __init__(self, groups: int):
        self.groups = groups
        self.clear()

    def clear(self) -> None:
        self.texts, self.parts, self.docs, self.held, self.n_docs = [], [], [], 0, 0

    def add(self, data: np.ndarray, at: np.ndarray, doc: np.ndarray, place: np.ndarray, least: np.ndarray, most: np.ndarray, h: np.ndarray, table: np.ndarray) -> None:
        """Suffixes at ``at`` in ``data``; ``place`` counts from the starts of their texts, ``doc`` is a row of ``table``."""
        size = LENGTH - least + most
        first = np.cumsum(size) - size
        step = np.arange(int(size.sum()), dtype=np.int32) - np.repeat(first, size).astype(np.int32)
        right = np.repeat((LENGTH - least).astype(np.int32), size)
        where = np.where(step < right, step, right - 1 - step)  # right of the anchor, then backwards from it
        self.texts.append(data[np.repeat(at, size) + where])
        group = ((A.mix(h) >> A.U64(32)) * A.U64(self.groups) >> A.U64(32)).astype(np.uint32)
        self.parts.append((group, size.astype(np.uint8), (doc + self.n_docs).astype(np.int64), place.astype(np.uint32), least.astype(np.uint8), most.astype(np.uint8)))
        self.docs.append(table)
        self.held, self.n_docs = self.held + len(at), self.n_docs + len(table)

    def order(self, text: np.ndarray, begin: np.ndarray, group: np.ndarray, size: np.ndarray, doc: np.ndarray, place: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order by group, text, least, document, place; padded texts in that order)."""
        n = len(group)
        row = np.zeros((n, 4 + LONGEST + 2 + 8 + 4), np.uint8)
        row[:, :4] = group.astype(">u4").view(np.uint8).reshape(n, 4)
        for k in range(0, n, 8192):  # pad a few at a time
            some = slice(k, min(k + 8192, n))
            inside = np.arange(LONGEST) < size[some, None]
            row[some, 4 : 4 + LONGEST][inside] = text[begin[k] : begin[k] + int(size[some].sum())]
        row[:, 4 + LONGEST], row[:, 5 + LONGEST] = size, least
        ids = (np.concatenate(self.docs)["id"][doc].view(A.U64) ^ A.U64(1 << 63)).astype(">u8")
        row[:, 6 + LONGEST : 14 + LONGEST] = ids.view(np.uint8).reshape(n, 8)
        row[:, 14 + LONGEST :] = place.astype(">u4").view(np.uint8).reshape(n, 4)
        order = np.argsort(row.view(f"V{row.shape[1]}").ravel(), kind="stable")
        return order, row[order]

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        group, size, doc, place, least, most = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        text, table = np.concatenate(self.texts), np.concatenate(self.docs)
        begin = np.cumsum(size, dtype=np.int64) - size
        self.texts, self.parts = [], []
        order, row = self.order(text, begin, group, size, doc, place, least)
        del text, begin
        self.clear()
        group, size, doc, place, least, most = (x[order] for x in (group, size, doc, place, least, most))
        # the first of each class of equal suffixes and windows; what repeats it goes whole
        upto = 6 + LONGEST
        new = np.r_[True, (row[1:, :upto] != row[:-1, :upto]).any(axis=1)]
        cls = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        copy = (row[:, upto:] != row[head][cls][:, upto:]).any(axis=1)
        out = []
        if copy.any():
            out.append(self.copies(table, doc[copy], place[copy].astype(np.int64), least[copy], most[copy]))
        keep = ~copy
        row, group, size, doc, place, least, most = row[keep, 4 : 4 + LONGEST], group[keep], size[keep], doc[keep], place[keep], least[keep], most[keep]
        shared = np.zeros(len(size), np.uint8)
        for k in range(1, len(size), 8192):
            to = min(k + 8192, len(size))
            differ = row[k:to] != row[k - 1 : to - 1]
            same = np.where(differ.any(axis=1), differ.argmax(axis=1), LONGEST)
            shared[k:to] = np.minimum(np.minimum(same, size[k:to]), size[k - 1 : to - 1])
        edge = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)]
        shared[edge[:-1]] = 0  # a run starts here
        span = np.arange(LONGEST)
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            used, local = np.unique(doc[a:b], return_inverse=True)
            rest = row[a:b][(span >= shared[a:b, None]) & (span < size[a:b, None])]
            out.append((int(group[a]), table[used].tobytes(), local.astype(np.uint32).tobytes(), place[a:b].tobytes(), least[a:b].tobytes(), most[a:b].tobytes(), shared[a:b].tobytes(), rest.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), RUNS.types, strict=True)], schema=RUNS)

    def copies(self, table: np.ndarray, doc: np.ndarray, place: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple:
        """A row of whole intervals to remove, for a group beyond those of the mergers."""
        starts, ends = place - most, place - least.astype(np.int64) + LENGTH
        doc, starts, ends = merged_by(doc, starts, ends)
        used, local = np.unique(doc, return_inverse=True)
        number = self.groups + int(table["id"][used[0]] % self.groups)
        return (number, table[used].tobytes(), local.astype(np.uint32).tobytes(), starts.tobytes(), b"", b"", b"", ends.tobytes())


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two strings that agree on the first ``at`` bytes."""
    n = min(len(a), len(b))
    x, y = a[at:n], b[at:n]
    if x == y:
        return n
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (differ.bit_length() + 7) // 8


def sorted_runs(batches: Iterator[pa.RecordBatch], groups: int) -> Iterator[pa.RecordBatch]:
    runs = Runs(groups)
    for part, data, off in A.chunks(batches, size=CHUNK):
        grams = part.column(part.schema.get_field_index("grams"))
        table = np.zeros(part.num_rows, DOC_DTYPE)
        table["id"], table["key"] = part.column(0).to_numpy(), part.column(1).to_numpy()
        keep = [np.frombuffer(x.as_buffer(), A.U64) for x in grams]
        for piece, edges, base in pieces(data, off):
            doc, place, least, most, h = anchors(piece, edges)
            cut = np.searchsorted(doc, np.arange(len(edges)))
            known = np.zeros(len(doc), bool)
            for i in range(len(edges) - 1):
                known[cut[i] : cut[i + 1]] = np.isin(h[cut[i] : cut[i + 1]], keep[i])
            for k in range(0, len(doc), RUN):
                some = np.flatnonzero(known[k : k + RUN]) + k
                if len(some):
                    runs.add(piece, place[some], doc[some], place[some] - edges[doc[some]] + base, least[some], most[some], h[some], table)
                if runs.held > RUN or runs.n_docs > RUN:
                    yield from runs.flush()
    yield from runs.flush()


# --- merging ---------------------------------------------------------------------------------


def decoded(shared: bytes, lengths: np.ndarray, text: bytes) -> Iterator[tuple[int, bytes]]:
    """(prefix shared with the one before, string) of a front-coded run."""
    before, at = b"", 0
    for n, size in zip(shared, lengths.tolist(), strict=True):
        rest = size - n
        before = before[:n] + text[at : at + rest]
        at += rest
        yield n, before


def merge_runs(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """(run, prefix shared with the last output, string) of all runs in ascending order.

    A loser tree: each inner node holds the run that lost there and how much its
    head shares with the string that beat it.
    """
    k = 1
    while k < len(runs):
        k *= 2
    heads: list[bytes | None] = []
    for r in runs:
        first = next(r, None)
        heads.append(first[1] if first else None)
    heads += [None] * (k - len(heads))
    loser, depth = [0] * k, [0] * k

    def play(node: int) -> tuple[int, int]:
        if node >= k:
            return node - k, 0
        (a, _), (b, _) = play(2 * node), play(2 * node + 1)
        x, y = heads[a], heads[b]
        if y is None or (x is not None and x <= y):
            win, lose = a, b
        else:
            win, lose = b, a
        loser[node] = lose
        depth[node] = common(heads[win], heads[lose], 0) if heads[lose] is not None else -1
        return win, 0

    winner, shared = play(1)
    while heads[winner] is not None:
        yield winner, shared, heads[winner]
        following = next(runs[winner], None)
        if following is None:
            heads[winner], shared = None, -1
        else:
            shared, heads[winner] = following
        node = (winner + k) // 2
        while node:
            other, n = loser[node], depth[node]
            if n > shared:
                loser[node], depth[node] = winner, shared
                winner, shared = other, n
            elif n == shared and n >= 0:
                x, y = heads[winner], heads[other]
                both = common(x, y, n)
                if x[both:] <= y[both:]:
                    depth[node] = both
                else:
                    loser[node], depth[node] = winner, both
                    winner, shared = other, n
            node //= 2


SPANS = pa.schema([("bucket", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("starts", pa.binary()), ("ends", pa.binary())])
SPAN_TYPE = "bucket int, docs binary, counts binary, starts binary, ends binary"
SPREAD = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("starts", pa.binary()), ("ends", pa.binary())])
#: Documents whose intervals meet in one task, about.
BUCKET = 20_000
#: Tells the intervals of different documents apart when all are merged at once.
APART = 1 << 40


def merged_by(doc: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(documents, starts, ends) of the maximal runs of each document, in order."""
    base = doc.astype(np.int64) * APART
    order = np.argsort(starts + base, kind="stable")
    s, e = merged((starts + base)[order], (ends + base)[order])
    doc = s // APART
    return doc, s - doc * APART, e - doc * APART


def span_rows(table: np.ndarray, doc: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int) -> pa.Table:
    """One row for each bucket of documents: which, how many intervals of each, and the intervals."""
    if not len(doc):
        return SPANS.empty_table()
    where = (A.mix(table["id"].view(A.U64) ^ A.mix(table["key"].view(A.U64))) % A.U64(buckets)).astype(np.int64)
    rank = np.argsort(where, kind="stable")
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    doc, starts, ends = merged_by(place[doc], starts, ends)
    used, first, counts = np.unique(doc, return_index=True, return_counts=True)
    owner, bucket = table[rank[used]], where[rank[used]]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    rows = []
    for a, b in zip(cut, np.r_[cut[1:], len(used)], strict=True):
        x, y = first[a], first[b] if b < len(used) else len(starts)
        rows.append((int(bucket[a]), owner[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes(), starts[x:y].tobytes(), ends[x:y].tobytes()))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SPANS.types, strict=True)], schema=SPANS)


def by_document(group: pa.Table) -> pa.Table:
    """All intervals of a bucket's documents, a row for each."""
    of = lambda c, t: np.concatenate([np.frombuffer(x.as_buffer(), t) for x in group[c]])
    table, counts = of("docs", DOC_DTYPE), of("counts", np.uint32)
    each, index = np.unique(table, return_inverse=True)
    doc, starts, ends = merged_by(np.repeat(index.ravel(), counts), of("starts", np.int64), of("ends", np.int64))
    size = np.bincount(doc, minlength=len(each))
    return pa.Table.from_arrays([pa.array(each["id"]), pa.array(each["key"]), A.binary_rows(starts, size), A.binary_rows(ends, size)], schema=SPREAD)


def copied_spans(group: pa.Table, buckets: int) -> pa.Table:
    """The intervals of Runs.copies(), by bucket of documents."""
    tables, docs, starts, ends, base = [], [], [], [], 0
    for r in group.to_pylist():
        tables.append(np.frombuffer(r["docs"], DOC_DTYPE))
        docs.append(np.frombuffer(r["doc"], np.uint32).astype(np.int64) + base)
        starts.append(np.frombuffer(r["place"], np.int64))
        ends.append(np.frombuffer(r["text"], np.int64))
        base += len(tables[-1])
    return span_rows(np.concatenate(tables), np.concatenate(docs), np.concatenate(starts), np.concatenate(ends), buckets)


def repeats(group: pa.Table, groups: int, buckets: int) -> pa.Table:
    """Intervals of bytes to remove, by bucket of documents, from the sorted runs of one merger."""
    if group["grp"][0].as_py() >= groups:
        return copied_spans(group, buckets)
    cols = {c: [x.as_buffer().to_pybytes() for x in group[c]] for c in RUNS.names[1:]}
    docs, run_at, base = [], [0], 0
    doc, place, least, most = [], [], [], []
    for i in range(group.num_rows):
        docs.append(np.frombuffer(cols["docs"][i], DOC_DTYPE))
        doc.append(np.frombuffer(cols["doc"][i], np.uint32).astype(np.int64) + base)
        base += len(docs[-1])
        place.append(np.frombuffer(cols["place"][i], np.uint32).astype(np.int64))
        least.append(np.frombuffer(cols["least"][i], np.uint8).astype(np.int64))
        most.append(np.frombuffer(cols["most"][i], np.uint8).astype(np.int64))
        run_at.append(run_at[-1] + len(place[-1]))
    heads = [decoded(cols["shared"][i], LENGTH - least[i] + most[i], cols["text"][i]) for i in range(group.num_rows)]
    docs, doc, place, least, most = (np.concatenate(x) for x in (docs, doc, place, least, most))
    n = len(place)
    order, shared = np.empty(n, np.int64), np.empty(n, np.int64)
    left = np.zeros((n, WINDOW - 1), np.uint8)
    following = run_at[:-1]
    for i, (run, same, text) in enumerate(merge_runs(heads)):
        e = following[run]
        following[run] = e + 1
        order[i], shared[i] = e, same
        size = most[e]
        if same == len(text) and i and size == most[order[i - 1]]:
            left[i] = left[i - 1]
        elif size:
            left[i, :size] = np.frombuffer(text, np.uint8)[-size:]
    doc, place, least, most = doc[order], place[order], least[order], most[order]
    # equal strings with equal windows are one class; the first of them stands for all
    size = LENGTH - least + most
    new = np.r_[True, (shared[1:] < size[1:]) | (size[1:] != size[:-1]) | (least[1:] != least[:-1])]
    cls = np.cumsum(new) - 1
    ids = docs["id"][doc]
    by_place = np.lexsort((place, ids))
    step = np.r_[0, (np.diff(ids[by_place]) != 0) | (np.diff(place[by_place]) != 0)]
    rank = np.empty(n, np.int64)
    rank[by_place] = np.cumsum(step)
    begin = np.flatnonzero(new)
    first = np.minimum.reduceat(rank, begin)
    lcp = shared[begin]  # prefix shared with the class before
    lo, hi = least[begin], most[begin]
    by_rank = np.argsort(first, kind="stable")
    copied = np.zeros((len(begin), WINDOW), bool)
    before = np.zeros(len(begin), A.U64)
    lefts = left[begin]
    power = A.powers(A.BASE, WINDOW)
    for o in range(WINDOW):
        if o:
            before += A.BYTE_KEYS[lefts[:, o - 1]] * power[o - 1]
        block = np.cumsum(lcp < LENGTH - o).astype(A.U64)
        v = by_rank[(lo[by_rank] <= o) & (o <= hi[by_rank])]
        if len(v) < 2:
            continue
        key = A.mix(A.mix(block[v]) ^ before[v])
        pos = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.r_[True, key[pos][1:] != key[pos][:-1]])
        least_rank = np.repeat(first[v[pos]][head], np.diff(np.r_[head, len(pos)]))
        copied[v[pos], o] = first[v[pos]] > least_rank
    everything = (np.arange(WINDOW) >= lo[:, None]) & (np.arange(WINDOW) <= hi[:, None])
    # members of a class after its first have all windows removed
    gone = np.where((rank > first[cls])[:, None], everything[cls], copied[cls])
    hit = gone.any(axis=1)
    if not hit.any():
        return SPANS.empty_table()
    gone, doc, place = gone[hit], doc[hit], place[hit]
    edge = np.diff(np.pad(gone, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, a = np.nonzero(edge == 1)
    _, b = np.nonzero(edge == -1)  # distances a .. b - 1 of this row are removed
    who, starts, ends = doc[row], place[row] - (b - 1), place[row] - a + LENGTH
    del gone, left, lefts, copied, everything, heads, cols
    A.give_back()
    return span_rows(docs, who, starts, ends, buckets)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of intervals sorted by start; runs that touch are one."""
    reach = np.maximum.accumulate(ends)
    first = np.r_[True, starts[1:] > reach[:-1]]
    return starts[first], reach[np.r_[np.flatnonzero(first)[1:] - 1, len(reach) - 1]]


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(doc_id, key, starts, ends): the maximal runs of bytes that are repeats, of each document that has any.

    ``texts`` has doc_id, key (a hash of the text) and text; starts and ends are
    little-endian int64.
    """
    size = texts.agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("c")).first()
    fragments = max(2, math.ceil((size["n"] or 0) * 2 / (WINDOW + 1) / FRAGMENT))
    buckets = max(1, math.ceil(size["c"] / BUCKET))
    parts = texts.mapInArrow(lambda it: gram_slices(it, fragments), SLICE_TYPE)
    own = save(sharing_owners(parts, size["c"], fragments, within=True).select(F.col("hi").alias("doc_id"), F.col("lo").alias("key"), "grams"), "repeated_grams")
    count = own.agg(F.sum(F.length("grams")).alias("n")).first()["n"] or 0
    groups = max(2, math.ceil(count / 8 / MERGE))
    runs = texts.join(own, ["doc_id", "key"]).select("doc_id", "key", F.encode("text", "UTF-8").alias("text"), "grams").mapInArrow(lambda it: sorted_runs(it, groups), RUN_TYPE)
    spans = runs.groupBy("grp").applyInArrow(lambda t: repeats(t, groups, buckets), SPAN_TYPE)
    found = save(spans.groupBy("bucket").applyInArrow(by_document, "doc_id long, key long, starts binary, ends binary"), "repeats")
    release(own)
    return found


def removed(texts: DataFrame) -> DataFrame:
    """texts with starts and ends of repeated_spans(), null for none."""
    return texts.join(repeated_spans(texts), ["doc_id", "key"], "left")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))


def named(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID)))


def runs_of(starts: bytes | None, ends: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(starts or b"", np.int64), np.frombuffer(ends or b"", np.int64)


def kept_bytes(text: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    edges = [0, *np.stack([starts, ends], axis=1).ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


REPORT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sizes, removed bytes and runs, and a digest of the bytes that stay, of each row of ``docs``."""
    bounded_batches(docs.sparkSession)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, text, s, e in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                s, e = runs_of(s, e)
                out.append((i, len(raw), int((e - s).sum()), len(s), hashlib.sha256(kept_bytes(raw, s, e)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]) if out else pa.RecordBatch.from_pylist([], pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]))

    return named(removed(keyed(docs, id_col, text_col)).select("doc_id", "text", "starts", "ends").mapInArrow(digest, REPORT))


def dedupe(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text without the repeated bytes, of each row of ``docs``.

    A character that is cut apart, which happens where a repeat starts or ends
    inside it, becomes U+FFFD.
    """
    bounded_batches(docs.sparkSession)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [kept_bytes(t.as_buffer().to_pybytes(), *runs_of(s, e)).decode("utf-8", "replace") for t, s, e in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return named(removed(keyed(docs, id_col, text_col)).select("doc_id", "text", "starts", "ends").mapInArrow(strip, "doc_id long, text string"))
