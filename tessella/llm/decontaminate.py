"""Benchmark decontamination by winnowing.

A window is ``span`` consecutive words of a benchmark item (an item of fewer
words is one window of its own length). Of every ``span - gram + 1``
consecutive grams of ``gram`` words the least hash is kept, in documents and in
items alike, so two texts that share ``span`` words always share a kept gram at
the same place in it. Documents are joined with the items on kept grams; each
hit is extended to the windows around it, which are compared word by word.

A benchmark of at most ``block_words`` words is held by the workers. A larger one
is joined: of its kept grams and its windows two bit filters of FILTER_BITS go to
the workers, whatever its size; documents send on the windows around their kept
grams that pass both, and these are joined with the items' windows by 128 bits.
The documents are read once either way.

Cases: a null or empty text has no words and no hits; an item without words
has no windows; rows of one item id are one item, whose windows are those of all
its texts, whatever the size of the benchmark; rows without an item id are none; rows that repeat a doc_id come out
one by one, with the hits of their own text; an empty benchmark hits nothing;
columns beyond the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import arrays as A
from tessella.llm.stage import bounded_batches, save, text_key, without

SPAN, GRAM = 10, 5
#: Words of benchmark text that workers hold: about 60 MB of tables in each.
BLOCK_WORDS = 1_000_000
#: Bits of each filter of a larger benchmark.
FILTER_BITS = 1 << 27
HITS = "doc_id long, key long, n_words long, starts binary, ends binary, items array<string>"


def kept_grams(word_hashes: np.ndarray, gram: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the grams that winnowing keeps in one sequence of words."""
    grams = A.hash_grams(word_hashes, gram)
    least = A.sliding_min(grams, span - gram + 1)
    if not len(least):
        return np.empty(0, np.int64), np.empty(0, A.U64)
    kept = np.zeros(len(grams), bool)
    w = span - gram + 1
    for j in range(w):  # every place that is the least of some window; ties are all kept
        kept[j : j + len(least)] |= grams[j : j + len(least)] == least
    at = np.flatnonzero(kept)
    return at, grams[at]


def doc_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = A.LOWER[data]
    starts, ends, first = A.words(low, off, A.ALNUM)
    return A.hash_words(low, starts, ends), first


class Items:
    """Windows and kept grams of a block of benchmark items, as sorted arrays."""

    def __init__(self, ids: list, texts: list, span: int, gram: int):
        self.span, self.gram = span, gram
        self.names = np.array([str(i) for i in ids], object)
        data, off = A.utf8_views(pa.array(texts, pa.large_string()))
        hashes, first = doc_words(data, off)
        whole: dict[int, list] = {}
        fingerprints = []
        for i in range(len(ids)):
            h = hashes[first[i] : first[i + 1]]
            if not len(h):
                continue
            size = min(span, len(h))
            places = np.arange(len(h) - size + 1) + first[i]
            whole.setdefault(size, []).append((A.hash_grams(h, size), places, np.full(len(places), i)))
            if size == span:
                fingerprints.append(kept_grams(h, gram, span)[1])
        self.words = hashes
        self.kept = np.unique(np.concatenate(fingerprints)) if fingerprints else np.empty(0, A.U64)
        self.windows = {}
        for size, parts in whole.items():
            h, at, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            self.windows[size] = (h[order], at[order], item[order])

    def extend(self, h: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, items) of the windows of ``size`` words of ``h`` at ``places`` that items have."""
        known, at, item = self.windows[size]
        mine = A.hash_grams_at(h, places, size)
        lo, hi = np.searchsorted(known, mine, "left"), np.searchsorted(known, mine, "right")
        got = A.ranges(lo, hi - lo)
        place = np.repeat(places, hi - lo)
        if not len(got):
            return place, item[got]
        same = (h[place[:, None] + np.arange(size)] == self.words[at[got][:, None] + np.arange(size)]).all(axis=1)
        return place[same], item[got[same]]

    def hits(self, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(documents, window starts, window sizes, items) over the word hashes of many documents.

        ``first`` has the first word of each document. Winnowing over all of them
        at once keeps all that it would keep in each; windows that would run
        across documents are dropped before they are compared.
        """
        found = []
        for size in self.windows:
            if len(h) < size:
                continue
            if size == self.span:
                at, grams = kept_grams(h, self.gram, self.span)
                reach = self.span - self.gram + 1
                known = self.kept
            else:  # winnowing with windows of one gram: every gram is kept
                grams = A.hash_grams(h, size)
                at, reach, known = np.arange(len(grams)), 1, np.unique(self.windows[size][0])
            k = np.searchsorted(known, grams)
            k[k == len(known)] = 0
            at = at[known[k] == grams]
            if not len(at):
                continue
            places = np.unique(np.add.outer(at, -np.arange(reach)).ravel())
            places = places[places >= 0]
            doc = np.searchsorted(first, places, "right") - 1
            places = places[places + size <= first[doc + 1]]
            if len(places):
                place, item = self.extend(h, places, size)
                found.append((np.searchsorted(first, place, "right") - 1, place, np.full(len(place), size), item))
        if not found:
            return (np.empty(0, np.int64),) * 4
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of a union of intervals [start, end)."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    first = np.r_[True, starts[1:] > reach[:-1]]
    return starts[first], reach[np.r_[np.flatnonzero(first)[1:] - 1, len(reach) - 1]]


def search(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("starts", pa.binary()), ("ends", pa.binary()), ("items", pa.list_(pa.string()))])
    for part, data, off in A.chunks(batches):
        hashes, first = doc_words(data, off)
        n = part.num_rows
        starts, ends, names = [b""] * n, [b""] * n, [[]] * n
        doc, at, size, item = items.hits(hashes, first)
        order = np.argsort(doc, kind="stable")
        doc, at, size, item = doc[order], at[order], size[order], item[order]
        cut = np.flatnonzero(np.diff(doc)) + 1
        for k in np.split(np.arange(len(doc)), cut) if len(doc) else []:
            i = int(doc[k[0]])
            s, e = merged(at[k] - first[i], at[k] + size[k] - first[i])
            starts[i], ends[i] = s.astype(np.int64).tobytes(), e.astype(np.int64).tobytes()
            names[i] = sorted(set(items.names[np.unique(item[k])]))
        yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(np.diff(first), pa.int64()), pa.array(starts, pa.binary()), pa.array(ends, pa.binary()), pa.array(names, pa.list_(pa.string()))], schema=schema)


# --- a benchmark beyond block_words --------------------------------------------------------


def window_hashes(h: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the ``size`` words at each place; windows of different sizes differ."""
    other = (h[places] + A.U64(size)) * A.GRAM_KEYS[30]
    for j in range(1, size):
        other += h[places + j] * A.GRAM_KEYS[30 + j]
    return A.hash_grams_at(h, places, size) + A.U64(size), A.mix(other)


WINDOWS = pa.schema([("item", pa.string()), ("size", pa.int32()), ("h", pa.int64()), ("h2", pa.int64()), ("gram", pa.int64())])
WINDOWS_TYPE = "item string, size int, h long, h2 long, gram long"


def item_windows(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Windows of items (item, text), and rows of size 0 for their kept grams."""
    for part, data, off in A.chunks(batches):
        hashes, first = doc_words(data, off)
        names = part.column(0).to_pylist()
        for i, name in enumerate(names):
            h = hashes[first[i] : first[i + 1]]
            if not len(h):
                continue
            size = min(span, len(h))
            a, b = window_hashes(h, np.arange(len(h) - size + 1), size)
            kept = np.unique(kept_grams(h, gram, span)[1]) if size == span else np.empty(0, A.U64)
            n, k = len(a), len(kept)
            cols = [np.r_[np.full(n, size), np.zeros(k, np.int64)].astype(np.int32), np.r_[a, np.zeros(k, A.U64)].view(np.int64), np.r_[b, np.zeros(k, A.U64)].view(np.int64), np.r_[np.zeros(n, A.U64), kept].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * (n + k), pa.string()), *map(pa.array, cols)], schema=WINDOWS)


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """FILTER_BITS bits with those of the column ``h`` set."""
    word = F.shiftrightunsigned("h", 6).bitwiseAND(FILTER_BITS // 64 - 1)
    rows = hashes.groupBy(word.alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 64, A.U64)
    out[rows["w"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(A.U64)
    return out


def passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    word = (h >> A.U64(6)) & A.U64(len(bits) - 1)
    return (bits[word.astype(np.int64)] >> (h & A.U64(63))) & A.U64(1) == 1


PROBED = "doc_id long, key long, n_words long, found array<struct<at:long,size:int,h:long,h2:long>>"


def probe(batches: Iterator[pa.RecordBatch], sizes: list[int], grams: np.ndarray, windows: np.ndarray, span: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Each document with its windows that pass the filters."""
    for part, data, off in A.chunks(batches):
        h, first = doc_words(data, off)
        docs, ats, every, hs, h2s = ([] for _ in range(5))
        for size in sizes:
            if len(h) < size:
                continue
            if size == span:
                at, kept = kept_grams(h, gram, span)
                at = at[passes(grams, kept)]
                places = np.unique(np.add.outer(at, -np.arange(span - gram + 1)).ravel())
                places = places[places >= 0]
            else:
                places = np.arange(len(h) - size + 1)
            doc = np.searchsorted(first, places, "right") - 1
            places = places[places + size <= first[doc + 1]]
            a, b = window_hashes(h, places, size)
            ok = passes(windows, a)
            places = places[ok]
            doc = np.searchsorted(first, places, "right") - 1
            docs.append(doc)
            ats.append(places - first[doc])
            every.append(np.full(len(places), size, np.int32))
            hs.append(a[ok].view(np.int64))
            h2s.append(b[ok].view(np.int64))
        doc = np.concatenate([np.empty(0, np.int64), *docs])
        order = np.argsort(doc, kind="stable")
        edge = np.searchsorted(doc[order], np.arange(part.num_rows + 1))
        fields = [np.concatenate([np.empty(0, t), *x])[order] for x, t in ((ats, np.int64), (every, np.int32), (hs, np.int64), (h2s, np.int64))]
        found = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in fields], ["at", "size", "h", "h2"]))
        yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), part.column(1), pa.array(np.diff(first), pa.int64()), found], names=["doc_id", "key", "n_words", "found"])


def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, key, n_words, spots, names): the union of the windows found."""
    for batch in batches:
        rows = batch.to_pydict()
        out = []
        for spots in rows["spots"]:
            at, size = np.array([x["at"] for x in spots or ()], np.int64), np.array([x["size"] for x in spots or ()], np.int64)
            out.append(merged(at, at + size))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([x[0].tobytes() for x in out], pa.binary()), pa.array([x[1].tobytes() for x in out], pa.binary()), pa.array([sorted(x or ()) for x in rows["names"]], pa.list_(pa.string()))], names=["doc_id", "key", "n_words", "starts", "ends", "items"])


def joined_hits(texts: DataFrame, bench: DataFrame, span: int, gram: int) -> DataFrame:
    spark = texts.sparkSession
    windows = save(bench.mapInArrow(lambda it: item_windows(it, span, gram), WINDOWS_TYPE), "benchmark_windows")
    sizes = sorted(r[0] for r in windows.where("size > 0").select("size").distinct().collect())
    own = windows.where("size > 0").select("size", "h", "h2", "item").distinct()
    filters = spark.sparkContext.broadcast((bit_filter(windows.where("size = 0").select(F.col("gram").alias("h"))), bit_filter(own)))
    rows = save(texts.mapInArrow(lambda it: probe(it, sizes, *filters.value, span, gram), PROBED), "winnowed")
    each = rows.select("doc_id", "key", F.explode("found").alias("w")).select("doc_id", "key", "w.*")
    # a window goes by the class of the items that hold it; items come in once a document and class
    sets = own.groupBy("size", "h", "h2").agg(F.sort_array(F.collect_set("item")).alias("names")).withColumn("class", F.sha2(F.to_json("names"), 256))
    sets = save(sets, "window_items")
    spots = each.join(sets.select("size", "h", "h2", "class"), ["size", "h", "h2"]).groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", "size")).alias("spots"), F.collect_set("class").alias("classes"))
    members = sets.groupBy("class").agg(F.first("names").alias("members"))
    named = spots.select("doc_id", "key", "spots", F.explode("classes").alias("class")).join(members, "class")
    hits = named.groupBy("doc_id", "key").agg(F.first("spots").alias("spots"), F.array_distinct(F.flatten(F.collect_list("members"))).alias("names"))
    hits = save(hits.withColumnsRenamed({"doc_id": "_id", "key": "_key"}), "window_hits")
    whole = rows.join(hits, rows["doc_id"].eqNullSafe(hits["_id"]) & rows["key"].eqNullSafe(hits["_key"]), "left")
    return whole.select("doc_id", "key", "n_words", "spots", "names").mapInArrow(unite, HITS)


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: its words, the hit runs [start, end) of words, and the items found.

    starts and ends are little-endian int64 arrays; items are sorted as strings;
    key tells rows of one doc_id apart.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).cast("string").alias("text")).where("item is not null")
    size = bench.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("n")).first()["n"] or 0
    if size > 2 * block_words:  # a word has a byte and a delimiter at least
        return joined_hits(texts, bench, span, gram)
    rows = bench.collect()
    shared = spark.sparkContext.broadcast(Items([r["item"] for r in rows], [r["text"] for r in rows], span, gram))
    return texts.mapInArrow(lambda it: search(it, shared.value), HITS)


def digest(hits: DataFrame) -> DataFrame:
    """Columns of the contamination report, from contamination()'s rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = b.to_pydict()
            n = [int(np.frombuffer(e, np.int64).sum() - np.frombuffer(s, np.int64).sum()) for s, e in zip(d["starts"], d["ends"], strict=True)]
            sha = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in d["items"]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array([len(x) for x in d["items"]], pa.int64()), pa.array(sha), pa.array([x > 0 for x in n])], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    return hits.mapInArrow(count, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean(docs: DataFrame, benchmark: DataFrame, *, max_share: float = 0.0, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Documents whose share of hit words is at most ``max_share``; all their columns are kept.

    Documents without words stay.
    """

    def dirty(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = np.array([int(np.frombuffer(e, np.int64).sum() - np.frombuffer(s, np.int64).sum()) for s, e in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)], np.int64)
            yield b.select([0, 1]).filter(pa.array(hit > max_share * b.column(2).to_numpy()))

    found = contamination(docs, benchmark, id_col=id_col, text_col=text_col, **how)
    return without(docs, found.mapInArrow(dirty, "doc_id long, key long"), id_col, text_col)
