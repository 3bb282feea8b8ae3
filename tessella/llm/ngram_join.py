"""Jaccard self-join on word n-grams with vertical partitioning.

The global order of n-grams (of their 64-bit hashes) is cut into fragments.
Every set is cut along, and each fragment is worked on alone:

1. Sets that are equal form classes, by size and a 128-bit hash; from here on a
   class counts once, under a number of its own.
2. Of each set, a first part of its n-grams in the global order is exchanged: as
   many as a linked set may lack, and EXTRA more. In each fragment the n-grams
   that several sets have are found, and each set's partial counts are summed.
   By the prefix argument two linked sets share EXTRA of these at least; a set
   that shares fewer with all others together has no link. Only the sets that
   are left are read again as a whole.
3. Their n-grams are ordered by frequency, rarest first; those of one set alone
   go. Of two linked sets, the larger has an n-gram of its probing prefix in
   the indexing prefix of the smaller, which is the shorter of the two, since
   the smaller set must be covered nearly whole. Each list of an n-gram and
   size band proposes pairs with its most shared member, a number linear in the
   postings.
4. A pair's overlap is counted in each vertical fragment and summed.
5. Links give components. Then every pair of a probing and an indexing prefix
   that is not yet in one component is counted too, so no link between
   components is lost. Pairs whose counts by fragment already rule out the
   threshold are left out. ``class_links`` lists the links inside components too.

No group is collected in one place: an n-gram that is frequent in a batch of
documents goes on once for the batch, frequencies return by batch, hot posting
lists meet one pivot row, and copies of a hot class meet its row salted.

Cases: a null or empty text, or one of white space, has an empty set, is linked
with nothing and is a component of its own; a text of fewer words than an n-gram
is one n-gram; repeated rows come out one by one; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import arrays as A
from tessella.llm.components import components
from tessella.llm.sharing import BATCH, KEY, KEY_DTYPE, MAX_OWNERS, SLICE_TYPE, cut, entries, fragment_of, held_by_several, idents
from tessella.llm.stage import bounded_batches, release, save, text_key, without

N = 5
#: Links: DEN * intersection >= NUM * union.
NUM, DEN = 75, 100
#: N-grams of one fragment, about: bounds a worker's memory.
FRAGMENT = 1_500_000
#: Share of its n-grams that a set sends on first beyond those that a linked set may lack.
EXTRA = 0.15
#: Vertical fragments of the exact count, and of the counts that bound it.
PARTS, BOUNDS = 4, 64
#: N-grams of the classes of one bucket, about, when frequencies are counted.
BUCKET_GRAMS = 200_000
#: Rows of a class that meet its component in one place are dealt over so many.
SALTS = 16


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): each document's distinct n-grams in ascending order, back to back."""
    low = A.LOWER[data]
    starts, ends, first = A.words(low, off, A.NOT_SPACE)
    h = A.hash_words(low, starts, ends)
    count = np.diff(first)
    grams = np.concatenate([A.hash_grams(h, n), np.zeros(min(n - 1, len(h)), A.U64)])
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    flat = grams[A.ranges(first[:-1], size)]
    begin = np.cumsum(size) - size
    for k in range(1, n):  # short texts: the whole sequence
        few = np.flatnonzero(count == k)
        if len(few):
            flat[begin[few]] = A.hash_grams_at(h, first[few], k) + A.U64(k)
    for a, m in zip(begin.tolist(), size.tolist(), strict=True):
        flat[a : a + m].sort()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[begin[size > 0]] = True
    ends_at = np.concatenate([[0], np.cumsum(new)])
    return flat[new], ends_at[begin + size] - ends_at[begin]


def set_keys(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """128-bit hash of each set as two int64 columns."""
    out = np.zeros((len(size), 2), A.U64)
    full = np.flatnonzero(size)
    if len(full):
        begin = (np.cumsum(size) - size)[full]
        for j in (0, 1):
            out[full, j] = np.add.reduceat(A.mix(flat ^ A.GRAM_KEYS[40 + j]), begin)
    return out.view(np.int64)


def keys(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for part, data, off in A.chunks(batches):
        flat, size = shingle_sets(data, off, n)
        key = set_keys(flat, size)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size, pa.int32()), pa.array(key[:, 0]), pa.array(key[:, 1])], names=["doc_id", "key", "n", "hi", "lo"])


def beyond(size: np.ndarray) -> np.ndarray:
    """N-grams that a set sends on beyond those that a linked set may lack."""
    return 1 + (size * EXTRA).astype(np.int64)


def missing(size: np.ndarray, num: int, den: int) -> np.ndarray:
    """N-grams that a linked set may lack, at most."""
    return size - -(-size * num // den)


def first_slices(batches: Iterator[pa.RecordBatch], n: int, num: int, den: int, fragments: int) -> Iterator[pa.RecordBatch]:
    """The first n-grams of each different set of a batch, cut by fragment."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    grams = owners = 0

    def flush() -> pa.RecordBatch:
        flat, sent = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        table, index = np.unique(np.concatenate([h[2] for h in held]), return_index=True)
        own = flat[A.ranges((np.cumsum(sent) - sent)[index], sent[index])]
        return cut(own, np.repeat(np.arange(len(index)), sent[index]), table, fragments)

    for _, data, off in A.chunks(batches):
        flat, size = shingle_sets(data, off, n)
        key = set_keys(flat, size)
        table = np.zeros(len(size), KEY_DTYPE)
        table["n"], table["hi"], table["lo"] = size, key[:, 0], key[:, 1]
        sent = np.minimum(missing(size, num, den) + beyond(size), size)
        first = flat[A.ranges(np.cumsum(size) - size, sent)]
        if held and (grams + len(first) > BATCH or owners + len(size) > MAX_OWNERS):
            yield flush()
            held, grams, owners = [], 0, 0
        held.append((first, sent, table))
        grams, owners = grams + len(first), owners + len(size)
    if held:
        yield flush()


HELD = pa.schema([("n", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()), ("c", pa.int64())])


def held_counts(group: pa.Table, fragments: int) -> pa.Table:
    """Of each set, how many of a fragment's n-grams other sets have as well."""
    grams, owners, table = entries(group, fragments)
    if not len(table):
        return HELD.empty_table()
    ident = idents(table)
    if group["grp"][0].as_py() < fragments and len(grams):
        owners = owners[held_by_several(grams, owners, ident) & (owners >= 0)]
    count = np.bincount(owners, minlength=len(table))
    # an equal set of another batch counts the same n-grams: the greater of the two
    order = np.lexsort((-count, ident))
    order = order[np.r_[True, ident[order][1:] != ident[order][:-1]]]
    order = order[count[order] > 0]
    mine = table[order]
    A.give_back()
    return pa.Table.from_arrays([pa.array(mine["n"]), pa.array(mine["hi"]), pa.array(mine["lo"]), pa.array(count[order].astype(np.int64))], schema=HELD)


def whole_sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """(cid, n, grams) of rows (doc_id, text, n, hi, lo, cid) whose text has that set."""
    for part, data, off in A.chunks(batches):
        flat, size = shingle_sets(data, off, n)
        key = set_keys(flat, size)
        same = np.flatnonzero((key[:, 0] == part.column(3).to_numpy()) & (key[:, 1] == part.column(4).to_numpy()))
        begin = np.cumsum(size) - size
        own = flat[A.ranges(begin[same], size[same])]
        yield pa.RecordBatch.from_arrays([part.column(5).take(pa.array(same)), pa.array(size[same], pa.int32()), A.binary_rows(own, size[same])], names=["cid", "n", "grams"])


def candidates(docs: DataFrame, classes: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(cid, n, grams) of the classes that share enough n-grams with others to have a link."""
    total = (classes.agg(F.sum("n").alias("t")).first()["t"] or 0) * (1 - num / den + EXTRA)
    fragments = max(2, math.ceil(total / FRAGMENT))
    parts = docs.mapInArrow(lambda it: first_slices(it, n, num, den, fragments), SLICE_TYPE)
    held = parts.groupBy("grp").applyInArrow(lambda t: held_counts(t, fragments), f"{KEY}, c long").groupBy("n", "hi", "lo").agg(F.sum("c").alias("c"))
    # a linked set may be smaller, and then shares no more than it sends beyond
    least = F.floor(F.ceil(F.col("n") * num / den) * EXTRA) + 1
    left = save(held.where(F.col("c") >= least).join(classes, ["n", "hi", "lo"]).select(F.col("least").alias("doc_id"), "n", "hi", "lo", "cid"), "sharing_classes")
    left = left.withColumnRenamed("doc_id", "least").hint("merge")  # grows with the corpus
    return docs.drop("key").join(left, F.col("doc_id").eqNullSafe(F.col("least"))).select("doc_id", "text", "n", "hi", "lo", "cid").mapInArrow(lambda it: whole_sets(it, n), "cid long, n int, grams binary")


def one_a_class(rows: pa.Table) -> pa.Table:
    """Rows that repeat a doc_id and its text come once."""
    _, index = np.unique(rows["cid"].to_numpy(), return_index=True)
    return rows if len(index) == rows.num_rows else rows.take(pa.array(index))


def flat_grams(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All n-grams of the rows' blobs, and how many each row has."""
    data, off = A.utf8_views(table["grams"].combine_chunks() if table["grams"].num_chunks != 1 else table["grams"].chunk(0))
    return np.frombuffer(data.tobytes(), A.U64), np.diff(off) // 8


COUNTS = pa.schema([("frag", pa.int32()), ("bucket", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
FREQS = pa.schema([("bucket", pa.int32()), ("frag", pa.int32()), ("counts", pa.binary())])
ORDERED = "cid long, n int, s int, probe array<long>, own int, bound array<int>, grams binary"


def count_grams(group: pa.Table, fragments: int) -> pa.Table:
    flat, _ = flat_grams(one_a_class(group))
    grams, counts = np.unique(flat, return_counts=True)
    part = fragment_of(grams, fragments)
    edge = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
    rows = [(int(part[a]), grams[a:b].tobytes(), counts[a:b].astype(np.uint32).tobytes()) for a, b in zip(edge[:-1], edge[1:], strict=True) if b > a]
    bucket = group["bucket"][0].as_py()
    return pa.Table.from_pylist([{"frag": f, "bucket": bucket, "grams": g, "counts": c} for f, g, c in rows], COUNTS)


def sum_counts(group: pa.Table) -> pa.Table:
    grams = [np.frombuffer(x.as_buffer(), A.U64) for x in group["grams"]]
    each, where = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.zeros(len(each), np.int64)
    np.add.at(total, where.ravel(), np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in group["counts"]]))
    back = np.minimum(total, 2**32 - 1).astype(np.uint32)[where.ravel()]
    edge = np.cumsum([0, *map(len, grams)])
    return pa.Table.from_arrays([group["bucket"].combine_chunks(), group["frag"].combine_chunks(), pa.array([back[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())], schema=FREQS)


def ordered(rows: pa.Table, freqs: pa.Table, num: int, den: int) -> pa.Table:
    """Prefixes, fragment counts and the n-grams that others have, of each class of a bucket.

    ``probe`` is the prefix by which a class looks for smaller ones, and its
    first ``own`` n-grams are those under which it is found by larger ones.
    """
    schema = pa.schema([("cid", pa.int64()), ("n", pa.int32()), ("s", pa.int32()), ("probe", pa.list_(pa.int64())), ("own", pa.int32()), ("bound", pa.list_(pa.int32())), ("grams", pa.binary())])
    if not rows.num_rows:
        return schema.empty_table()
    rows = one_a_class(rows)
    flat, size = flat_grams(rows)
    each, where = np.unique(flat, return_inverse=True)
    parts = freqs.sort_by("frag")["counts"]
    df = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in parts])[where.ravel()]
    assert len(each) == sum(len(x.as_buffer()) for x in parts) // 4
    out, begin = [], np.cumsum(size) - size
    for cid, n, a, m in zip(rows["cid"].to_pylist(), rows["n"].to_pylist(), begin.tolist(), size.tolist(), strict=True):
        held = df[a : a + m] > 1
        g, d = flat[a : a + m][held], df[a : a + m][held]
        s = len(g)
        probe = s - -(-n * num // den) + 1  # a smaller set shares num/den of n
        if probe < 1:
            continue
        own = max(0, s - -(-2 * n * num // (num + den)) + 1)  # a larger one shares more
        order = np.lexsort((g, d))[:probe]
        out.append((cid, n, s, g[order].view(np.int64), own, np.bincount(fragment_of(g, BOUNDS), minlength=BOUNDS), g.tobytes()))
    A.give_back()
    if not out:
        return schema.empty_table()
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def with_prefixes(found: DataFrame, num: int, den: int) -> DataFrame:
    total = found.agg(F.sum(F.length("grams")).alias("t")).first()["t"] or 0
    count = max(1, math.ceil(total / 8 / BUCKET_GRAMS))
    rows = found.withColumn("bucket", F.pmod(F.xxhash64("cid"), F.lit(count)).cast("int"))
    counted = rows.select("bucket", "cid", "grams").groupBy("bucket").applyInArrow(lambda t: count_grams(t, count), "frag int, bucket int, grams binary, counts binary")
    freqs = counted.groupBy("frag").applyInArrow(sum_counts, "bucket int, frag int, counts binary")
    return rows.groupBy("bucket").cogroup(freqs.groupBy("bucket")).applyInArrow(lambda a, b: ordered(a, b, num, den), ORDERED)


def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cid, part, seg): the n-grams of a class in each vertical part."""
    for batch in batches:
        flat, size = flat_grams(pa.Table.from_batches([batch]))
        cids = batch.column(0).to_numpy()
        row = np.repeat(np.arange(len(size)), size)
        key = row * PARTS + fragment_of(flat, PARTS)  # ascending: n-grams are sorted within a class
        edge = np.searchsorted(key, np.arange(len(size) * PARTS + 1))
        seg = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.array(flat.view(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(cids, PARTS)), pa.array(np.tile(np.arange(PARTS, dtype=np.int32), len(size))), seg], names=["cid", "part", "seg"])
    A.give_back()


def can_link(n1: str, s1: str, n2: str, s2: str, num: int, den: int) -> Column:
    """Sizes and shared sizes let the two classes link: overlap * (num + den) >= num * (n1 + n2)."""
    c = F.col
    return (F.least(c(n1), c(n2)) * den >= F.greatest(c(n1), c(n2)) * num) & (F.least(c(s1), c(s2)) * (num + den) >= (c(n1) + c(n2)) * num)


def linked(pairs: DataFrame, segments: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, n1, n2) whose partial overlaps, summed over the vertical parts, reach the threshold.

    Both joins deal the segments alike, so they are shuffled once.
    """
    left = segments.select(F.col("cid").alias("a"), "part", F.col("seg").alias("seg1")).hint("merge")
    right = segments.select(F.col("cid").alias("b"), "part", F.col("seg").alias("seg2")).hint("merge")
    each = pairs.withColumn("part", F.explode(F.array(*[F.lit(i) for i in range(PARTS)])))
    partial = each.join(left, ["a", "part"]).join(right, ["b", "part"]).select("a", "b", "n1", "n2", F.size(F.array_intersect("seg1", "seg2")).alias("o"))
    summed = partial.groupBy("a", "b", "n1", "n2").agg(F.sum("o").alias("o"))
    return summed.where(F.col("o") * (num + den) >= (F.col("n1") + F.col("n2")) * num).select("a", "b")


def postings(found: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(probes, index): rows (gram, b, cid, n, s) of the probing and indexing prefixes, by n-gram and size band."""
    width = math.log(den / num) + 1e-9
    k = F.floor(F.log("n") / width).cast("int")
    sized = found.withColumn("b", k)
    probes = sized.select("cid", "n", "s", F.explode("probe").alias("gram"), F.array("b", F.col("b") - 1).alias("b")).withColumn("b", F.explode("b"))
    index = sized.where("own > 0").select("cid", "n", "s", F.explode(F.slice("probe", F.lit(1), F.col("own"))).alias("gram"), "b")
    return probes, index


def star_pairs(found: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, n1, n2) of each probing posting and the most shared class of its list."""
    probes, index = postings(found, num, den)
    rank = F.struct((F.col("n") - F.col("s")) / F.col("n"), F.col("cid"))
    pivots = index.groupBy("gram", "b").agg(F.min_by(F.struct("cid", "n", "s"), rank).alias("p")).select("gram", "b", F.col("p.cid").alias("pc"), F.col("p.n").alias("pn"), F.col("p.s").alias("ps"))
    star = probes.join(pivots.hint("merge"), ["gram", "b"]).where((F.col("cid") != F.col("pc")) & can_link("n", "s", "pn", "ps", num, den))
    first = F.col("cid") < F.col("pc")
    return star.select(F.least("cid", "pc").alias("a"), F.greatest("cid", "pc").alias("b"), F.when(first, F.col("n")).otherwise(F.col("pn")).alias("n1"), F.when(first, F.col("pn")).otherwise(F.col("n")).alias("n2")).distinct()


def torn_rows(found: DataFrame, near: DataFrame, num: int, den: int) -> DataFrame:
    """(gram, b, cid, n, s, comp, owned, code): postings of the lists that hold several components.

    Most lists do not. A probing and an indexing (``owned``) posting of one code
    meet: those of a list's main component, that of its most shared class, do not
    meet each other.
    """
    probes, index = postings(found, num, den)
    rows = probes.withColumn("owned", F.lit(False)).union(index.withColumn("owned", F.lit(True)))
    rows = rows.join(near.hint("merge"), F.col("cid") == near["node"], "left").select(*rows.columns, F.coalesce("component", "cid").alias("comp"))
    lists = rows.groupBy("gram", "b").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("owned").alias("any")).where("lo <> hi and any").select("gram", "b")
    torn = save(rows.join(save(lists, "torn_lists").hint("merge"), ["gram", "b"]), "torn_rows")
    rank = F.struct((F.col("n") - F.col("s")) / F.col("n"), F.col("cid"))
    major = torn.groupBy("gram", "b").agg(F.min_by("comp", rank).alias("major"))
    main = F.col("comp") == F.col("major")
    code = F.when(F.col("owned"), F.when(main, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))).otherwise(F.when(main, F.array(F.lit(0))).otherwise(F.array(F.lit(1))))
    return torn.join(major.hint("merge"), ["gram", "b"]).select(*torn.columns, F.explode(code).alias("code"))


def torn_pairs(found: DataFrame, near: DataFrame | None, num: int, den: int) -> DataFrame:
    """Pairs (a, b, n1, n2) of a probing and an indexing posting of one list, in different components of ``near``.

    Each pair comes once: from the first n-gram that its two prefixes share.
    """
    if near is None:
        probes, index = (x.withColumn("comp", F.col("cid")).withColumn("code", F.lit(0)) for x in postings(found, num, den))
    else:
        rows = torn_rows(found, near, num, den)
        probes, index = rows.where("not owned"), rows.where("owned")
    more = found.select("cid", "probe", "own", "bound").hint("merge")
    columns = ("cid", "n", "s", "comp")
    x = probes.join(more, "cid").select("gram", "b", "code", *[F.col(c).alias(c + "1") for c in columns], F.col("probe").alias("probe1"), F.col("bound").alias("bound1"))
    y = index.join(more, "cid").select("gram", "b", "code", *[F.col(c).alias(c + "2") for c in columns], F.slice("probe", F.lit(1), F.col("own")).alias("own2"), F.col("bound").alias("bound2"))
    larger = (F.col("n1") > F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("cid1") > F.col("cid2")))
    most = F.aggregate(F.zip_with("bound1", "bound2", lambda p, q: F.least(p, q)), F.lit(0), lambda t, v: t + v)
    once = F.get(F.array_intersect("probe1", "own2"), F.lit(0)) == x["gram"]
    same = (x["gram"] == y["gram"]) & (x["b"] == y["b"]) & (x["code"] == y["code"])
    both = x.join(y.hint("merge"), same & (F.col("comp1") != F.col("comp2")) & larger & can_link("n1", "s1", "n2", "s2", num, den) & (most * (num + den) >= (F.col("n1") + F.col("n2")) * num) & once)
    turned = F.col("cid1") > F.col("cid2")
    return both.select(F.least("cid1", "cid2").alias("a"), F.greatest("cid1", "cid2").alias("b"), F.when(turned, F.col("n2")).otherwise(F.col("n1")).alias("n1"), F.when(turned, F.col("n1")).otherwise(F.col("n2")).alias("n2"))


def segments_of(found: DataFrame) -> DataFrame:
    return save(found.select("cid", "grams").mapInArrow(segment, "cid long, part int, seg array<long>"), "segments")


def links_between(found: DataFrame, num: int, den: int) -> DataFrame:
    """(node, component) of classes that have a link; component is the least cid."""
    segments, found = segments_of(found), save(found.drop("grams"), "prefixes")
    near = components(linked(star_pairs(found, num, den), segments, num, den), "a", "b")
    torn = save(torn_pairs(found, near, num, den), "torn_pairs")
    bridges = save(linked(torn, segments, num, den), "bridges")
    release(segments, found)
    if bridges.isEmpty():
        release(bridges)
        return near
    final = components(bridges.union(near.select("node", "component").where("node <> component")), "a", "b")
    release(near, bridges)
    return final


def class_sets(docs: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows' set keys, classes, ordered sets of the classes that may have links)."""
    bounded_batches(docs.sparkSession)
    own = save(docs.mapInArrow(lambda it: keys(it, n), f"doc_id long, key long, {KEY}"), "set_keys")
    classes = own.where("n > 0").groupBy("n", "hi", "lo").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    classes = save(classes.withColumn("cid", F.monotonically_increasing_id()), "set_classes")
    found = save(candidates(docs, classes, n, num, den), "sharing_sets")
    sets = save(with_prefixes(found, num, den), "ordered_sets")
    release(found)
    return own, classes, sets


def texts_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("key"), F.col(text_col).cast("string").alias("text"))


def ngram_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id reachable by links) of each row of ``docs``.

    Its key tells rows of one doc_id apart. Two documents link when den * intersection >= num * union of their n-gram
    sets; num/den must be above a half.
    """
    own, classes, sets = class_sets(texts_of(docs, id_col, text_col), n, num, den)
    near = links_between(sets, num, den)
    release(sets)
    joined = classes.join(near, F.col("cid") == near["node"]).select("n", "hi", "lo", "component", "least")
    least = joined.groupBy("component").agg(F.min("least").alias("to"))
    moved = joined.join(least, "component").select("n", "hi", "lo", "to")
    grouped = classes.join(moved, ["n", "hi", "lo"], "left").select("n", "hi", "lo", "rows", F.coalesce("to", "least").alias("component_id"), "least")
    # a document alone in its class and component is its own; the others meet their class salted
    several = grouped.where("rows > 1 or component_id <> least").select("n", "hi", "lo", "component_id")
    several = save(several.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))), "components")
    salted = own.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(several, ["n", "hi", "lo", "salt"], "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "key")


def class_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """(a, b): every link between different sets, by the least doc_id of each, a's class before b's.

    A document's class is that of ngram_groups() rows with its n-gram set.
    """
    _, classes, sets = class_sets(texts_of(docs, id_col, text_col), n, num, den)
    segments = segments_of(sets)
    links = save(linked(torn_pairs(sets, None, num, den), segments, num, den), "class_links")
    left = classes.select(F.col("cid").alias("a"), F.col("least").alias("x"))
    right = classes.select(F.col("cid").alias("b"), F.col("least").alias("y"))
    return links.join(left, "a").join(right, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One document of each group, that of the least id; all columns are kept."""
    return without(docs, ngram_groups(docs, id_col=id_col, text_col=text_col, **how).where("doc_id <> component_id"), id_col, text_col)
