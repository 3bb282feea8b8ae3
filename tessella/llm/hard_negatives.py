"""Hard negatives by product quantisation with stored residual norms.

Vectors become whole numbers, floor(SCALE * component). Each is cut into
subspaces of WIDTH components; a subspace keeps the number of its nearest of
CENTROIDS centroids, and each group of GROUP subspaces the norm of what the
centroids leave. For an anchor, a table of its products with all centroids gives
a score by lookups, and the products of norms bound how far it is off, so

    table - bound <= exact score <= table + bound

holds for every pair. Only rows whose interval reaches into what is asked for,
the best K so far of a label or of a window of scores, are scored exactly in
integers; so results are those of a full search, ties included.

1. The rows are written once as integers with a number of their own.
2. Codebooks are fitted by k-means, one task a subspace, on the FIT_ROWS rows of
   least hash; every row is encoded. Rows travel in blocks of BLOCK.
3. Blocks are dealt over cells, and blocks of anchors go to every cell. There,
   the best positives of each anchor are found, one partial list a cell; Spark
   takes the best of these.
4. With their windows, the anchors go over all cells again for the negatives.

Work is anchors x rows, in blocks; rows are shuffled twice in all, anchors once a
cell. No label, vector or anchor is a group of its own anywhere, so hot ones
weigh no more than others.

Cases: rows without id, label or vector, or with a null or non-finite component,
take no part; shorter vectors end in zeros; whole numbers stay within
+-2**24; of equal scores the least id comes first; rows that repeat an id are
rows like others, as anchors too; an anchor without positives, and a positive
whose window is empty, give no rows; a negative positive score has an empty
window; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm import arrays as A
from tessella.llm.stage import release, save
from tessella.session import ship

SCALE = 256
#: Whole numbers stay within this, so that scores fit 64 bits.
LARGEST = 1 << 24
#: Components of a subspace, centroids of a subspace, subspaces that share a residual norm.
WIDTH, CENTROIDS, GROUP = 2, 256, 4
#: Rows that the codebooks are fitted on, at most, and rounds of k-means.
FIT_ROWS, ROUNDS = 8192, 6
#: Rows and anchors of a block; blocks of rows of a cell, at most.
BLOCK, ANCHORS, CELL = 1024, 256, 64
#: Pairs that are scored exactly at a time.
PAIRS = 1 << 16

ROW_BLOCK = "block long, uids binary, ids binary, labels binary, vectors binary, codes binary, rest binary"
ANCHOR_BLOCK = "number long, a_uids binary, a_ids binary, a_labels binary, a_vectors binary, windows binary"
FOUND = "uid long, anchor_id long, place int, positive_id long, positive_score long, other_id long, score long"
WINDOW = np.dtype([("id", "<i8"), ("score", "<i8"), ("low", "<i8"), ("high", "<i8"), ("open", "?")])


def whole_numbers(vectors: DataFrame, anchors: Column, id_col: str, label_col: str | Column, vector_col: str) -> DataFrame:
    """(vec_id, label, anchor, v) of the rows that take part."""
    x = F.col(vector_col)
    fits = F.forall(x, lambda c: F.coalesce(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    label = F.col(label_col) if isinstance(label_col, str) else label_col
    v = F.transform(x, lambda c: F.floor(F.greatest(F.least(F.lit(float(SCALE)) * c.cast("double"), F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    return vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & x.isNotNull() & fits).select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("anchor"), v.alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """(rows, dims) of a column of lists; shorter ones end in zeros."""
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), dims), np.int32)
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, A.ranges(np.zeros(len(lengths), np.int64), lengths)] = flat
    return out


def codebook(points: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """(k, width) centroids of the rows of ``points`` by k-means from evenly spaced different rows."""
    different = np.unique(points, axis=0)
    centres = different[np.linspace(0, len(different) - 1, k).astype(np.int64)].astype(np.float64)
    for _ in range(rounds):
        near = nearest(points, centres)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=points[:, j], minlength=k) for j in range(points.shape[1])], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres * centres).sum(1)[None, :] - 2.0 * (points @ centres.T), axis=1)


def fit(rows: DataFrame, dims: int) -> np.ndarray:
    """(subspaces, CENTROIDS, WIDTH) codebooks, fitted on FIT_ROWS rows, one task a subspace."""
    subspaces = math.ceil(dims / WIDTH)
    sample = rows.select("v", F.xxhash64("vec_id").alias("h")).orderBy("h", "v").limit(FIT_ROWS)
    parts = sample.select(F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(subspaces - 1)), lambda m: F.transform(F.sequence(F.lit(1), F.lit(WIDTH)), lambda j: F.coalesce(F.get("v", m * WIDTH + j - 1), F.lit(0))))).alias("m", "x"))

    def one(table: pa.Table) -> pa.Table:
        points = matrix(table.column("x").combine_chunks(), WIDTH).astype(np.float64)
        return pa.table({"m": table.column("m")[:1], "centres": pa.array([codebook(points).tobytes()])})

    books = np.zeros((subspaces, CENTROIDS, WIDTH))
    for r in parts.groupBy("m").applyInArrow(one, "m int, centres binary").collect():  # bounded: floats of the codebooks
        books[r["m"]] = np.frombuffer(r["centres"], np.float64).reshape(CENTROIDS, WIDTH)
    return books


def group_norms(squares: np.ndarray) -> np.ndarray:
    """Norms of groups of GROUP subspaces from their (rows, subspaces) squared norms."""
    return np.sqrt(np.add.reduceat(squares, np.arange(0, squares.shape[1], GROUP), axis=1))


def by_subspace(v: np.ndarray, subspaces: int) -> np.ndarray:
    out = np.zeros((len(v), subspaces * WIDTH))
    out[:, : v.shape[1]] = v
    return out.reshape(len(v), subspaces, WIDTH)


def encode(v: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, residual norms of the groups, rounded up) of integer vectors."""
    x = by_subspace(v, len(books))
    codes = np.empty((len(v), len(books)), np.uint8)
    squares = np.empty((len(v), len(books)))
    for m, centres in enumerate(books):
        codes[:, m] = nearest(x[:, m], centres)
        squares[:, m] = ((x[:, m] - centres[codes[:, m]]) ** 2).sum(1)
    return codes, np.nextafter(group_norms(squares).astype(np.float32), np.float32(np.inf))


def regrouped(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of record batches in tables of ``size``, the last one shorter."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= size:
            table, at = pa.Table.from_batches(held), 0
            while n - at >= size:
                yield table.slice(at, size).combine_chunks()
                at += size
            held, n = table.slice(at).to_batches(), n - at
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def packed(names: list[str], *values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) if isinstance(v, np.ndarray) else pa.array([v], pa.int64()) for v in values], names=names)


def row_blocks(rows: DataFrame, books: np.ndarray, dims: int) -> DataFrame:
    names = [c.split()[0] for c in ROW_BLOCK.split(", ")]
    shared = rows.sparkSession.sparkContext.broadcast(books)  # bounded: 256 centroids of each subspace

    def pack(batches):
        for t in regrouped(batches, BLOCK):
            v = matrix(t.column("v").chunk(0), dims)
            label = t.column("label").to_numpy()
            order = np.argsort(label, kind="stable")
            v, uid = v[order], t.column("uid").to_numpy()[order]
            codes, rest = encode(v, shared.value)
            yield packed(names, int(uid[0]), uid, t.column("vec_id").to_numpy()[order], label[order], v, codes, rest)

    return rows.select("uid", "vec_id", "label", "v").mapInArrow(pack, ROW_BLOCK)


def anchor_blocks(anchors: DataFrame, n: int, dims: int) -> DataFrame:
    """Blocks of ANCHORS anchors, by label; ``windows`` has as many entries for each as its block needs."""
    names = [c.split()[0] for c in ANCHOR_BLOCK.split(", ")]

    def pack(batches):
        for t in regrouped(batches, ANCHORS):
            uid = t.column("uid").to_numpy()
            wide = t.column("windows").to_pylist()
            windows = np.zeros((len(uid), max(1, *map(len, wide))), WINDOW)
            for i, ws in enumerate(wide):
                for j, w in enumerate(ws):
                    windows[i, j] = (w["id"], w["score"], w["low"], w["high"], True)
            yield packed(names, int(uid[0]), uid, t.column("vec_id").to_numpy(), t.column("label").to_numpy(), matrix(t.column("v").chunk(0), dims), windows)

    dealt = anchors.repartition(max(1, math.ceil(n / (8 * ANCHORS)))).sortWithinPartitions("label")
    return dealt.select("uid", "vec_id", "label", "v", "windows").mapInArrow(pack, ANCHOR_BLOCK)


class Search:
    """The best of one block of anchors over the blocks of rows that it has met."""

    def __init__(self, block: dict, books: np.ndarray, dims: int, k: int, same: bool) -> None:
        self.books, self.dims, self.k, self.same = books, dims, k, same
        self.uid, self.id, self.label = (np.frombuffer(block[c], np.int64) for c in ("a_uids", "a_ids", "a_labels"))
        self.v = np.frombuffer(block["a_vectors"], np.int32).reshape(len(self.uid), dims)
        self.windows = np.frombuffer(block["windows"], WINDOW).reshape(len(self.uid), -1)
        self.places = self.windows.shape[1]
        x = by_subspace(self.v, len(books))
        self.tables = np.einsum("amw,mkw->mka", x, books)
        self.norms = group_norms((x * x).sum(2))
        self.length = np.sqrt((self.v.astype(np.float64) ** 2).sum(1))
        self.key = self.score = self.other = np.empty(0, np.int64)
        #: Of each anchor and window, the score of the k-th best so far.
        self.least = np.full((len(self.uid), self.places), -(2**62))

    def meet(self, block: dict) -> None:
        label = np.frombuffer(block["labels"], np.int64)
        rows = tuple(np.frombuffer(block[c], kind).reshape(len(label), -1) for c, kind in (("uids", np.int64), ("ids", np.int64), ("vectors", np.int32), ("codes", np.uint8), ("rest", np.float32)))
        if not self.same:
            self.part(rows, label, slice(0, len(label)), slice(0, len(self.uid)))
            return
        for x in np.intersect1d(label, self.label):  # both are in order of label
            self.part(rows, label, *(slice(int(np.searchsorted(of, x)), int(np.searchsorted(of, x, "right"))) for of in (label, self.label)))

    def part(self, rows: tuple, label: np.ndarray, r: slice, a: slice) -> None:
        uid, ids, v, codes, rest = (x[r] for x in rows)
        table = np.zeros((len(codes), a.stop - a.start))
        for m in range(codes.shape[1]):
            table += self.tables[m][codes[:, m], a]
        v_length = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        bound = rest.astype(np.float64) @ self.norms[a].T + 1e-9 * (1 + v_length[:, None] * self.length[None, a])
        may = (uid != self.uid[None, a]) if self.same else (label[r][:, None] != self.label[None, a])
        least, most = table - bound, table + bound
        inside = np.zeros_like(may)
        for w in range(self.places):
            win = self.windows[a, w]
            inside |= may & win["open"][None, :] & (most >= np.maximum(win["low"], self.least[a, w])[None, :]) & (least <= win["high"][None, :])
        i, j = np.nonzero(inside)
        for at in range(0, len(i), PAIRS):
            self.exact(i[at : at + PAIRS], j[at : at + PAIRS] + a.start, v, ids[:, 0])

    def exact(self, i: np.ndarray, j: np.ndarray, v: np.ndarray, ids: np.ndarray) -> None:
        """Score pairs of rows and anchors in integers and keep the best of each window."""
        score = np.einsum("pd,pd->p", v[i].astype(np.int64), self.v[j].astype(np.int64))
        new = [(self.key, self.score, self.other)]
        for w in range(self.places):
            win = self.windows[j, w]
            ok = win["open"] & (score >= win["low"]) & (score <= win["high"]) & (score >= self.least[j, w])
            new.append((j[ok] * self.places + w, score[ok], ids[i[ok]]))
        key, score, other = (np.concatenate(c) for c in zip(*new))
        order = np.lexsort((other, -score, key))
        key, score, other = key[order], score[order], other[order]
        rank = np.arange(len(key)) - np.searchsorted(key, key)
        keep = rank < self.k
        full = rank == self.k - 1
        self.least.reshape(-1)[key[full]] = score[full]
        self.key, self.score, self.other = key[keep], score[keep], other[keep]

    def found(self) -> pa.RecordBatch:
        a, w = self.key // self.places, self.key % self.places
        win = self.windows[a, w]
        return pa.RecordBatch.from_arrays([pa.array(self.uid[a]), pa.array(self.id[a]), pa.array(w.astype(np.int32)), pa.array(win["id"]), pa.array(win["score"]), pa.array(self.other), pa.array(self.score)], names=[c.split()[0] for c in FOUND.split(", ")])


def search(anchors: DataFrame, n: int, blocks: DataFrame, cells: int, books: np.ndarray, dims: int, k: int, same: bool) -> DataFrame:
    """FOUND rows: of each anchor and window, the best ``k`` of each cell."""
    shared = anchors.sparkSession.sparkContext.broadcast(books)
    wanted = anchor_blocks(anchors, n, dims).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))))
    dealt = blocks.withColumn("cell", F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int"))
    left, right = [c.split()[0] for c in ANCHOR_BLOCK.split(", ")], [c.split()[0] for c in ROW_BLOCK.split(", ")]

    def run(batches):
        now, at = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                number = batch.column(0)[row].as_py()
                if at != number:  # pairs come anchors by anchors; any other order is only slower
                    if now is not None:
                        yield now.found()
                    now, at = Search({c: batch.column(i)[row].as_py() for i, c in enumerate(left)}, shared.value, dims, k, same), number
                now.meet({c: batch.column(len(left) + i)[row].as_py() for i, c in enumerate(right)})
        if now is not None:
            yield now.found()

    # a sorted merge holds the blocks of one cell, CELL at most; no side is broadcast, since anchors repeat by cell
    return wanted.join(dealt.hint("merge"), "cell").select(*left, *right).mapInArrow(run, FOUND)


def best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "other_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Column, *, id_col: str = "vec_id", label_col: str | Column = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``anchors`` says which rows are anchors. Of each, the ``positives`` best other
    rows of its label, and for each of these the ``negatives`` best rows of other
    labels whose scores are ``low`` to ``high`` percent of the positive's.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = save(whole_numbers(vectors, anchors, id_col, label_col, vector_col).withColumn("uid", F.monotonically_increasing_id()), "whole_numbers")
    size = rows.agg(F.max(F.size("v")).alias("dims"), F.count_if("anchor").alias("anchors")).first()
    dims, n = size["dims"] or 1, size["anchors"]
    books = fit(rows, dims)
    blocks = save(row_blocks(rows, books, dims), "row_blocks")
    count = blocks.count()
    cells = max(min(count, CELL), math.ceil(count / CELL), 1)
    chosen = rows.where("anchor")
    anywhere = F.array(F.struct(F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("score"), F.lit(-(2**62)).alias("low"), F.lit(2**62).alias("high")))
    near = best(search(chosen.withColumn("windows", anywhere), n, blocks, cells, books, dims, positives, True), ["uid"], positives)
    window = F.struct("rank", F.col("other_id").alias("id"), "score", F.expr(f"({low} * score + 99) div 100").alias("low"), F.expr(f"({high} * score) div 100").alias("high"))
    with_windows = save(near.where("score >= 0").groupBy("uid").agg(F.sort_array(F.collect_list(window)).alias("windows")), "windows")
    wanted = save(chosen.join(with_windows, "uid"), "anchors")
    hard = best(search(wanted, n, blocks, cells, books, dims, negatives, False), ["uid", "place"], negatives)
    out = save(hard.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "hard_negatives")
    release(rows, blocks, with_windows, wanted)
    return out
