"""Toxicity by gradient-boosted trees over dense features.

The features of a text are densities of words from a lexicon, also of words
that are spelled around it (digits and signs for letters, repeated or spaced
letters), closeness of lexicon words to the second person, and rates of
capitals, punctuation and obfuscated words. The lexicon is what labelled rows say
more often in toxic texts. It is cross-fitted: the rows are dealt into FOLDS, and
each has its features by the lexicon of the other folds, as new texts have them.
Trees are fitted on all rows, and isotonic regression calibrates them by margins
that trees of the other folds give; texts are scored with the lexicon of all.

Cases: a null or empty text is scored by its (zero) features; a doc_id with
several labels takes the greatest; without labels of both kinds every score is
the share of toxic labels, or 0; repeated rows are scored alike; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import arrays as A
from tessella.llm.boosting import Boosted, Isotonic
from tessella.llm.stage import bounded_batches

#: Labelled documents that the model is fitted on, at most (those of least hash).
FIT_DOCS = 40_000
#: Words of the lexicon, at most; documents that must have one; least ratio of its shares.
LEXICON, MIN_DOCS, MIN_RATIO = 4_000, 4, 3.0
FOLDS = 5
#: Second-person pronouns of English, German, French and Spanish.
SECOND = "you your yours yourself u ur du dich dir dein deine deinen deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
#: What stands for letters in obfuscated words.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "*": "", ".": "", "-": "", "_": "", "+": "t"}
NEAR = 6
FEATURES = ("lexicon_share", "lexicon_weight", "lexicon_count", "lexicon_most", "obfuscated_share", "near_second", "second_share", "capitals", "capital_words", "exclamations", "questions", "marks", "odd_words", "single_letters", "repeated_letters", "length")

EDGE = np.zeros(256, bool)  # bytes that are cut off a word's ends
EDGE[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
_SIGN = np.zeros(256, bool)
_SIGN[[*b"@$!+"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True


def word_keys(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    size = np.array([len(w) for w in words], np.int64)
    ends = np.cumsum(size + 1) - 1
    return A.hash_words(data, ends - size, ends)


SECOND_KEYS = np.unique(word_keys([w.encode() for w in SECOND]))


class Words:
    """Trimmed lower-case words of a chunk, with their hashes and documents."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.low = A.LOWER[data]
        starts, ends, first = A.words(self.low, off, A.NOT_SPACE)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
        self.raw = (starts.copy(), ends.copy())
        inner = np.flatnonzero(~EDGE[self.low])  # not punctuation
        inner = np.r_[-1, inner, len(data)]
        starts = np.minimum(inner[np.searchsorted(inner, starts)], ends)
        self.starts, self.ends = starts, np.maximum(inner[np.searchsorted(inner, ends) - 1] + 1, starts)
        full = self.ends > self.starts
        self.keys = np.zeros(len(starts), A.U64)
        if full.any():
            self.keys[full] = A.hash_words(self.low, self.starts[full], self.ends[full])

    def plain_forms(self) -> tuple[np.ndarray, np.ndarray]:
        """(words, hashes) of obfuscated words as they would be spelled plainly.

        A word has a form with the signs at its ends read as letters and one
        without them; a run of single letters is one word, at its first letter.
        """
        inner = np.concatenate([[0], np.cumsum(~_LETTER[self.low])])
        letters = np.concatenate([[0], np.cumsum(_LETTER[self.low])])
        a, b = self.raw
        same = np.zeros(len(self.low) + 1, np.int64)
        if len(self.low) > 2:
            run = np.zeros(len(self.low), bool)
            run[2:] = (self.low[2:] == self.low[1:-1]) & (self.low[1:-1] == self.low[:-2]) & _LETTER[self.low[2:]]
            same[1:] = np.cumsum(run)
        edges = np.zeros(len(a), bool)
        if len(a):  # signs for letters at the ends; an exclamation mark at the end is none
            edges = (self.starts > a) & _SIGN[self.low[self.starts - 1]] | (self.ends < b) & _SIGN[self.low[np.minimum(self.ends, len(self.low) - 1)]] & (self.low[np.minimum(self.ends, len(self.low) - 1)] != 0x21)
        odd = (inner[self.ends] - inner[self.starts] > 0) | (same[b] - same[a] > 0) | edges
        at, forms = [], []
        text = self.low.tobytes()
        for i in np.flatnonzero(odd & (letters[b] - letters[a] > 1)).tolist():
            for word in {plain(text[a[i] : b[i]]), plain(text[self.starts[i] : self.ends[i]])} - {b""}:
                at.append(i)
                forms.append(word)
        for i, j in self.spaced():
            word = plain(b"".join(text[x:y] for x, y in zip(self.starts[i:j].tolist(), self.ends[i:j].tolist(), strict=True)))
            if word:
                at.append(i)
                forms.append(word)
        return np.array(at, np.int64), word_keys(forms) if forms else np.empty(0, A.U64)

    def spaced(self) -> list[tuple[int, int]]:
        """(first, end) of runs of three single letters and more, in one document."""
        head = np.concatenate([[0], np.cumsum((self.low & 0xC0) != 0x80)])  # characters
        single = np.r_[False, head[self.ends] - head[self.starts] == 1, False]
        joint = single[1:-1].copy()
        joint[1:] &= self.doc[1:] == self.doc[:-1]
        begin = np.flatnonzero(single[1:-1] & ~(joint & single[:-2]))
        end = np.searchsorted(np.r_[np.flatnonzero(~(joint & single[:-2])), len(joint)], begin, "right")
        end = np.r_[np.flatnonzero(~(joint & single[:-2])), len(joint)][end]
        return [(i, j) for i, j in zip(begin.tolist(), end.tolist(), strict=True) if j - i > 2]


def plain(raw: bytes) -> bytes:
    word = raw.decode("utf-8", "replace").strip("'\"`´’,;:?()[]{}<>")
    out: list[str] = []
    for c in "".join(LEET.get(c, c) for c in word):  # no letter three times
        if not (len(out) > 1 and out[-1] == c == out[-2]):
            out.append(c)
    return "".join(out).encode()


def per_doc(n: int, doc: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(doc, weights=weights, minlength=n).astype(float)


class Lexicon:
    def __init__(self, keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.weights = keys[order], weights[order]

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Weight of each word, 0 for others."""
        if not len(self.keys):
            return np.zeros(len(keys))
        k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[k] == keys, self.weights[k], 0.0)


def features(data: np.ndarray, off: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    n = len(off) - 1
    w = Words(data, off)
    count = np.maximum(per_doc(n, w.doc), 1)
    weight = lexicon.of(w.keys)
    odd, forms = w.plain_forms()
    plain = np.zeros(len(w.keys))
    np.maximum.at(plain, odd, np.where(weight[odd] > 0, 0.0, lexicon.of(forms)))
    odd = np.unique(odd)
    hit = (weight > 0) | (plain > 0)
    both = np.maximum(weight, plain)
    second = np.isin(w.keys, SECOND_KEYS)
    near = np.zeros(len(hit), bool)
    for k in range(1, NEAR + 1):  # within NEAR words, in the same document
        if len(hit) > k:
            same = w.doc[k:] == w.doc[:-k]
            near[k:] |= second[:-k] & same
            near[:-k] |= second[k:] & same
    size = np.maximum(np.diff(off), 1).astype(float)
    byte_doc = np.repeat(np.arange(n), np.diff(off))
    upper = (data >= 0x41) & (data <= 0x5A)
    most = np.zeros(n)
    np.maximum.at(most, w.doc, both)
    ups = np.concatenate([[0], np.cumsum(upper)])
    length = w.ends - w.starts
    shouted = (ups[w.ends] - ups[w.starts] == length) & (length > 2)
    single = length == 1
    spaced = np.zeros(len(single), bool)
    if len(single) > 2:
        run = single[2:] & single[1:-1] & single[:-2] & (w.doc[2:] == w.doc[:-2])
        spaced[2:] = run
    tripled = np.zeros(len(data), bool)
    if len(data) > 2:
        tripled[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2]) & _LETTER[w.low[2:]]
    out = [
        per_doc(n, w.doc, hit) / count,
        per_doc(n, w.doc, both) / count,
        np.log1p(per_doc(n, w.doc, hit)),
        most,
        per_doc(n, w.doc, plain > 0) / count,
        per_doc(n, w.doc, hit & near) / count,
        per_doc(n, w.doc, second) / count,
        per_doc(n, byte_doc, upper) / size,
        per_doc(n, w.doc, shouted) / count,
        per_doc(n, byte_doc, data == 0x21) / size,
        per_doc(n, byte_doc, data == 0x3F) / size,
        per_doc(n, byte_doc, EDGE[data]) / size,
        np.bincount(w.doc[odd], minlength=n) / count,
        per_doc(n, w.doc, spaced) / count,
        per_doc(n, byte_doc, tripled) / size,
        np.log1p(per_doc(n, w.doc)),
    ]
    return np.stack(out, axis=1)


def count_words(batches: Iterator[pa.RecordBatch], labels: dict[int, tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Labelled documents that have a word, and toxic ones of them, by word hash and fold."""
    keys, folds, ones = [], [], []
    for part, data, off in A.chunks(batches):
        known = [labels.get(i, (-1, -1)) for i in part.column(0).to_pylist()]
        fold, mine = np.array([k[0] for k in known], np.int64), np.array([k[1] for k in known], np.int64)
        w = Words(data, off)
        use = (w.keys != 0) & (mine[w.doc] >= 0)
        pair = np.unique(np.stack([w.keys[use], w.doc[use].astype(A.U64)]), axis=1)
        doc = pair[1].astype(np.int64)
        keys.append(pair[0])
        folds.append(fold[doc])
        ones.append(mine[doc])
    if keys:
        key, fold, one = (np.concatenate(x) for x in (keys, folds, ones))
        each, where = np.unique(key, return_inverse=True)
        where = where.ravel() * FOLDS + fold
        total = np.bincount(where, minlength=len(each) * FOLDS)
        toxic = np.bincount(where, weights=one, minlength=len(each) * FOLDS).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(each[at // FOLDS].view(np.int64)), pa.array((at % FOLDS).astype(np.int32)), pa.array(total[at]), pa.array(toxic[at])], names=["word", "fold", "n", "toxic"])


def vectors(batches: Iterator[pa.RecordBatch], labels: dict[int, tuple[int, int]], lexicons: list[Lexicon]) -> Iterator[pa.RecordBatch]:
    """Features of labelled rows, each by the lexicon of the other folds."""
    for part, data, off in A.chunks(batches):
        ids = part.column(0).to_pylist()
        fold = np.array([labels[i][0] for i in ids], np.int64)
        x = np.zeros((len(ids), len(FEATURES)))
        for k in np.unique(fold):
            mine = np.flatnonzero(fold == k)
            size = np.diff(off)[mine]
            x[mine] = features(data[A.ranges(off[mine], size)], np.r_[0, np.cumsum(size)], lexicons[k])
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fold.astype(np.int32)), pa.array([labels[i][1] for i in ids], pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "fold", "label", "x"])


def lexicon_of(words: np.ndarray, n: np.ndarray, toxic: np.ndarray, rows: tuple[int, int]) -> Lexicon:
    """The words that are MIN_RATIO times as likely in toxic rows, at most LEXICON; ``rows`` counts all and the toxic ones."""
    bad = max(rows[1], 1)
    good = max(rows[0] - bad, 1)
    w = np.log((toxic + 0.5) / (bad + 1)) - np.log((n - toxic + 0.5) / (good + 1))
    use = np.flatnonzero((toxic >= MIN_DOCS) & (w >= np.log(MIN_RATIO)))
    use = use[np.lexsort((words[use], -w[use] * np.sqrt(toxic[use])))[:LEXICON]]
    return Lexicon(words[use].view(A.U64), w[use])


class Model:
    def __init__(self, lexicon: Lexicon, trees: Boosted | None, steps: Isotonic | None, share: float):
        self.lexicon, self.trees, self.steps, self.share = lexicon, trees, steps, share

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(off) - 1, self.share)
        return self.steps(self.trees.margin(features(data, off, self.lexicon)))


def fit(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Learn from ``labels`` (doc_id, toxic); ``docs`` has doc_id and text."""
    spark = docs.sparkSession
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > fit_docs:
        known = known.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * fit_docs / n))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(FOLDS)).cast("int")
    rows = known.select("doc_id", "toxic", fold.alias("fold")).collect()
    share = float(np.mean([r["toxic"] for r in rows])) if rows else 0.0
    nothing = Model(Lexicon(np.empty(0, A.U64), np.empty(0)), None, None, share)
    if share in (0.0, 1.0):
        return nothing
    held = spark.sparkContext.broadcast({r["doc_id"]: (r["fold"], r["toxic"]) for r in rows})

    def of(fn, schema: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wanted = np.array(sorted(held.value), np.int64)

            def mine() -> Iterator[pa.RecordBatch]:
                for b in batches:
                    yield b.filter(pa.array(np.isin(b.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), wanted)))

            yield from fn(mine(), held.value)

        return docs.mapInArrow(run, schema)

    counts = of(count_words, "word long, fold int, n long, toxic long").groupBy("word").agg(*[F.sum(F.when(F.col("fold") == k, F.col(c)).otherwise(0)).alias(f"{c}{k}") for c in ("n", "toxic") for k in range(FOLDS)])
    whole = {c: sum((F.col(f"{c}{k}") for k in range(1, FOLDS)), F.col(f"{c}0")) for c in ("n", "toxic")}
    # half the ratio over all folds: no word of a lexicon without one of them is left out for its odds
    bad = max(sum(r["toxic"] for r in rows), 1)
    good = max(len(rows) - bad, 1)
    odds = F.log((whole["toxic"] + 0.5) / (bad + 1) / ((whole["n"] - whole["toxic"] + 0.5) / (good + 1)))
    found = counts.where((whole["toxic"] >= MIN_DOCS) & (odds >= float(np.log(MIN_RATIO / 2)))).orderBy(F.desc(odds * F.sqrt(whole["toxic"])), "word").limit(2 * LEXICON).toPandas()
    size = np.bincount([r["fold"] for r in rows], minlength=FOLDS)
    toxic = np.bincount([r["fold"] for r in rows], weights=[r["toxic"] for r in rows], minlength=FOLDS)
    words = found["word"].to_numpy(np.int64)
    by = {c: found[[f"{c}{k}" for k in range(FOLDS)]].to_numpy(float).reshape(-1, FOLDS) for c in ("n", "toxic")}
    without = [lexicon_of(words, by["n"].sum(axis=1) - by["n"][:, k], by["toxic"].sum(axis=1) - by["toxic"][:, k], (size.sum() - size[k], toxic.sum() - toxic[k])) for k in range(FOLDS)]
    lexicon = lexicon_of(words, by["n"].sum(axis=1), by["toxic"].sum(axis=1), (size.sum(), toxic.sum()))

    got = of(lambda it, labels: vectors(it, labels, without), "doc_id long, fold int, label int, x array<double>").orderBy("doc_id", F.hash("x")).toPandas()
    if not len(got) or got["label"].nunique() < 2:
        return nothing
    x, y, fold_of = np.stack(got["x"]), got["label"].to_numpy(float), got["fold"].to_numpy()
    leaf = min(20.0, max(3.0, y.sum() / 8))
    margin, known_margin = np.zeros(len(y)), np.zeros(len(y), bool)
    for k in range(FOLDS):
        rest, mine = fold_of != k, fold_of == k
        if mine.any() and len(set(y[rest])) == 2:
            margin[mine], known_margin[mine] = Boosted(leaf=leaf).fit(x[rest], y[rest]).margin(x[mine]), True
    trees = Boosted(leaf=leaf).fit(x, y)
    if len(set(y[known_margin])) < 2:  # folds without both kinds: the trees' own margins
        margin, known_margin = trees.margin(x), np.ones(len(y), bool)
    return Model(lexicon, trees, Isotonic().fit(margin[known_margin], y[known_margin]), share)


def score(docs: DataFrame, labels: DataFrame, train: Column, *, id_col: str = "doc_id", text_col: str = "text", fit_docs: int = FIT_DOCS) -> DataFrame:
    """doc_id and score (0 to 1) of each row of ``docs``; ``train`` selects the labels that may be learned from."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    model = spark.sparkContext.broadcast(fit(texts, labels.where(train).select(F.col(id_col).cast("long").alias("doc_id"), "toxic"), fit_docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, off in A.chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.value.scores(data, off))], names=["doc_id", "score"])

    return texts.mapInArrow(run, "doc_id long, score double")
