"""Language identification of mixed-language text.

A word's script (from code-point ranges) narrows the languages that it can be
in; hashed byte n-grams of the word give a log-likelihood for each of those;
Viterbi with a switching penalty labels spans of words. A document's language
is that of most letters in its spans.

Documents are scored many at a time. A document whose best single language
provably beats every path with a switch (no stretch of words gains half the
penalty in another language) needs no path search; the rest go through Viterbi
in step.

Cases: a null text and one without letters are ``und`` with score 0; with no
labelled rows every text is ``und``; equal scores go to the first language by
name; repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm import arrays as A
from tessella.llm.stage import bounded_batches, text_key, without

BITS = 15
ORDERS = (1, 2, 3, 4)
#: Labelled documents that the model is fitted on, at most (those of least hash).
FIT_DOCS = 40_000
#: Nats that a change of language costs.
SWITCH = 20.0
#: Nats that one word can speak for a language against the best other one, at most.
WORD_CAP = 6.0
#: Script ranges, by their first code points; fixed values of the Unicode block table.
SCRIPTS = (0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0xE00, 0x10A0, 0x1100, 0x1E00, 0x2E80, 0x3040, 0x3100, 0x3400, 0xAC00, 0xD7B0, 0x20000)
#: A language has a script if that share of its words is written in it.
SCRIPT_SHARE = 0.001
SPAN_TYPE = "array<struct<start:int,stop:int,lang:string>>"

LETTER = np.zeros(256, bool)
LETTER[0x61:0x7B] = LETTER[0x80:] = True


def lowered(batch: pa.RecordBatch, text: str) -> pa.RecordBatch:
    i = batch.schema.get_field_index(text)
    return batch.set_column(i, text, pc.utf8_lower(batch.column(i)))


def scripts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Index into SCRIPTS of each word's first character."""
    n = len(data)
    b = [data[np.minimum(starts + j, n - 1)].astype(np.int64) for j in range(4)]
    tail = [x & 0x3F for x in b]
    code = np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, (b[0] & 0x1F) << 6 | tail[1], np.where(b[0] < 0xF0, (b[0] & 0x0F) << 12 | tail[1] << 6 | tail[2], (b[0] & 0x07) << 18 | tail[1] << 12 | tail[2] << 6 | tail[3])))
    return np.searchsorted(np.array(SCRIPTS), code, "right") - 1


def vocabulary(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of a word of each different spelling, spelling of each word)."""
    _, index, inverse = np.unique(A.hash_words(data, starts, ends), return_index=True, return_inverse=True)
    return index, inverse.ravel()


def gram_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, word of each) of the byte n-grams of words between two spaces."""
    length = ends - starts + 2
    first = np.cumsum(length) - length
    flat = np.full(int(length.sum()) + max(ORDERS), 0x20, np.uint8)
    flat[A.ranges(first + 1, length - 2)] = data[A.ranges(starts, length - 2)]
    keys = A.BYTE_KEYS[flat]
    buckets, owners = [], []
    word = np.repeat(np.arange(len(starts)), length)
    left = np.repeat(first + length, length) - np.arange(len(word))
    h = np.zeros(len(word), A.U64)
    for n in ORDERS:
        h = h + keys[n - 1 : n - 1 + len(word)] * A.GRAM_KEYS[n - 1]
        inside = left >= n
        buckets.append((A.mix(h + A.U64(n)) >> A.U64(64 - BITS)).astype(np.int64)[inside])
        owners.append(word[inside])
    return np.concatenate(buckets), np.concatenate(owners)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, bucket, n): n-gram counts; buckets from 2**BITS on count words by script."""
    total: dict[str, np.ndarray] = {}
    for part, data, off in A.chunks(lowered(b, "text") for b in batches):
        starts, ends, first = A.words(data, off, LETTER)
        if not len(starts):
            continue
        langs = part.column(part.schema.get_field_index("lang")).to_pylist()
        names = sorted(set(langs))
        code = {x: i for i, x in enumerate(names)}
        doc_lang = np.array([code[x] for x in langs])
        word_lang = np.repeat(doc_lang, np.diff(first))
        index, spelling = vocabulary(data, starts, ends)
        buckets, owner = gram_buckets(data, starts[index], ends[index])
        script = scripts(data, starts)
        for x, i in code.items():
            mine = word_lang == i
            seen = np.bincount(spelling[mine], minlength=len(index)).astype(float)
            counts = total.setdefault(x, np.zeros(2**BITS + len(SCRIPTS)))
            counts[: 2**BITS] += np.bincount(buckets, weights=seen[owner], minlength=2**BITS)
            counts[2**BITS :] += np.bincount(script[mine], minlength=len(SCRIPTS))
    for x, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(counts[at].astype(np.int64))], names=["lang", "bucket", "n"])


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        grams = counts[:, : 2**BITS] + 0.5
        self.table = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32).copy()
        words = counts[:, 2**BITS :]
        self.allowed = (words >= SCRIPT_SHARE * words.sum(axis=1, keepdims=True)).T & (words.T > 0)
        self.allowed[~self.allowed.any(axis=1)] = True

    def word_scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-likelihoods of words by language, the best at 0 and none below -WORD_CAP."""
        buckets, owner = gram_buckets(data, starts, ends)
        order = np.argsort(owner, kind="stable")
        score = np.add.reduceat(self.table[buckets[order]].astype(np.float64), np.searchsorted(owner[order], np.arange(len(starts))), axis=0)
        score /= np.sqrt(len(ORDERS))  # the orders overlap: they are no independent witnesses
        score[~self.allowed[scripts(data, starts)]] = -np.inf
        return np.maximum(score - score.max(axis=1, keepdims=True), -WORD_CAP)


def fit(docs: DataFrame, where: Column, fit_docs: int = FIT_DOCS) -> Model | None:
    """Learn from the rows of ``docs`` (doc_id, text, lang) that ``where`` selects."""
    rows = docs.where(where & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = docs.where(where & F.col("lang").isNotNull()).count()
    if n > fit_docs:
        rows = rows.where(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * fit_docs / n))
    found = rows.select("text", "lang").mapInArrow(count_grams, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    if not len(found):
        return None
    langs = sorted(found["lang"].unique())
    counts = np.zeros((len(langs), 2**BITS + len(SCRIPTS)))
    counts[np.searchsorted(langs, found["lang"]), found["bucket"]] = found["n"]
    return Model(langs, counts)


def segmented_min(values: np.ndarray, segment: np.ndarray) -> np.ndarray:
    """Running minimum of each column within segments (non-decreasing ids)."""
    shift = (values.max() - values.min() + 1.0) * segment[:, None]
    return np.minimum.accumulate(values - shift, axis=0) + shift


def viterbi(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """Best language of each word. Documents of like lengths advance together, so padding at most doubles them."""
    out: list[np.ndarray] = [None] * len(scores)  # type: ignore[list-item]
    alike: dict[int, list[int]] = {}
    for i, s in enumerate(scores):
        alike.setdefault(len(s).bit_length(), []).append(i)
    for mine in alike.values():
        for i, path in zip(mine, viterbi_in_step([scores[i] for i in mine], penalty), strict=True):
            out[i] = path
    return out


def viterbi_in_step(scores: list[np.ndarray], penalty: float) -> list[np.ndarray]:
    """viterbi() of documents that advance together, the longest first in the arrays."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    steps, langs = int(sizes[0]), scores[0].shape[1]
    grid = np.zeros((steps, len(order), langs))
    for k, i in enumerate(order):
        grid[: sizes[k], k] = scores[i]
    alive = np.searchsorted(-sizes, -np.arange(1, steps + 1), "right")
    came = np.zeros((steps, len(order), langs), np.int16)
    best = grid[0].copy()
    stay = np.arange(langs)
    for t in range(1, steps):
        m = alive[t]
        now = best[:m]
        top = now.argmax(axis=1)
        switch = now[np.arange(m), top] - penalty
        keep = now >= switch[:, None]
        came[t, :m] = np.where(keep, stay, top[:, None])
        best[:m] = np.where(keep, now, switch[:, None]) + grid[t, :m]
    out: list[np.ndarray] = [None] * len(order)  # type: ignore[list-item]
    state = best.argmax(axis=1)
    paths = np.zeros((steps, len(order)), np.int16)
    for t in range(steps - 1, -1, -1):
        m = alive[t]
        paths[t, :m] = state[:m]
        if t:
            state[:m] = came[t, np.arange(m), state[:m]]
    for k, i in enumerate(order):
        out[i] = paths[: sizes[k], k]
    return out


def label(batches: Iterator[pa.RecordBatch], model: Model | None, penalty: float) -> Iterator[pa.RecordBatch]:
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string())]))
    for part, data, off in A.chunks(lowered(b, "text") for b in batches):
        n = part.num_rows
        langs, score, spans = ["und"] * n, np.zeros(n), [[]] * n
        starts, ends, first = A.words(data, off, LETTER)
        plain = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data >= 0x61) & (data <= 0x7A), out=plain[1:])
        lettered = plain[off[1:]] > plain[off[:-1]]
        for i in np.flatnonzero(~lettered & (np.diff(first) > 0)):
            lettered[i] = any(c.isalpha() for c in data[off[i] : off[i + 1]].tobytes().decode())
        if model is not None and len(starts):
            index, spelling = vocabulary(data, starts, ends)
            words = model.word_scores(data, starts[index], ends[index])[spelling]
            sums = np.zeros((len(words) + 1, words.shape[1]))
            np.cumsum(words, axis=0, out=sums[1:])
            whole = sums[first[1:]] - sums[first[:-1]]
            lead = whole.argmax(axis=1)
            size = np.diff(first)
            doc = np.repeat(np.arange(n), size)
            gain = words - words[np.arange(len(words)), lead[doc]][:, None]
            run = np.cumsum(gain, axis=0)
            low = np.minimum(segmented_min(run - gain, doc), run)
            full = np.flatnonzero(size)
            most = np.zeros(n)
            most[full] = np.maximum.reduceat((run - low).max(axis=1), first[:-1][full])
            mixed = np.flatnonzero(lettered & (most > penalty / 2))
            paths = dict(zip(mixed.tolist(), viterbi([words[first[i] : first[i + 1]] for i in mixed], penalty), strict=True)) if len(mixed) else {}
            scaled = whole / np.sqrt(np.maximum(size, 1))[:, None]
            odds = np.exp(scaled - scaled.max(axis=1, keepdims=True))
            odds /= odds.sum(axis=1, keepdims=True)
            for i in np.flatnonzero(lettered):
                if i in paths:
                    path = paths[i]
                    cut = np.flatnonzero(np.diff(path)) + 1
                    edges = [0, *cut.tolist(), len(path)]
                    spans[i] = [{"start": a, "stop": b, "lang": model.langs[path[a]]} for a, b in zip(edges, edges[1:], strict=False)]
                    letters = np.bincount(path, weights=(ends - starts)[first[i] : first[i + 1]], minlength=len(model.langs))
                    k = int(letters.argmax())
                    score[i] = letters[k] / letters.sum()
                else:
                    k = int(lead[i])
                    spans[i] = [{"start": 0, "stop": int(size[i]), "lang": model.langs[k]}]
                    score[i] = odds[i, k]
                langs[i] = model.langs[k]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs), pa.array(score), pa.array(spans, span_type), part.column(2)], names=["doc_id", "lang_pred", "score", "spans", "key"])


def identify(docs: DataFrame, train: Column, *, fit_docs: int = FIT_DOCS, penalty: float = SWITCH) -> DataFrame:
    """doc_id, lang_pred, score and spans (of letter words, by number) of each row of (doc_id, text, lang).

    Its key tells rows of one doc_id apart.
    ``train`` selects the rows that the model may learn from.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    model = spark.sparkContext.broadcast(fit(docs, train, fit_docs))
    return docs.select("doc_id", "text", text_key("text").alias("key")).mapInArrow(lambda it: label(it, model.value, penalty), f"doc_id long, lang_pred string, score double, spans {SPAN_TYPE}, key long")


def crc_mod(mod: int, id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string")) % mod


def keep(docs: DataFrame, train: Column, **how) -> DataFrame:
    """Documents in a known language: those that are ``und`` go.

    Scores have no part in it: they shrink with the number of languages.
    """
    return without(docs, identify(docs, train, **how).where("lang_pred = 'und'"), "doc_id", "text")
