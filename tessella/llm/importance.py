"""Quality by importance resampling.

Two bag-of-n-grams models over hashed words and word pairs, one of the target
texts and one of all texts, give each document an importance weight, the ratio
of its likelihoods. Documents are drawn in proportion to their weights without
replacement by Gumbel top-k: the k greatest of log weight plus Gumbel noise.

The log weight is that of the document's average n-gram times LENGTH, so that
long texts do not win or lose by their length alone. The k-th greatest key is
found by counting keys in ever finer bins.

Cases: a null or empty text has weight 1 (log weight 0); without target rows
all weights are 1; noise comes from the doc_id, so reruns agree and repeated rows
are drawn or left together; equal keys at the edge are all drawn; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import arrays as A
from tessella.llm.stage import bounded_batches, save

BUCKETS = 10_000
#: Target rows that the target model is fitted on, at most (those of least hash).
FIT_DOCS = 100_000
LENGTH = 30.0
SHARE = 0.85


def doc_grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, document of each) of the words and word pairs of documents."""
    low = A.LOWER[data]
    starts, ends, first = A.words(low, off, A.NOT_SPACE)
    h = A.hash_words(low, starts, ends)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    inside = doc[1:] == doc[:-1]
    grams = np.concatenate([h, A.hash_grams(h, 2)[inside]])
    return (A.mix(grams) % A.U64(BUCKETS)).astype(np.int64), np.concatenate([doc, doc[1:][inside]])


def count(batches: Iterator[pa.RecordBatch], targets: np.ndarray) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS), np.int64)
    for part, data, off in A.chunks(batches):
        buckets, doc = doc_grams(data, off)
        wanted = np.isin(pc.fill_null(part.column(0), np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), targets)
        total[0] += np.bincount(buckets, minlength=BUCKETS)
        total[1] += np.bincount(buckets[wanted[doc]], minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS, dtype=np.int32)), pa.array(total[0]), pa.array(total[1])], names=["bucket", "raw", "target"])


def score(batches: Iterator[pa.RecordBatch], ratio: np.ndarray, length: float) -> Iterator[pa.RecordBatch]:
    for part, data, off in A.chunks(batches):
        buckets, doc = doc_grams(data, off)
        n = np.bincount(doc, minlength=part.num_rows)
        sums = np.bincount(doc, weights=ratio[buckets], minlength=part.num_rows)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(length * sums / np.maximum(n, 1))], names=["doc_id", "log_weight"])


def kth_greatest(keys: DataFrame, k: int, levels: int = 5, bins: int = 1000) -> float:
    """Lower edge of a bin, of a width of rounding, that holds the k-th greatest of column ``key``."""
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    if lo is None:
        return 0.0
    left = k
    for _ in range(levels):
        width = (hi - lo) / bins
        if width <= 0 or lo + width == lo:
            break
        bin_no = F.least(F.floor((F.col("key") - lo) / width), F.lit(bins - 1))
        found = keys.where((F.col("key") >= lo) & (F.col("key") <= hi)).groupBy(bin_no.alias("b")).agg(F.count("*").alias("n")).orderBy(F.col("b").desc()).collect()
        for r in found:
            if left <= r["n"]:
                lo, hi = lo + r["b"] * width, lo + (r["b"] + 1) * width if r["b"] < bins - 1 else hi
                break
            left -= r["n"]
    return lo


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, fit_docs: int = FIT_DOCS, length: float = LENGTH, seed: int = 17) -> DataFrame:
    """doc_id, log_weight, key and selected of each row of ``docs``; ``target`` has the ids of target texts."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = target.select(F.col(id_col).cast("long").alias("doc_id")).dropna().distinct()
    n = ids.count()
    if n > fit_docs:
        ids = ids.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) < int((1 << 30) * fit_docs / n))
    wanted = spark.sparkContext.broadcast(np.array([r[0] for r in ids.collect()], np.int64))
    counts = texts.mapInArrow(lambda it: count(it, wanted.value), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    ratio = np.zeros(BUCKETS)
    if len(counts) and counts["target"].sum():
        raw, own = np.zeros(BUCKETS), np.zeros(BUCKETS)
        raw[counts["bucket"]], own[counts["bucket"]] = counts["raw"], counts["target"]
        ratio = np.log((own + 1) / (own.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    model = spark.sparkContext.broadcast(ratio)
    u = (F.pmod(F.xxhash64(F.lit(seed), F.lit("gumbel"), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    keys = texts.mapInArrow(lambda it: score(it, model.value, length), "doc_id long, log_weight double").withColumn("key", F.col("log_weight") - F.log(-F.log(u)))
    keys = save(keys, "importance")
    k = int(np.ceil(share * keys.count()))
    edge = kth_greatest(keys, k) if k else float("inf")
    return keys.withColumn("selected", F.col("key") >= edge)
