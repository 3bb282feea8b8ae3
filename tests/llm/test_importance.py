import math
import random

import numpy as np
import pyspark.sql.functions as F

from tessella.llm import importance as I


def make(spark):
    rng = random.Random(3)
    text = lambda bad, n: " ".join(("q" if bad and rng.random() < 0.5 else "") + rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(n))
    rows = [(i, text(i % 4 == 0, rng.randrange(20, 300)), 0.0) for i in range(400)]
    rows += [(1000, None, 0.0), (1001, "", 0.0), (1002, "x " * 9000, 0.0), (8, rows[8][1], 0.0), (None, "a b", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, key double"), rows


def test_weights_follow_the_target_and_k_are_drawn(spark):
    docs, rows = make(spark)
    target = docs.where("doc_id % 4 <> 0 and doc_id % 3 = 0").select("doc_id")
    got = I.resample(docs, target, share=0.5).collect()
    assert len(got) == len(rows) and abs(sum(r["selected"] for r in got) - 203) <= 1
    low = [r["log_weight"] for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 4 == 0]
    high = [r["log_weight"] for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] % 4]
    assert max(low) < min(high)
    assert {r["log_weight"] for r in got if r["doc_id"] in (1000, 1001)} == {0.0}
    again = I.resample(docs.repartition(5), target, share=0.5).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    edge = min(r["key"] for r in got if r["selected"])
    assert all(r["key"] < edge for r in got if not r["selected"])


def test_no_target_and_no_rows(spark):
    docs, rows = make(spark)
    got = I.resample(docs, docs.select("doc_id").limit(0)).collect()
    assert {r["log_weight"] for r in got} == {0.0} and sum(r["selected"] for r in got) >= 0.85 * len(rows)
    assert I.resample(docs.limit(0), docs.select("doc_id")).count() == 0


def test_weights_and_draws_equal_brute_force(spark):
    docs, rows = make(spark)
    targets = {i for i, *_ in rows if i is not None and i % 5 == 1}
    got = I.resample(docs, spark.createDataFrame([(i,) for i in sorted(targets)], "doc_id long"), share=0.3).collect()
    raw, own, grams = np.zeros(I.BUCKETS), np.zeros(I.BUCKETS), []
    for i, t, _ in rows:
        data = np.frombuffer((t or "").encode(), np.uint8)
        b = I.doc_grams(data, np.array([0, len(data)]))[0]
        assert len(b) == max(0, 2 * len((t or "").split()) - 1)
        grams.append((i, b))
        np.add.at(raw, b, 1)
        if i in targets:
            np.add.at(own, b, 1)
    ratio = [math.log((o + 1) / (own.sum() + I.BUCKETS)) - math.log((r + 1) / (raw.sum() + I.BUCKETS)) for o, r in zip(own, raw)]
    u = {r["i"]: r["u"] for r in docs.select(F.col("doc_id").alias("i"), ((F.pmod(F.xxhash64(F.lit(17), F.lit("gumbel"), "doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)).alias("u")).collect()}
    want = []
    for i, b in grams:
        w = I.LENGTH * sum(ratio[x] for x in b) / max(len(b), 1)
        want.append((str(i), round(w, 6), round(w - math.log(-math.log(u[i])), 6)))
    assert sorted((str(r["doc_id"]), round(r["log_weight"], 6), round(r["key"], 6)) for r in got) == sorted(want)
    k = math.ceil(0.3 * len(rows))
    edge = sorted((w[2] for w in want), reverse=True)[k - 1]
    assert {(str(r["doc_id"]), round(r["key"], 6)) for r in got if r["selected"]} == {(w[0], w[2]) for w in want if w[2] >= edge}
