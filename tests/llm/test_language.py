import itertools
import random
import tracemalloc

import numpy as np
import pyspark.sql.functions as F

from tessella.llm import language as L


def best_path(scores, penalty):
    n, k = scores.shape
    value = lambda p: sum(scores[t, s] for t, s in enumerate(p)) - penalty * sum(a != b for a, b in zip(p, p[1:]))
    return max(value(p) for p in itertools.product(range(k), repeat=n)), value


def test_viterbi_equals_all_paths():
    rng = np.random.default_rng(3)
    scores = [rng.normal(size=(n, 3)) * 2 for n in (1, 5, 7, 3)]
    for s, path in zip(scores, L.viterbi(scores, 1.7)):
        best, value = best_path(s, 1.7)
        assert abs(value(path) - best) < 1e-9


def test_held_out_accuracy_spans_and_odd_rows(spark):
    rng = random.Random(1)
    vocab = {"xx": ["hare", "lomit", "fendor", "wist"], "yy": ["gluv", "prünk", "zähd", "kurq"], "ru": ["мир", "дом", "лес"]}
    text = lambda v, n: " ".join(rng.choice(vocab[v]) for _ in range(n))
    rows = [(i, text(v, 12), v) for i, v in enumerate(rng.choices(list(vocab), k=120))]
    odd = [(1000, None, "xx"), (1001, "", "xx"), (1002, "12 -- …", "xx"), (1003, text("xx", 40) + " " + text("yy", 60), None), (1004, "мир " * 3000, None), (1004, "hare", None)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows + odd], "doc_id long, text string, lang string, score double")
    got = L.identify(docs, L.crc_mod(4) != 2).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) + len(odd)
    assert all(by[i]["lang_pred"] == v for i, _, v in rows)
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3
    assert [s["lang"] for s in by[1003]["spans"]] == ["xx", "yy"] and by[1003]["spans"][1]["start"] == 40
    assert by[1003]["lang_pred"] == "yy" and all(0 <= r["score"] <= 1 for r in got)
    kept = L.keep(docs, L.crc_mod(4) != 2)
    assert kept.columns == docs.columns and {1000, 1001, 1002} == set(range(1000, 1005)) - {r[0] for r in kept.collect()}
    none = L.identify(docs, F.lit(False)).where("lang_pred <> 'und'")
    assert none.count() == 0 and L.identify(docs.limit(0), F.lit(True)).count() == 0


def test_clean_texts_of_many_languages_stay(spark):
    rng = random.Random(3)
    vocab = {f"l{k}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[5 * k : 5 * k + 6]) for _ in range(6)) for _ in range(5)] for k in range(5)}
    text = lambda v, n: " ".join(rng.choice(vocab[v]) for _ in range(n))
    rows = [(i, text(v, 12), v) for i, v in enumerate(rng.choices(list(vocab), k=120))]
    docs = spark.createDataFrame(rows + [(1000, " ".join(text(v, 40) for v in vocab), None), (1001, "12 34", None)], "doc_id long, text string, lang string")
    assert L.identify(docs, L.crc_mod(4) != 2).where("doc_id = 1000").first()["score"] < 0.3
    assert {r["doc_id"] for r in L.keep(docs, L.crc_mod(4) != 2).collect()} == {r[0] for r in rows} | {1000}


def test_scores_equal_sums_word_by_word(spark):
    rng = random.Random(9)
    vocab = {"xx": ["hare", "lomit", "fendor"], "yy": ["gluv", "prunk", "zahd", "hare"]}
    rows = [(i, " ".join(rng.choice(vocab[v]) for _ in range(rng.randrange(1, 9))), v) for i, v in enumerate(rng.choices(list(vocab), k=60))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = L.fit(docs, F.lit(True))
    got = {r["doc_id"]: r for r in L.identify(docs, F.lit(True)).collect()}
    for i, text, _ in rows:
        total = np.zeros(2)
        for word in text.split():
            data = np.frombuffer(word.encode(), np.uint8)
            buckets, _ = L.gram_buckets(data, np.array([0]), np.array([len(data)]))
            assert len(buckets) == sum(len(word) + 2 - n + 1 for n in L.ORDERS)
            score = sum(model.table[b].astype(float) for b in buckets) / np.sqrt(len(L.ORDERS))
            total += np.maximum(score - score.max(), -L.WORD_CAP)
        if len(got[i]["spans"]) == 1:
            odds = np.exp((total - total.max()) / np.sqrt(len(text.split())))
            # a text whose path was searched scores by its letters: all of them, in one span
            assert got[i]["lang_pred"] == model.langs[int(total.argmax())] and min(abs(got[i]["score"] - s) for s in ((odds / odds.sum()).max(), 1.0)) < 1e-6


def test_one_long_text_beside_many_short_ones_stays_small():
    rng = np.random.default_rng(1)
    scores = [rng.normal(size=(100_000, 4))] + [rng.normal(size=(int(n), 4)) for n in rng.integers(3, 20, 5000)]
    tracemalloc.start()
    paths = L.viterbi(scores, 5.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50e6 and [len(p) for p in paths] == [len(s) for s in scores]
