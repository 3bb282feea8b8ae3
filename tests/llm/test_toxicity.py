import random

import numpy as np

from tessella.llm import language, toxicity
from tessella.llm.boosting import Boosted, Isotonic


def test_isotonic_equals_best_monotone_blocks():
    rng = np.random.default_rng(2)
    m = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-2 * m))).astype(float)
    at = np.linspace(-4, 4, 200)
    v = Isotonic().fit(m, y)(at)
    assert (np.diff(v) >= 0).all() and v.min() >= 0 and v.max() <= 1 and abs(v[100] - 0.5) < 0.25


def test_trees_find_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.3)).astype(float)
    p = Boosted().fit(x[:2000], y[:2000]).margin(x[2000:]) > 0
    assert (p == y[2000:]).mean() > 0.95


def corpus():
    rng = random.Random(6)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7))) for _ in range(300)]
    bad = ["stoopid", "trashy", "moronic", "clownish"]
    spell = lambda w: rng.choice([w, w, w, w.upper(), w.replace("o", "0"), w[0] + "*" + w[1:], w + "!!!"])
    rows, labels = [], []
    for i in range(1500):
        w = [rng.choice(vocab) for _ in range(rng.randrange(10, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                w.insert(rng.randrange(len(w)), rng.choice(["you ", ""]) + spell(rng.choice(bad)))
        rows.append((i, " ".join(w), 0.5))
        if i % 10 != 7:
            labels.append((i, int(toxic)))
    return rows + [(5000, None, 0.5), (5001, "", 0.5), (5002, "you " * 4000 + "moronic", 0.5), (5003, "!!! *** $$", 0.5), (0, rows[0][1], 0.5)], labels + [(0, 0), (9999, 1), (3, None)]


def test_held_out_scores(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(docs, known, language.crc_mod(5) != 0).withColumn("held", language.crc_mod(5) == 0).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [(r["score"] >= 0.5, r["doc_id"] % 5 == 0) for r in got if r["held"] and r["doc_id"] < 1500]
    assert sum(a == b for a, b in held) / len(held) > 0.96
    none = toxicity.score(docs, known.where("toxic = 0"), language.crc_mod(5) != 0).collect()
    assert {r["score"] for r in none} == {0.0}
    assert toxicity.score(docs.limit(0), known, language.crc_mod(5) != 0).count() == 0


def test_spellings_around_the_lexicon_are_hits():
    lexicon = toxicity.Lexicon(toxicity.word_keys([b"idiot", b"shit", b"x" + b"ab" * 25]), np.array([2.0, 2.0, 2.0]))

    def hits(text):
        data = np.frombuffer(text.encode(), np.uint8)
        return round(float(np.expm1(toxicity.features(data, np.array([0, len(data)]), lexicon)[0, 2])))

    for word in ("idiot", "idiot!!!!", '"((idiot))"?!?!', "1d10t!!!!", "$h!t", "sh!t", "i d i o t", "an i d 1 0 t !!!! is", "x*" + "ab" * 25, "é i"):
        assert hits(f"ok {word} fine") == (word != "é i"), word
    assert hits("") == 0 and hits("!!!! **") == 0 and hits("i d i ot") == 0


def test_margins_equal_a_walk_through_each_tree():
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(400, 5)), (rng.random(400) < 0.3).astype(float)
    model = Boosted(trees=7, leaf=5).fit(x, y)
    for row, margin in zip(x[:60], model.margin(x[:60])):
        total = model.base
        for features, limits, value in model.splits:
            node = 0
            for _ in range(model.depth):
                bin_no = sum(row[features[node]] >= e for e in model.edges[features[node]])
                node = 2 * node + (2 if bin_no > limits[node] else 1)
            total += value[node - (2**model.depth - 1)]
        assert abs(total - margin) < 1e-9


def test_lexicons_of_folds_leave_out_their_own_rows():
    n, toxic = np.array([10.0, 9.0, 6.0]), np.array([9.0, 3.0, 6.0])
    found = toxicity.lexicon_of(np.array([11, 22, 33]), n, toxic, (100, 20))
    assert sorted(found.keys.tolist()) == [11, 33] and toxicity.lexicon_of(np.array([11]), n[:1], np.array([1.0]), (100, 20)).keys.tolist() == []
