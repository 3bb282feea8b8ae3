import hashlib
import random
import re

import pytest

from tessella.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            iw = words(item)
            n = min(10, len(iw))
            grams = {tuple(iw[i : i + n]) for i in range(len(iw) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
                    found.add(str(item_id))
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(found), sha, bool(hit)))
    return sorted(out)


def tables():
    rng = random.Random(5)
    vocab = ["Alpha", "beta", "gamma2", "ñandú", "x", "12", "DELTA"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 3, 5, 9, 10, 11, 30])))) for i in range(20)]
    items += [(20, None), (21, "..."), (22, items[3][1]), (100, "it's-a TEST of words, ten in all here now done")]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(60)))) for i in range(80)]
    docs += [(100, None), (101, ""), (102, "-- !"), (103, "zz " * 3000 + items[19][1].upper() + " zz"), (104, "it's a test OF words ten in all HERE now done it")]
    docs += [(105 + k, "q " * k + (items[k % 20][1] or "") + " r") for k in range(12)]
    return docs, items


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 100])
def test_report_equals_brute_force(spark, block_words):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.digest(D.contamination(d, b, block_words=block_words)).collect()
    assert sorted(map(tuple, got)) == brute(docs, items)


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 1, 7, 40])
def test_rows_of_one_item_are_one_item_at_every_size(spark, block_words):
    """Repeated item ids with equal and other windows, and a passage that many items share."""
    _, items = tables()
    passage = items[23][1]
    items = [(i % 9, t) for i, t in items] + [(200 + k, f"{passage} and so on {k} more") for k in range(40)] + [(3, passage), (3, passage)]
    docs = [(i, f"x{i} {passage} y{i} " + (items[i % 20][1] or "") + " and so on 7 more") for i in range(30)] + [(50, "none"), (51, passage)]
    got = D.digest(D.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words)).collect()
    assert sorted(map(tuple, got)) == brute(docs, items)


def test_clean_keeps_columns_and_empty_tables_work(spark):
    docs, items = tables()
    d = spark.createDataFrame([(i, t, "a", 1.0) for i, t in docs], "doc_id long, text string, item_id string, starts double")
    b = spark.createDataFrame(items, "item_id long, text string")
    kept = D.clean(d, b)
    assert kept.columns == d.columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in brute(docs, items) if not r[5]}
    assert D.clean(d, b.limit(0)).count() == len(docs)
    assert D.digest(D.contamination(d.limit(0), b)).count() == 0


@pytest.mark.parametrize("block_words", [D.BLOCK_WORDS, 20])
def test_rows_of_one_doc_id_come_out_one_by_one(spark, block_words):
    _, items = tables()
    long = next(t for _, t in items if t and len(words(t)) == 30)
    docs = [(1, "clean text of its own"), (1, "x " + long), (2, "other"), (1, "x " + long), (None, long), (3, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string").where("length(text) > 60")
    got = D.digest(D.contamination(d, b, block_words=block_words)).collect()
    assert sorted(map(str, got)) == sorted(map(str, D.digest(D.contamination(d, b)).collect())) and len(got) == len(docs)
    assert sorted((str(r["doc_id"]), r["n_hit"] > 0) for r in got) == [("1", False), ("1", True), ("1", True), ("2", False), ("3", False), ("None", True)]
    assert sorted(str(r["doc_id"]) for r in D.clean(d, b, block_words=block_words).collect()) == ["1", "2", "3"]


def test_words_whose_polynomial_hashes_agree_are_told_apart(spark):
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    d = spark.createDataFrame([(1, f"{two} " * 12)], "doc_id long, text string")
    b = spark.createDataFrame([(1, f"{one} " * 12)], "item_id long, text string")
    assert D.digest(D.contamination(d, b)).first()["n_hit"] == 0
