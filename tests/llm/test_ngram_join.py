import random
import re

import pytest

from tessella.llm import ngram_join as J


def brute(rows, n=5):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = min(n, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r[0]), r[0])
    return sorted((r[0], len(s), least[root(i)]) for i, (r, s) in enumerate(zip(rows, sets)))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 4)))
    rows, k = [], 0
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 8, 30, 90]))]
        for _ in range(rng.choice([1, 2, 20])):
            text = list(base)
            for _ in range(rng.randrange(0, 3)):
                text[rng.randrange(len(text))] = word()
            if rng.random() < 0.3:
                text += [word() for _ in range(rng.randrange(1, 12))]
            rows.append((k, rng.choice([" ", "\n", " \t"]).join(text).upper() if rng.random() < 0.2 else " ".join(text)))
            k += 1
    passage = " ".join(word() for _ in range(25))
    rows += [(k + i, " ".join(word() for _ in range(30)) + " " + passage) for i in range(20)]
    k += 20
    rows += [(k, None), (k + 1, ""), (k + 2, " \n"), (k + 3, "One"), (k + 4, "one"), (k + 5, "a b c d"), (k + 6, "A b  c\td"), (k + 7, "x y " * 4000), (k + 8, "x y " * 4001)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,batch,fragment", [(1, 150, 500), (2, 1_000_000, 2_000_000)])
def test_groups_equal_brute_force(spark, monkeypatch, seed, batch, fragment):
    monkeypatch.setattr(J, "BATCH", batch)
    monkeypatch.setattr(J, "FRAGMENT", fragment)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(tuple(r)[:3] for r in J.ngram_groups(docs).collect()) == brute(rows)


def test_keep_first_repeated_rows_and_empty_table(spark):
    rows = [(7, "a b c d e f", "p"), (3, "A b c d e f", "q"), (3, "A b c d e f", "q"), (9, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string")
    kept = J.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 3, 9]
    assert J.ngram_groups(docs.limit(0)).count() == 0


def jaccard_links(rows):
    sets = {}
    for i, text in rows:
        w = text.split()
        grams = frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        sets[grams] = min(i, sets.get(grams, i))
    each = sorted(sets.items(), key=lambda x: x[1])
    return sorted((x, y) for k, (p, x) in enumerate(each) for q, y in each[k + 1 :] if 100 * len(p & q) >= 75 * len(p | q))


def template_pairs(n, seed=3):
    """Pairs of near copies that all share a template of 80 % of their words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    template, rows = [word() for _ in range(160)], []
    for i in range(n // 2):
        own = [word() for _ in range(40)]
        rows += [(2 * i, " ".join(template + own)), (2 * i + 1, " ".join(template + own[:-2] + [word(), word()]))]
    return rows


def test_a_common_template_makes_linearly_many_pairs(spark):
    counted = []
    for n in (120, 240, 480):
        rows = template_pairs(n)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        _, _, sets = J.class_sets(J.texts_of(docs, "doc_id", "text"), 5, 75, 100)
        near = J.components(J.star_pairs(sets, 75, 100), "a", "b").where("node < 0")
        counted.append(J.star_pairs(sets, 75, 100).count() + J.torn_pairs(sets, near, 75, 100).count())
        if n == 120:
            assert sorted(map(tuple, J.class_links(docs).collect())) == jaccard_links(rows)
            assert sorted(tuple(r)[:3] for r in J.ngram_groups(docs).collect()) == brute(rows)
    assert counted[0] >= 60 and counted[1] <= 2.2 * counted[0] and counted[2] <= 2.2 * counted[1]


def test_class_links_and_a_hot_class(spark):
    rows = [(i, t) for i, t in corpus(4) if t and len(t.split()) > 4 and t == t.lower()]
    rows += [(1000 + i, rows[0][1]) for i in range(300)] + [(i, rows[1][1]) for i in (2000, 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.class_links(docs).collect())) == jaccard_links(rows)
    assert sorted(tuple(r)[:3] for r in J.ngram_groups(docs).collect()) == brute(rows)
