import re

import pytest

from tessella.llm import mixing as M


def fill(sizes, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    goal, left, full = {}, 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in full]
        level = left / sum(w[s] for s in free) if free else 0
        over = [s for s in free if w[s] * level > 2 * sizes[s]]
        if not over:
            return goal | {s: w[s] * level for s in free}
        for s in over:
            full.add(s)
            goal[s] = 2.0 * sizes[s]
            left -= goal[s]


def make(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, r int, at int")


@pytest.mark.parametrize("kind", ["even", "hot", "tiny"])
def test_targets_and_taken(spark, kind):
    rows = []
    for i in range(1500):
        s = {"even": f"s{i % 5}", "hot": "a" if i % 3 else f"é{i % 7}", "tiny": "b" if i < 1490 else f"t{i % 3}"}[kind]
        rows.append((i, "w " * (i * 37 % 211), s))
    rows += [(5000, None, "a"), (5001, "", None), (5002, "x\ty\nz", None), (5003, " ", "zero"), (10, "w " * 37, "s1"), (10, "w " * 37, "s1")]
    docs = make(spark, rows).repartition(7)
    got = M.taken(docs).collect()
    again = M.taken(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, size(t)) for i, t, _ in rows)
    sizes, took = {}, {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        took[r["source"]] = took.get(r["source"], 0) + r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    goal = fill(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - goal[r["source"]]) < 1e-6 * (1 + r["target"])
    assert all(abs(took[s] - goal[s]) <= 1 for s in sizes)


@pytest.mark.parametrize("words", [10_000, 14_925, 119_400, 1_000_000])
def test_every_tenth_of_the_slots_is_close_to_the_shares(spark, words):
    size = 25 if words < 10**5 else 100
    rows = [(i, "w " * size, f"s{i % 4}") for i in range(words // size)] + [(-1, "a few words", "tiny")]
    own, schedule = M.mix(make(spark, rows))
    slots = schedule.select("slot", "source").distinct().toPandas().sort_values("slot", ignore_index=True)
    share = own.select("source", "target").distinct().toPandas().set_index("source")["target"]
    share = share / share.sum()
    for k in range(10):
        part = slots[len(slots) * k // 10 : len(slots) * (k + 1) // 10]
        assert all(abs((part["source"] == s).mean() - p) < 0.01 for s, p in share.items()), k
    assert schedule.where("start >= stop or stop > size").count() == 0


def test_blocks_cover_each_stream_once(spark):
    rows = [(i, "w " * (i * 31 % 97), f"s{i % 3}") for i in range(300)] + [(300, "a b", "x")]
    own, schedule = M.mix(make(spark, rows))
    taken = {}
    for r in schedule.collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["stop"] - r["start"]
    for r in own.collect():
        end = round(r["target"])
        want = sum(max(0, min(end, r["at"] + e * r["source_size"] + r["size"]) - (r["at"] + e * r["source_size"])) for e in (0, 1))
        assert taken.get(r["doc_id"], 0) == want


def test_many_sources_on_several_partitions(spark, monkeypatch):
    monkeypatch.setattr(M, "SOURCES", 50)
    rows = [(i, "w " * (1 + i * 7 % 40 if i % 400 else 5000), f"host{i % 400}") for i in range(2000)]
    got = M.taken(make(spark, rows)).collect()
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    goal = fill(sizes)
    assert all(abs(r["target"] - goal[r["source"]]) < 1e-6 * (1 + r["target"]) for r in got)


def test_empty_table(spark):
    assert M.taken(make(spark, [(1, "a", "b")]).limit(0)).count() == 0
    assert [r["taken"] for r in M.taken(make(spark, [(1, None, "b")])).collect()] == [0]
