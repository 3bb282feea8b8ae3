import hashlib
import random

import numpy as np
import pyarrow as pa

from tessella.llm import sharing
from tessella.llm import suffix_dedup as S


def brute(rows):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for p in range(len(b) - 99):
            g = b[p : p + 100]
            first[g] = min(first.get(g, (i, p)), (i, p))
    out = []
    for i, b in data:
        gone = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - 99):
            if first[b[p : p + 100]] < (i, p):
                gone[p + 1 : p + 101] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(c for c, g in zip(b, gone[1:]) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdeé\n ") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(rng.randrange(10, 90)) for _ in range(12)]
    rows = []
    for i in range(150):
        parts = [text(rng.randrange(0, 40))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += [p[a : a + rng.randrange(60, 400)], text(rng.randrange(0, 20))]
        rows.append((rng.randrange(10**6) * 200 + i, rng.choice(["", " "]).join(parts)))
    rows += [(1, None), (2, ""), (3, "a" * 700), (4, "a" * 300 + "b"), (5, "xyz" * 200), (6, "\0" * 250), (7, "\0" * 130 + "q"), (8, rows[0][1]), (8, rows[0][1]), (9, passages[3][:99]), (10, "é" * 300), (11, " ".join(passages) * 2)]
    rng.shuffle(rows)
    return rows


def test_report_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, key string").repartition(6)
    got = sorted(map(tuple, S.report(docs).collect()))
    assert got == brute(rows)
    assert S.report(docs.limit(0)).count() == 0
    kept = {r["doc_id"]: r["text"] for r in S.dedupe(docs).collect()}
    assert kept[3] == "a" and kept[9] in {r[1] for r in rows if r[0] == 9} | {""}


def test_long_texts_are_cut_into_pieces():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 5000, dtype=np.uint8)
    whole = S.anchors(data, np.array([0, 5000]))
    old, S.PIECE = S.PIECE, 700
    try:
        windows = {}
        for part, off, base in S.pieces(data, np.array([0, 5000])):
            _, at, lo, hi, h = S.anchors(part, off)
            windows |= {int(base + p - o): (int(base + p), int(x)) for p, a, b, x in zip(at, lo, hi, h) for o in range(a, b + 1)}
    finally:
        S.PIECE = old
    assert windows == {int(p - o): (int(p), int(x)) for _, p, a, b, x in zip(*whole) for o in range(a, b + 1)}
    assert sorted(windows) == list(range(4901))


def test_repeats_of_one_long_text_survive_a_flush_between_its_pieces(spark, monkeypatch):
    rng = np.random.default_rng(4)
    passage = rng.integers(97, 123, 400, dtype=np.uint8).tobytes()
    noise = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes()
    text = noise(300) + passage + noise(4000) + passage + noise(300)
    monkeypatch.setattr(S, "PIECE", 700)
    monkeypatch.setattr(sharing, "BATCH", 50)
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "key": [2], "text": [text.decode()]})
    slices = list(S.gram_slices(iter([batch]), 2))
    assert len(slices) > 2
    rows = [r for s in slices for r in s.to_pylist()]
    found = set()

    class Groups:  # groupBy().applyInArrow() of the rows, in this process
        def __init__(self, rows):
            self.rows = rows

        def groupBy(self, *by):
            self.by = by
            return self

        def applyInArrow(self, fn, schema):
            groups = {}
            for r in self.rows:
                groups.setdefault(tuple(r[b] for b in self.by), []).append(r)
            types = sharing.SLICE if "grp" in self.rows[0] else sharing.BUNDLE
            return Groups([r for g in groups.values() for r in fn(pa.Table.from_pylist(g, types)).to_pylist()])

    for r in sharing.sharing_owners(Groups(rows), 1, 2, within=True).rows:
        found |= set(np.frombuffer(r["grams"], np.uint64).tolist())
    whole = np.frombuffer(passage, np.uint8)
    assert set(S.anchors(whole, np.array([0, len(whole)]))[4].tolist()) <= found
    docs = spark.createDataFrame([(1, text.decode())], "doc_id long, text string")
    assert sorted(map(tuple, S.report(docs).collect())) == brute([(1, text.decode())])


def test_loser_tree_gives_order_and_shared_prefixes():
    rng = random.Random(1)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(40))) for _ in range(7)]
    coded = [[(S.common(r[i - 1], s, 0) if i else 0, s) for i, s in enumerate(r)] for r in runs]
    out = list(S.merge_runs([iter(c) for c in coded]))
    assert [s for _, _, s in out] == sorted(s for r in runs for s in r)
    for (_, _, a), (_, n, b) in zip(out, out[1:]):
        assert n == S.common(a, b, 0)
