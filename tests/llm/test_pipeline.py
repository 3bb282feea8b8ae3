import random

import corpus_pipeline
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_ngram_join import brute as groups
from tests.llm.test_pii import brute as personal


def test_each_stage_on_what_the_one_before_kept(spark, tmp_path):
    rng = random.Random(8)
    vocab = {"en": ["the", "hare", "lomit", "fendor", "wist"], "de": ["gluv", "prunk", "zähd", "kurq", "und"]}
    text = lambda v, n: " ".join(rng.choice(vocab[v]) + rng.choice(["", "", "x", "y", "q"]) for _ in range(n))
    rows = [(i, text(v, rng.randrange(20, 60)), v, f"s{i % 3}") for i, v in enumerate(rng.choices(["en", "de"], k=80))]
    items = [(0, text("en", 25)), (1, "one two three")]
    rows += [(100, rows[4][1], "en", "s0"), (101, rows[5][1] + " more", "en", "s1"), (102, "the hare " + items[0][1] + " wist", "en", "s1"), (103, "123 456", "en", "s2"), (104, None, None, None), (105, text("de", 30) + " a@b.org", "de", "s2")]
    docs = [(i, t, lang, s, len(t or "")) for i, t, lang, s in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "mix":
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = now.collect()
    pairs = lambda name: [(r["doc_id"], r["text"]) for r in kept[name]]
    ids = lambda name: {r["doc_id"] for r in kept[name]}
    assert ids("language") == {r[0] for r in rows} - {103, 104}
    assert ids("near_duplicates") == {i for i, _, c in groups(pairs("language")) if i == c}
    assert not {100, 101} & ids("near_duplicates")
    assert ids("decontaminate") == {r[0] for r in contamination(pairs("near_duplicates"), items) if not r[5]}
    assert 102 not in ids("decontaminate") and ids("pii") == ids("decontaminate")
    before = dict(pairs("decontaminate"))
    for i, t in pairs("pii"):
        assert personal(t) == [] and (t == before[i] or personal(before[i]))
    assert ids("mix") == ids("pii") and abs(sum(r["taken"] for r in kept["mix"]) - 1.5 * sum(r["size"] for r in kept["mix"])) <= 3
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["mix"])


def test_empty_repeated_and_clashing(spark, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long, pii_spans array<string>, _copy int, key string"
    words = lambda i: " ".join(f"w{chr(97 + (i * 7 + k * 3) % 26)}{chr(97 + (k * 5 + i) % 26)}x" for k in range(40))
    rows = [(i, words(i), "en", f"s{i % 2}", 9, ["p"], i, "k") for i in range(12)]
    rows += [rows[3], (3, "another text of its own in here", "en", None, 9, None, None, None), (None, None, None, None, None, None, None, None), (50, "", None, "", 0, [], 0, "")]
    for case, docs, items in (("full", rows, [(1, words(5))]), ("no_items", rows, []), ("no_docs", [], [(1, "a b")]), ("no_langs", [(*r[:2], None, *r[3:]) for r in rows], [(None, None)])):
        spark.createDataFrame(docs, columns).write.parquet(f"{tmp_path}/{case}/documents.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/{case}/benchmark.parquet")
        now = spark.read.parquet(f"{tmp_path}/{case}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, f"{tmp_path}/{case}")
            assert now.columns == [c.split()[0] for c in columns.split(", ")], name
            now = spark.createDataFrame(now.collect(), columns)
        left = sorted(str(r["doc_id"]) for r in now.collect())
        assert corpus_pipeline.run(spark, f"{tmp_path}/{case}").count() == len(left)
        if case in ("no_docs", "no_langs"):
            assert not left
        else:
            assert left == sorted([str(i) for i in range(12) if case == "no_items" or i != 5] + ["3", "3"])
            assert all(r["pii_spans"] == ["p"] and r["n_chars"] == 9 and r["key"] == "k" for r in now.collect() if r["source"] is not None)
