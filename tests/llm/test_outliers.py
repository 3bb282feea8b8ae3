import random
import re

import numpy as np

from tessella.llm import outliers as O

WS = r"[\x20\x09-\x0D]"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = {}
    for i in range(len(w) - 7):
        grams.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {p + k for at in grams.values() if len(at) > 1 for p in at for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed


def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(2, 8)))
    out = []
    for i in range(600):
        w = [word() for _ in range(rng.randrange(25, 120))]
        out.append((i, " ".join(w[:20]).capitalize() + ". " + " ".join(w[20:]) + ".", "xx", f"s{i % 3}"))
    for i in range(600, 630):
        out.append((i, " ".join(word() + rng.choice(["***", "&&&", "###"]) for _ in range(60)), "xx", f"s{i % 3}"))
    for i in range(630, 650):
        out.append((i, " ".join(word().upper() + "!!" for _ in range(60)), "xx", f"s{i % 3}"))
    a = " ".join(word() for _ in range(9))
    out += [(700, a + " x " + a + " " + a, "xx", "s0"), (701, None, None, None), (702, "", "xx", "s0"), (703, "a\nb\n\na\n \n \na\t\x0b\U0001f600 é", "xx", None), (704, "x " * 5000, "xx", "s1"), (705, "a b c d e f g h", "yy", "zz"), (0, out[0][1], "xx", "s0")]
    return out


def test_base_columns_equal_brute_force_and_junk_is_rejected(spark):
    data = rows()
    docs = spark.createDataFrame([(*r, 1, 0.0) for r in data], "doc_id long, text string, lang string, source string, n int, d2 double")
    got = O.report(O.verdicts(docs))
    assert not re.search("Python|Arrow", got._jdf.queryExecution().toString())
    got = got.collect()
    assert len(got) == len(data)
    by = {r["doc_id"]: r for r in got}
    for i, t, *_ in data:
        r = by[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute(t), t
        assert not (r["base_failed"] and r["kept"])
    assert sum(by[i]["kept"] for i in range(600)) >= 598
    assert not any(by[i]["kept"] for i in range(600, 650))
    assert O.report(O.verdicts(docs.limit(0))).count() == 0


def distances(x, steps=O.STEPS, keep=O.KEEP):
    """Squared distances of one group by concentration steps, with numpy."""
    floor = np.array(list(O.STATS.values())) ** 2
    mid = np.median(np.round(x, 3), axis=0)
    spread = 1.4826 * np.median(np.round(np.abs(x - mid), 3), axis=0)
    centre, scatter = mid, np.diag(spread**2 + floor)
    for _ in range(steps):
        d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)
        ln = np.round(np.log(d + 1e-9), 3)
        near = x[ln <= np.percentile(ln, 100 * keep)]
        centre = near.mean(axis=0)
        scatter = O.CONSISTENT * (near - centre).T @ (near - centre) / len(near) + np.diag(floor)
    return np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(scatter), x - centre)


def test_distances_and_verdicts_equal_numpy(spark):
    data = [r for r in rows() if r[2] == "xx"]
    data += [(2000 + i, t, None if i % 2 else "", r3) for i, (_, t, _, r3) in enumerate(data[:240])]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    stats = O.grouped(O.statistics(docs), O.MIN_GROUP).where("x0 is not null").toPandas().sort_values(["doc_id", "x0"], ignore_index=True)
    # null and empty languages are two groups, each too small for its sources
    assert {g for g in stats["g"]} >= {'[""]', '["="]'}
    scored = O.verdicts(docs).where("x0 is not null").toPandas().sort_values(["doc_id", "x0"], ignore_index=True)
    x = stats[[f"x{i}" for i in range(O.D)]].to_numpy()
    want = np.zeros(len(x))
    for g in stats["g"].unique():
        mine = (stats["g"] == g).to_numpy()
        want[mine] = distances(x[mine])
    assert np.allclose(scored["d2"], want, rtol=1e-5, atol=1e-7)
    assert (scored["kept"] == (~scored["base_failed"] & (want <= O.FAR))).all()
