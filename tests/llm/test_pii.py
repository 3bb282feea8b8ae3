import hashlib
import math
import random
import re
from collections import Counter

from tessella.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 * (x > 9)
    return t % 10 == 0


def brute(text):
    out = []
    for kind, p in PLAIN.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def texts():
    rng = random.Random(11)
    bits = ["a.b@c.d", "x@y", "@", ".", "-", "+1 (456) 555-2186", "4041894974608795", "4539 1488 0343 6467", "1.2.3.4", "300.1.1.1", "001.02.3.255", "1.2.3.4.5.6.7.8", "_d@e.f-g.h.", "+", "é", "\U0001f600", "\n", " ", "12", "%", "0000-0000-0000-0000", "+49 30 1234567 .", "word"]
    out = ["".join(rng.choice(bits) + rng.choice(["", " ", ""]) for _ in range(rng.randrange(25))) for _ in range(400)]
    return out + [None, "", "9" * 3000, "a" * 3000 + "@", "1 " * 2000, "a@b.c_d@e.f " * 200, "+" + "1" + " " * 2000]


def test_base_spans_equal_plain_patterns(spark):
    rows = [(i, t, "q") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in pii.report(pii.mark(docs)).collect()}
    for i, t, _ in rows:
        want = brute(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k in PLAIN] == [sum(w[0] == k for w in want) for k in PLAIN]
        assert got[i]["spans"].startswith(",".join(f"{k}:{a}:{b}" for k, a, b in want))


def test_terms_that_disclose_an_entity_are_generalised(spark):
    rng = random.Random(2)
    filler = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x" for i in range(200)]
    some = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = [(i, f"{some(20)} Zorbo writes from zz@mail.org {some(20)}", "s", 0) for i in range(6)]
    rows += [(10 + i, some(60), "s", 0) for i in range(200)] + [(500 + i, f"copy Quux of the text q{i}@mail.org", "s", 0) for i in range(2)] * 4
    rows += [(900, None, "s", None), (901, "zorbo, ZORBO; and +49 30 1234567 zz@mail.org", "s", 44), (902, "zorbo alone", "s", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    got = {r["doc_id"]: r for r in clean.collect()}
    assert got[901]["text"] == "<TERM>, <TERM>; and <PHONE> <EMAIL>" and got[901]["n_chars"] == len(got[901]["text"])
    assert " <TERM> writes from <EMAIL> " in got[0]["text"] or " <TERM> <TERM> <TERM> <EMAIL> " in got[0]["text"]
    assert got[902]["text"] == "zorbo alone" and got[900]["text"] is None and got[500]["text"] == "copy Quux of the text <EMAIL>"
    assert all(got[10 + i]["text"] == rows[6 + i][1] for i in range(200))
    assert pii.report(pii.mark(docs.limit(0))).count() == 0


def test_evidence_is_different_documents_whatever_stands_beside_the_entity(spark):
    rng = random.Random(5)
    filler = [f"v{chr(97 + i % 26)}{chr(97 + i // 26)}y" for i in range(300)]
    some = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = [(i, f"{some(25)} contact Janine Dorrit at jane@x.com for details {some(25)}") for i in range(12)]
    rows += [(20 + i, f"{some(30)}\nOrvyl Tamsin\n{some(12)}\nphone: +49 30 1234567\n{some(9)}") for i in range(8)]
    copy = some(80).split()
    rows += [(40 + i, " ".join([*copy[: 7 * i], f"edit{i}", *copy[7 * i :], "Mirabo q@near.org"])) for i in range(8)]
    rows += [(100 + i, some(60)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert all("Janine" not in got[i] and "Dorrit" not in got[i] and "<EMAIL>" in got[i] for i in range(12))
    assert all("Orvyl" not in got[20 + i] and "Tamsin" not in got[20 + i] for i in range(8))
    assert all(got[40 + i] == rows[20 + i][1].replace("q@near.org", "<EMAIL>") for i in range(8))
    kept = sum(w in got[i] for i, t in rows[:20] for w in t.split() if w in filler)
    assert kept == sum(w in filler for i, t in rows[:20] for w in t.split())


def by_hand(rows, min_contexts=pii.MIN_CONTEXTS, disclosure=pii.DISCLOSURE):
    """(doc_id, term) by the definition: PMI over IC, and more than chance, of documents without near copies."""
    words = {i: {w for w in re.findall(r"\w{3,}", re.sub("|".join(PLAIN.values()), " ", t).lower()) if not w.isdigit()} for i, t in rows}
    everywhere = {i: {w for w in re.findall(r"\w{3,}", t.lower()) if not w.isdigit()} for i, t in rows}
    counts = Counter(w for ws in everywhere.values() for w in ws)
    held = {}
    for i, t in rows:
        for kind, a, b in brute(t):
            v = t[a:b].lower()
            d = re.sub("[^0-9]", "", v)
            of = {"email": v.split("@")[-1], "ip": ".".join(v.split(".")[:2]), "card": d[:6], "phone": d[:5]}[kind]
            for e in ((kind, v if kind in ("email", "ip") else d), (kind, "of", of)):
                held.setdefault(e, set()).add(i)
    total, out = len(rows) + 1, set()
    held = {e: ids for e, ids in held.items() if len(ids) >= min_contexts}
    bar = math.log(len(held) * sum(n >= min_contexts for n in counts.values()) / pii.ERROR)
    for ids in held.values():
        width = sum(len(words[i]) for i in ids)
        for term in set().union(*(words[i] for i in ids)):
            both = sum(term in words[i] for i in ids)
            n_t = counts[term]
            mu = n_t * width / sum(counts.values())
            if both <= mu or both * math.log(both / mu) - both + mu < bar:
                continue
            if both >= min_contexts and math.log((both - 1) * total / (n_t * len(ids))) >= disclosure * math.log(total / len(ids)):
                out |= {(i, term) for i in ids if term in words[i]}
    return out


def test_terms_equal_pmi_over_information_content_by_hand(spark):
    rng = random.Random(13)
    filler = [f"u{chr(97 + i % 26)}{chr(97 + i // 26)}z" for i in range(400)]
    some = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    holders = ["acme.org", "near.net", "far.example.com"]
    rows = []
    for i in range(60):
        h = rng.choice(holders)
        word = {"acme.org": "Acmecorp", "near.net": "nearby", "far.example.com": "common"}[h]
        rows.append((i, f"{some(12)} {word if rng.random() < 0.6 else ''} p{i % 17}@{h} {some(14)} {'10.20.' + str(i) + '.4 intranet' if i % 9 == 0 else ''} +49 30 12345{i % 6:02d}"))
    rows += [(100 + i, some(25) + (" common" if i % 2 else "")) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    got = {(r["doc_id"], text[r["doc_id"]][int(a) : int(b)].lower()) for r in pii.report(pii.mark(docs)).collect() for k, a, b in (x.split(":") for x in r["spans"].split(",") if x) if k == "term"}
    want = by_hand(rows)
    assert got == want and {t for _, t in want} >= {"acmecorp", "nearby", "intranet"} and "common" not in {t for _, t in want}


def test_a_natural_vocabulary_has_no_terms_by_chance(spark):
    rng = random.Random(29)
    names = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(4000)]
    weights = [1 / (r + 3) for r in range(len(names))]
    holders = ["often.org", "mail1.net", "mail2.net", "mail3.net"]

    def row(i, word=""):
        ws = rng.choices(names, weights, k=rng.choice([15, 60, 60, 400]))
        at = f"p{i}@{rng.choices(holders, [20, 1, 1, 1])[0]}" if i % 3 == 0 else ""
        return (i, " ".join([*ws, word, at]))

    clean = [row(i) for i in range(1500)]
    planted = [(5000 + i, f"{row(1)[1]} Veldram x{i}@mail2.net") for i in range(8)]
    spans = lambda rows: {(r["doc_id"], s) for r in pii.report(pii.mark(spark.createDataFrame(rows, "doc_id long, text string"))).collect() for s in r["spans"].split(",") if s.startswith("term")}
    assert spans(clean) == set()
    text = dict(planted)
    got = spans(clean + planted)
    assert {(i, text[i][slice(*map(int, s.split(":")[1:]))]) for i, s in got} == {(i, "Veldram") for i, _ in planted}


def test_a_text_gets_only_the_terms_that_it_holds(spark):
    rng = random.Random(3)
    some = lambda n: " ".join(f"g{rng.randrange(400)}k" for _ in range(n))
    rows = [(i, f"{some(20)} Alphaxo{i % 3} {some(5)} staff{i}@big.org") for i in range(60)]
    rows += [(100 + i, some(30)) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = docs.withColumn("spans", pii.base_spans(docs["text"])).where("size(spans) > 0").select("text", "spans")
    own = pii.disclosed(found, docs.select("text"), min_contexts=3, disclosure=0.5)
    assert sorted(tuple(r["terms"]) for r in own.collect()) == sorted((f"alphaxo{i % 3}",) for i in range(60))


def test_clashing_columns_stay(spark):
    rows = [(i, f"text {i} zorbo a@b.org", ["x"], 1, "t", "r") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, PII_spans array<string>, _key int, _terms string, entity string")
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert all((r["PII_spans"], r["_key"], r["_terms"], r["entity"]) == (["x"], 1, "t", "r") and "@" not in r["text"] for r in out.collect())
