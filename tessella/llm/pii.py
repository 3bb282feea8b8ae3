"""Personal data: fixed patterns, and terms that disclose what the patterns protect.

The patterns find e-mail addresses, IP addresses, card and phone numbers.
Protected entities are each value found, and what it belongs to: the domain of
an address, the network of an IP, the issuer of a card, the area of a phone. A
word in documents with an entity discloses it by PMI(word, entity) / IC(entity):
how much of the entity's information content the word gives away, by the
documents of the corpus that have either or both, one of which is put down to
chance. Words that exceed the threshold, with enough evidence, are spans of kind
``term`` in documents with that entity, and are generalised like the rest.

Enough evidence is more than chance brings about anywhere in the corpus. Were
words dealt to documents at random, each document with as many and each word in
as many as now, a word would meet an entity in about mu = n_t * L / U classes: L
different words are in the entity's classes, U in all documents, each with its
repeats. It meets it in k. The Chernoff bound of a Poisson count puts the chance of
that at exp(-(k log(k / mu) - k + mu)), which must stay below ``ERROR`` divided by
entities times words of the corpus; so the bar grows with entities and vocabulary.

Evidence is near-duplicate classes of whole documents: a text and its near copies
are one. Words count wherever they stand in a document, but not inside of
personal data. Only entities in several classes have their documents' words
looked at, and only words that are rare enough to reach the threshold; neither
leaves out a term. Classes are components of links between texts that agree in
NEAR of their BINS least 3-gram hashes; texts of Jaccard similarity 0.75 meet
with a probability of 0.997, more similar ones nearly always, and meet the first
and the last text of their band only. All of it is DataFrame expressions. Places
of matches come from the lengths of what lies between them.

The patterns below accept what their plain forms accept; possessive repeats and
the look-behind only keep long runs of one kind from being tried again from
each of their characters.

Cases: a null or empty text has no spans; an empty table stays empty; repeated
doc_ids share the terms of their entities but keep their own spans; spans may
overlap between kinds, and are joined when text is replaced; other columns are
kept, whatever their names.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.components import components
from tessella.llm.stage import save

#: Fixed patterns, in the order in which kinds are listed.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no valid match of the kind.
NEEDS = {"email": r"@[A-Za-z0-9-]+\.", "ip": r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
OCTET = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"
KINDS = (*PATTERNS, "term")
SPAN = "array<struct<kind:int,start:int,stop:int,value:string>>"
WORD = r"[\p{L}\p{N}_]"
#: Evidence for disclosure; share of an entity's information that discloses it: half; least length of a term.
MIN_CONTEXTS, DISCLOSURE, MIN_WORD = 3, 0.5, 3
#: Chance that some word of a corpus without disclosing words is taken for one.
ERROR = 0.01
#: Bins and bands of a text's sketch; share of agreeing bins that makes two texts near copies.
BINS, BAND, NEAR = 64, 4, 0.7


def located(text: Column, pattern: Column, kind: int) -> Column:
    """Non-overlapping matches of ``pattern`` with their places in code points."""
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    between = F.call_function("split", text, pattern, F.lit(-1))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["gap"])
        b = a + F.length(x["value"])
        return F.struct(b.alias("at"), F.array_append(acc["spans"], F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("stop"), x["value"].alias("value"))).alias("spans"))

    pairs = F.zip_with(found, F.slice(between, F.lit(1), F.size(found)), lambda v, g: F.struct(v.alias("value"), g.alias("gap")))
    return F.aggregate(pairs, start, step, lambda acc: acc["spans"])


def luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, d * 2).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, span: Column) -> Column:
    value = span["value"]
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\.", -1), lambda p: p.rlike(OCTET))
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """All valid spans of the fixed patterns, by kind and start."""
    parts = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        spans = F.filter(located(text, F.lit(pattern), i), partial(valid, kind))
        parts.append(F.when(text.rlike(NEEDS[kind]), spans).otherwise(F.array().cast(SPAN)))
    return F.concat(*parts)


def entities(span: Column) -> Column:
    """Names of the entities of a span: the value, in one of its spellings, and what it belongs to."""
    v, kind = span["value"], span["kind"]
    digits = F.regexp_replace(v, "[^0-9]", "")
    value = F.when(kind == 0, F.lower(v)).when(kind == 1, v).otherwise(digits)
    holder = F.when(kind == 0, F.lower(F.substring_index(v, "@", -1))).when(kind == 1, F.substring_index(v, ".", 2)).when(kind == 2, F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 5))
    return F.array(F.concat_ws(":", kind.cast("string"), value), F.concat_ws(":", kind.cast("string"), F.lit("of"), holder))


def all_entities(spans: str) -> Column:
    return F.array_distinct(F.flatten(F.transform(spans, entities)))


def free(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that is no column of ``docs`` yet."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def classes(texts: DataFrame) -> DataFrame:
    """(key, class): near-duplicate classes of different texts, each named by its least key; (key, text) come in."""
    words = F.split(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")), " ")
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - 2, F.lit(1))), lambda i: F.xxhash64(F.slice("w", i, F.lit(3))))
    grams = texts.select("key", words.alias("w")).select("key", F.explode(runs).alias("h"))
    least = grams.groupBy("key", F.pmod("h", F.lit(BINS)).cast("int").alias("bin")).agg(F.min("h").alias("h"))
    held = least.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("bin", "h"))).alias("bins"))
    sketch = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda i: F.coalesce(F.try_element_at("bins", i), F.lit(0)))
    sketches = held.select("key", sketch.alias("sketch"))
    bands = F.transform(F.sequence(F.lit(0), F.lit(BINS // BAND - 1)), lambda i: F.struct(i.alias("band"), F.slice("sketch", i * BAND + 1, F.lit(BAND)).alias("part")))
    posts = sketches.select("key", "sketch", F.explode(bands).alias("b")).where(F.exists("b.part", lambda x: x != 0))
    posts = posts.select("key", "sketch", F.xxhash64("b").alias("b"))
    ends = posts.groupBy("b").agg(F.min(F.struct("key", "sketch")).alias("x"), F.max(F.struct("key", "sketch")).alias("y")).where("x.key <> y.key")
    ends = ends.select("b", F.explode(F.array("x", "y")).alias("to"))
    agree = F.aggregate(F.zip_with("sketch", "to.sketch", lambda p, q: F.when((p == q) & (p != 0), 1).otherwise(0)), F.lit(0), lambda t, v: t + v)
    either = F.aggregate(F.zip_with("sketch", "to.sketch", lambda p, q: F.when((p != 0) | (q != 0), 1).otherwise(0)), F.lit(0), lambda t, v: t + v)
    links = posts.join(ends, "b").where((F.col("key") != F.col("to.key")) & (agree >= NEAR * either)).select(F.col("key").alias("a"), F.col("to.key").alias("b")).distinct()
    links = save(links, "near_copies")
    if links.isEmpty():
        return texts.select("key", F.col("key").alias("class"))
    found = components(links, "a", "b")
    return texts.select("key").join(found, F.col("key") == found["node"], "left").select("key", F.coalesce("component", "key").alias("class"))


def words(text: Column) -> Column:
    """Different words of a text that may be terms."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}{{{MIN_WORD},}}"), F.lit(0)))
    return F.filter(found, lambda w: ~w.rlike("^[0-9]+$"))


def beyond_chance(k: Column, mu: Column, tests: Column) -> Column:
    """Whether a count of ``k`` where ``mu`` are expected is too rare for one of ``tests`` tries."""
    return (k > mu) & (k * F.log(k / mu) - k + mu >= F.log(tests / F.lit(ERROR)))


def disclosed(marked: DataFrame, docs: DataFrame, *, min_contexts: int, disclosure: float) -> DataFrame | None:
    """(key, terms): words of a text that disclose one of its entities; None if no word has evidence enough.

    ``marked`` has text and spans of the documents with entities, ``docs`` all texts;
    a key is the hash of a text. A text meets terms by its words, so that an entity
    with many terms brings its documents only those that they hold.
    """
    keyed = marked.withColumn("key", F.xxhash64("text"))
    per = keyed.select("key", F.explode(all_entities("spans")).alias("entity")).groupBy("entity", "key").agg(F.count("*").alias("n"))
    per = save(per, "entities")
    often = per.groupBy("entity").agg(F.sum("n").alias("n_e"), F.count("*").alias("texts")).where(F.col("texts") >= min_contexts).select("entity", "n_e")
    held = save(per.join(often, "entity"), "repeated_entities")
    if held.isEmpty():
        return None
    outside = replaced(F.col("text"), F.col("spans"), F.array(*[F.lit(" ")] * len(KINDS)))
    own = keyed.join(held.select("key").distinct(), "key", "left_semi")
    texts = save(own.groupBy("key").agg(F.first("text").alias("text"), F.first("spans").alias("spans")).select("key", "text", outside.alias("outside")), "entity_texts")
    held = save(held.join(classes(texts), "key"), "entity_classes")
    several = held.groupBy("entity").agg(F.count_distinct("class").alias("c")).where(F.col("c") >= min_contexts)
    held = save(held.join(several.select("entity"), "entity", "left_semi"), "evident_entities")
    if held.isEmpty():
        return None
    own = held.groupBy("key").agg(F.first("class").alias("class"))
    within = texts.join(own, "key").select("key", "class", F.explode(words("outside")).alias("term"))
    counts = save(docs.select(F.explode(words("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")), "word_counts")
    df = counts.where(F.col("n_t") >= min_contexts)
    total = float(docs.count() + 1)
    wide = within.select("class", "term").distinct().groupBy("class").agg(F.count("*").alias("wide"))
    spread = held.select("entity", "class").distinct().join(wide, "class").groupBy("entity").agg(F.sum("wide").alias("wide"))
    extent = counts.agg(F.sum("n_t").alias("all_words"), F.count(F.when(F.col("n_t") >= min_contexts, 1)).alias("vocabulary"))
    tries = held.agg(F.count_distinct("entity").alias("entities"))
    # n_te <= n_e, so a more frequent word cannot reach the threshold
    rare = F.log("n_t") <= disclosure * F.log("n_e") + (1 - disclosure) * F.log(F.lit(total)) + 1e-9
    seen = held.drop("class").join(within.join(df, "term"), "key").where(rare)
    each = seen.groupBy("entity", "term", "class").agg(F.sum("n").alias("n"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    evidence = each.groupBy("entity", "term").agg(F.sum("n").alias("n_te"), F.count("*").alias("k"), F.first("n_e").alias("n_e"), F.first("n_t").alias("n_t"))
    pmi = F.log((F.col("n_te") - 1) * total / (F.col("n_t") * F.col("n_e")))
    near = evidence.where((F.col("k") >= min_contexts) & (pmi >= disclosure * F.log(F.lit(total) / F.col("n_e"))))
    known = near.join(spread, "entity").join(F.broadcast(extent)).join(F.broadcast(tries))
    mu = F.col("n_t") * F.col("wide") / F.col("all_words")
    terms = save(known.where(beyond_chance(F.col("k"), mu, F.col("entities") * F.col("vocabulary"))).select("entity", "term"), "terms")
    if terms.isEmpty():
        return None
    pairs = within.select("key", "term").join(terms, "term").join(held.select("key", "entity"), ["key", "entity"], "left_semi")
    return save(pairs.groupBy("key").agg(F.array_sort(F.collect_set("term")).alias("terms")), "own_terms")


def mark(docs: DataFrame, *, text_col: str = "text", spans_col: str = "pii_spans", min_contexts: int = MIN_CONTEXTS, disclosure: float = DISCLOSURE) -> DataFrame:
    """``docs`` with a column ``spans_col``: base spans, then terms, in order of kind and start."""
    if spans_col.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"{spans_col} is a column already: name another with spans_col")
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = save(docs.withColumn(spans_col, base_spans(text)), "base_spans")
    found = rows.where(F.size(spans_col) > 0)
    marked = found.select(F.col(text_col).alias("text"), F.col(spans_col).alias("spans"))
    own = disclosed(marked, rows.select(F.col(text_col).alias("text")), min_contexts=min_contexts, disclosure=disclosure)
    if own is None:
        return rows
    key, own_terms = free(rows, "_key"), free(rows, "_terms")
    own = own.select(F.col("key").alias(key), F.col("terms").alias(own_terms))
    pattern = F.concat(F.lit(f"(?iu)(?<!{WORD})(?:"), F.array_join(own_terms, "|"), F.lit(f")(?!{WORD})"))
    more = F.when(F.col(own_terms).isNotNull(), F.filter(located(text, pattern, len(PATTERNS)), lambda t: ~F.exists(spans_col, lambda s: (s["start"] < t["stop"]) & (t["start"] < s["stop"]))))
    joined = found.withColumn(key, F.xxhash64(text)).join(own, key, "left").withColumn(spans_col, F.concat(spans_col, F.coalesce(more, F.array().cast(SPAN)))).select(*rows.columns)
    return rows.where(F.size(spans_col) == 0).unionByName(joined)


def spelled(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def report(marked: DataFrame, id_col: str = "doc_id", spans_col: str = "pii_spans") -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans."""
    c = F.col(spans_col)
    count = lambda i: F.size(F.filter(c, lambda s: s["kind"] == i)).cast("long")
    kinds = [count(i).alias(f"n_{k}") for i, k in enumerate(PATTERNS)]
    base = F.filter(c, lambda s: s["kind"] < len(PATTERNS))
    return marked.select(F.col(id_col).cast("long").alias("doc_id"), *kinds, F.sha2(spelled(base), 256).alias("base_sha256"), spelled(c).alias("spans"), count(len(PATTERNS)).alias("n_term"))


def replaced(text: Column, spans: Column, names: Column | None = None) -> Column:
    """``text`` with each union of overlapping spans replaced by the name of its first kind."""
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS]) if names is None else names
    by_start = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    empty = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        inside = s["start"] < acc["at"]
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, F.get(names, s["kind"]))).alias("out"), F.greatest(acc["at"], s["stop"]).alias("at"))

    return F.aggregate(by_start, empty, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])))


def sanitise(docs: DataFrame, *, text_col: str = "text", **how) -> DataFrame:
    """``docs`` with all spans replaced in the text; n_chars, where there is one, follows."""
    text, spans = F.col(text_col), free(docs, "pii_spans")
    new = F.when(F.size(spans) > 0, replaced(text, F.col(spans))).otherwise(text)
    out = mark(docs, text_col=text_col, spans_col=spans, **how).withColumn(text_col, new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
