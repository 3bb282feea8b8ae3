"""Quality rules by robust multivariate outliers.

Each text gets a vector of transformed statistics. For every language and
source, minimum-covariance-determinant estimates of its centre and scatter are
found by concentration steps: of the documents of a group, the share with the
least Mahalanobis distances gives the next mean and covariance. A document that
lies beyond the chi-square quantile for its group is rejected.

Everything is DataFrame expressions. A step is two aggregations with small
partial states (an exact percentile of rounded log distances; sums of products),
so a hot group is never gathered. The triangular factors of the covariances are
unrolled into columns. Estimates are written before they are joined, so Spark
knows their size, one row a group: it broadcasts them below its threshold, and
never deals all rows of a hot group to one task.

A statistic that is constant in most of a group would make its covariance
singular, so every variance has a floor, the square of the statistic's
resolution, which also keeps tiny deviations from counting as outliers.

Cases: a null text has no words; texts under 20 words fail the base rules and
take no part in the estimates; a group of fewer than MIN_GROUP documents uses
the estimates of its language, or of all; a null language or source is a group;
repeated rows count as they come; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.stage import release, save

WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30
#: Share of a group that a concentration step keeps; steps; least group.
KEEP, STEPS, MIN_GROUP = 0.75, 4, 100
#: Statistics, with the resolution that floors their standard deviation.
STATS = {"word_length": 0.06, "symbols": 0.04, "capitals": 0.05, "marks": 0.04, "dup_lines": 0.15, "repeats": 0.20}
D = len(STATS)
#: Fixed values for 6 degrees of freedom: the chi-square quantile at 0.75, the
#: factor that makes the scatter of the nearest 75 % consistent (0.75 over the
#: chi-square distribution of 8 degrees at that quantile), and the quantile at
#: 1 - 1e-5 that rejects.
NEAR, CONSISTENT, FAR = 7.8408, 1.3616, 33.107


def base_statistics(text: str = "text") -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_caps, n_marks, n_lines, n_letters of a text."""
    t = f"coalesce({text}, '')"
    words = rf"filter(split({t}, '[\\x20\\x09-\\x0D]+', -1), w -> w <> '')"
    lines = rf"filter(split({t}, '\n', -1), l -> l rlike '[^\\x20\\x09-\\x0D]')"
    # let w = words; g = hashes of its windows; only texts with equal windows need their places
    places = "transform(filter(s, (x, j) -> (j > 0 and get(s, j - 1).h = x.h) or get(s, j + 1).h <=> x.h), x -> x.i)"
    covered = f"aggregate(transform(p, (x, j) -> least({WINDOW}, coalesce(get(p, j + 1) - x, {WINDOW}))), 0L, (a, x) -> a + x)"
    sorted_places = f"transform(array(array_sort(transform(g, (h, i) -> struct(h, i)))), s -> transform(array(array_sort({places})), p -> {covered})[0])[0]"
    repeated = f"transform(array(transform(sequence(1, greatest(size(h) - {WINDOW - 1}, 1)), i -> xxhash64(slice(h, i, {WINDOW})))), g -> if(size(h) < {WINDOW} or size(array_distinct(g)) = size(g), 0L, {sorted_places}))[0]"
    of_words = f"transform(array({words}), w -> struct(size(w) as n_words, aggregate(w, 0L, (a, x) -> a + length(x)) as word_chars, transform(array(transform(w, x -> xxhash64(x))), h -> {repeated})[0] as n_repeat_words))[0]"
    of_lines = f"transform(array({lines}), l -> struct(size(l) as n_lines, size(l) - size(array_distinct(l)) as n_dup_lines))[0]"
    count = lambda p, name: F.expr(f"cast(regexp_count({t}, '{p}') as bigint)").alias(name)
    return [F.expr(of_words).alias("w"), F.expr(of_lines).alias("l"), count("[#*$%&|<>]", "n_symbols"), count(r"\\p{Lu}", "n_caps"), count(r"[^\\p{L}\\p{N}\\s]", "n_marks")]


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The base statistics of each row, and its transformed vector x0 .. x5 (null under MIN_WORDS words)."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))  # noqa: E731 - null is no empty name
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), named(lang_col).alias("lang"), named(source_col).alias("source"), F.col(text_col).alias("text"))
    flat = own.select("doc_id", "lang", "source", *base_statistics()).select("doc_id", "lang", "source", *[F.col(f"w.{c}").cast("long").alias(c) for c in ("n_words", "word_chars", "n_repeat_words")], F.col("l.n_lines").cast("long").alias("n_lines"), F.col("l.n_dup_lines").cast("long").alias("n_dup_lines"), "n_symbols", "n_caps", "n_marks")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    part = lambda a, b: F.asin(F.sqrt(F.least(F.col(a) / F.greatest(F.col(b), F.lit(1)), F.lit(1.0))))
    x = [F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))), part("n_symbols", "word_chars"), part("n_caps", "word_chars"), part("n_marks", "word_chars"), part("n_dup_lines", "n_lines"), part("n_repeat_words", "n_words")]
    return flat.withColumn("base_failed", failed).select("*", *[F.when(F.col("n_words") >= MIN_WORDS, v).alias(f"x{i}") for i, v in enumerate(x)])


def grouped(stats: DataFrame, min_group: int) -> DataFrame:
    """stats with g: language and source, or a wider group where that is too small."""
    full = F.col("x0").isNotNull().cast("long")
    both = stats.groupBy("lang", "source").agg(F.sum(full).alias("n"))
    langs = both.groupBy("lang").agg(F.sum("n").alias("n_lang"))
    names = both.join(langs, "lang").select("lang", "source", F.when(F.col("n") >= min_group, F.to_json(F.array("lang", "source"))).when(F.col("n_lang") >= min_group, F.to_json(F.array("lang"))).otherwise(F.lit("[]")).alias("g"))
    return stats.join(save(names, "groups"), ["lang", "source"])


def moments_to_factor(moments: DataFrame) -> DataFrame:
    """(g, m0.., l00 ..): mean and lower triangular factor of the covariance, from sums."""
    out = moments
    for i in range(D):
        out = out.withColumn(f"m{i}", F.col(f"s{i}") / F.col("n"))
    floors = [v * v for v in STATS.values()]
    for i in range(D):
        for j in range(i + 1):
            cov = (F.col(f"q{i}_{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) * CONSISTENT
            if i == j:
                cov = F.greatest(cov, F.lit(0.0)) + floors[i]
            rest = reduce(lambda a, k: a - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}"), range(j), cov)  # noqa: B023
            out = out.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(floors[i] * 1e-3))) if i == j else rest / F.col(f"l{j}_{j}"))
    return out.select("g", *[f"m{i}" for i in range(D)], *[f"l{i}_{j}" for i in range(D) for j in range(i + 1)])


def with_distance(rows: DataFrame, factors: DataFrame) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance from their group's centre."""
    out = rows.join(factors, "g", "left")
    for i in range(D):
        y = reduce(lambda a, k: a - F.col(f"l{i}_{k}") * F.col(f"y{k}"), range(i), F.col(f"x{i}") - F.col(f"m{i}"))  # noqa: B023
        out = out.withColumn(f"y{i}", y / F.col(f"l{i}_{i}"))
    return out.select(*rows.columns, reduce(lambda a, i: a + F.col(f"y{i}") * F.col(f"y{i}"), range(1, D), F.col("y0") * F.col("y0")).alias("d2"))


def sums_of(rows: DataFrame) -> DataFrame:
    first = [F.sum(f"x{i}").alias(f"s{i}") for i in range(D)]
    second = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i in range(D) for j in range(i + 1)]
    return rows.groupBy("g").agg(F.count("*").alias("n"), *first, *second)


def estimates(rows: DataFrame, steps: int, keep: float) -> DataFrame:
    """Centre and factor of each group: from medians and their deviations, then concentration steps."""
    cols = [f"x{i}" for i in range(D)]
    mid = save(rows.groupBy("g").agg(*[F.percentile(F.round(c, 3), 0.5).alias(f"m{i}") for i, c in enumerate(cols)]), "medians")
    spread = rows.join(mid, "g").groupBy("g").agg(*[F.first(f"m{i}").alias(f"m{i}") for i in range(D)], *[(1.4826 * F.percentile(F.round(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 3), 0.5)).alias(f"v{i}") for i in range(D)])
    diagonal = [(F.sqrt(F.col(f"v{i}") * F.col(f"v{i}") + list(STATS.values())[i] ** 2) if i == j else F.lit(0.0)).alias(f"l{i}_{j}") for i in range(D) for j in range(i + 1)]
    factors = save(spread.select("g", *[f"m{i}" for i in range(D)], *diagonal), "mcd")
    for _ in range(steps):
        near = with_distance(rows, factors).withColumn("ln", F.round(F.log(F.col("d2") + 1e-9), 3))
        edge = save(near.groupBy("g").agg(F.percentile("ln", keep).alias("edge")), "edges")
        better = save(moments_to_factor(sums_of(near.join(edge, "g").where("ln <= edge"))), "mcd")
        release(edge, factors)
        factors = better
    return factors


def verdicts(docs: DataFrame, *, steps: int = STEPS, keep: float = KEEP, far: float = FAR, min_group: int = MIN_GROUP, **cols) -> DataFrame:
    """The statistics of each row with base_failed, d2 and kept."""
    # one pass over the texts: the groups are counted on its rows
    stats = save(statistics(docs, **cols), "statistics")
    rows = save(grouped(stats, min_group), "grouped")
    release(stats)
    fit = rows.where(F.col("x0").isNotNull())
    scored = with_distance(rows, estimates(fit, steps, keep))
    good = ~F.col("base_failed") & (F.coalesce("d2", F.lit(0.0)) <= far)
    return scored.withColumn("kept", good)


def report(scored: DataFrame) -> DataFrame:
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("d2").alias("distance2"))
