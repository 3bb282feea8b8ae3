"""Metrics of an event log: totals, rolling rates, histograms, correlations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.archive import INSERTED, REPLACED, STATUSES
from tessella.operators.scans import SEGMENT_ROWS, framed, numbered


def success() -> Column:
    return F.col("status").isin(INSERTED, REPLACED)


def status_totals(events: DataFrame, *keys: str) -> DataFrame:
    """Rows by status, share of insertions, and wall seconds, per run."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in STATUSES]
    seconds = F.unix_micros(F.max("created_at").cast("timestamp")) - F.unix_micros(F.min("created_at").cast("timestamp"))
    return events.groupBy(*keys).agg(F.count("*").alias("n"), *counts, (F.count_if(success()) / F.count("*")).alias("insertion_share"), (seconds / F.lit(1e6)).alias("wall_seconds"))


def rolling_rate(events: DataFrame, *keys: str, half: int = 25, every: int = 12, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Insertions a minute in a centred frame, at every ``every``-th row; 0 without time or a second row."""
    micros = F.unix_micros(F.col("created_at").cast("timestamp"))
    columns = {"hits": lambda w: F.count_if(success()).over(w), "rows": lambda w: F.count("*").over(w), "span": lambda w: F.last(micros).over(w) - F.first(micros).over(w)}
    out = framed(events.select(*keys, "arrival", "status", "created_at"), keys, ["arrival"], half, half - 1, columns, segment_rows)
    rate = F.when((F.col("rows") >= 2) & (F.col("span") > 0), F.col("hits") * F.lit(60e6) / F.col("span")).otherwise(0.0)
    return out.where(F.col("i") % every == 0).select(*keys, "i", rate.alias("rate"))


def rolling_share(events: DataFrame, *keys: str, half: int = 25, every: int = 12, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Share of each status in the same frames."""
    shares = {s: lambda w, s=s: F.avg((F.col("status") == s).cast("double")).over(w) for s in STATUSES}
    out = framed(events.select(*keys, "arrival", "status"), keys, ["arrival"], half, half - 1, shares, segment_rows)
    return out.where(F.col("i") % every == 0).select(*keys, "i", *STATUSES)


def last_summary(events: DataFrame, *keys: str, n: int = 10, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Of each row, how many of the last ``n`` have each status."""
    counts = {s: lambda w, s=s: F.count_if(F.col("status") == s).over(w) for s in STATUSES}
    return framed(events.select(*keys, "arrival", "status"), keys, ["arrival"], n - 1, 0, counts, segment_rows).select(*keys, "arrival", *STATUSES)


def best_so_far(events: DataFrame, *keys: str, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Running best quality, and rows since the last insertion (null before the first)."""
    rows = numbered(events.select(*keys, "arrival", "status", "quality"), keys, ["arrival"], segment_rows)
    rows = rows.scan({"best": ("max", F.col("quality")), "last": ("max", F.when(success(), F.col("i")))})
    return rows.rows.select(*keys, "arrival", "best", (F.col("i") - F.col("last")).alias("gap"))


def quality_histogram(events: DataFrame, *keys: str, bins: int = 20) -> DataFrame:
    """Rows of each of ``bins`` equal bins of [0, 1]; the last is closed; empty ones have 0."""
    b = F.least(F.floor(F.col("quality") * bins), F.lit(bins - 1)).cast("int")
    found = events.where(F.col("quality").isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg("quality").alias("mean"))
    grid = events.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(found, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean")


def bucket(v: Column, p5: Column, p95: Column, buckets: int) -> Column:
    """Which of ``buckets`` equal parts of [p5, p95] v is in, clamped to the ends; 0 without a span."""
    at = F.floor((v - p5) / F.nullif(p95 - p5, F.lit(0.0)) * buckets)
    return F.when(p95 > p5, F.least(F.greatest(at, F.lit(0)), F.lit(buckets - 1))).otherwise(0).cast("int")


def coverage(rows: DataFrame, scale: DataFrame, buckets: int = 28) -> DataFrame:
    """(axis, bucket, n): rows by bucket of [p5, p95] of each axis, clamped to the ends."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("axis"), F.col(a).alias("v")) for i, a in enumerate(("d0", "d1", "d2"))])).alias("r")).select("r.*").where("v is not null")
    at = bucket(F.col("v"), F.col("p5"), F.col("p95"), buckets)
    return long.join(F.broadcast(scale), "axis").groupBy("axis", at.alias("bucket")).agg(F.count("*").alias("n"))


def correlations(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, i, j, r): Pearson correlation of the descriptors, in one aggregation."""
    names = ("d0", "d1", "d2")
    both = [(i, j) for i in range(3) for j in range(3)]
    corr = [F.corr(names[min(i, j)], names[max(i, j)]).alias(f"r{i}{j}") for i, j in both if i < j]
    wide = rows.groupBy(*keys).agg(*corr)
    value = lambda i, j: F.lit(1.0) if i == j else F.col(f"r{min(i, j)}{max(i, j)}")
    return wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), value(i, j).alias("r")) for i, j in both])).alias("c")).select(*keys, "c.*")


def utilisation(samples: DataFrame) -> DataFrame:
    return samples.groupBy("hostname", "gpu_index").agg(F.avg("utilization").alias("utilization"))


def progress(done: int, total: int, elapsed: float) -> float | None:
    """Seconds left at the present pace; None before the first result."""
    return elapsed / done * (total - done) if done else None
