"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the mix takes the point frac((i + 1/2) / golden ratio) of [0, 1),
which cumulative target shares map to a source, so every stretch of slots is
close to the shares. The slots of a source are ranked; its documents, in hashed
order, are a stream of words (read twice at most) that is cut into as many
blocks of equal size as the source has slots, and the r-th slot takes the r-th
block.

Block k of a source with w words and n slots is [floor(k w / n), floor((k+1) w / n))
of its stream, so each slot gets one and the shares hold up to the last slot.

All rankings and cumulative sums run on two levels (sums of chunks, then rows of
a chunk), so neither a source with a third of all rows nor a corpus of very many
sources is ordered in one task. Everything is DataFrame operations.

Cases: a null or empty text has size 0 and is taken 0 times; a null source is a
source of its own, the last; repeated rows come out one by one; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.stage import release, save

GOLDEN = 0.6180339887498949
WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: Words of a block, at most; small corpora get smaller ones, so that they have about SLOTS slots.
BLOCK, SLOTS = 512, 20_000
CHUNK = 1 << 16
#: Slots of one cell of [0, 1), rows of one bucket of a source's stream, sources of one partition.
CELL_SLOTS, BUCKET_ROWS, SOURCES = 20_000, 5_000, 50_000


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def running(rows: DataFrame, n: int, order: list[Column], **sums: Column) -> DataFrame:
    """``rows`` with, for each name, the sum of its column over the rows before this one in ``order``."""
    cut = save(rows.repartitionByRange(max(1, -(-n // SOURCES)), *order).withColumn("_part", F.spark_partition_id()).select("*", *[c.alias(f"_v_{k}") for k, c in sums.items()]), "ordered")
    line = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy("_part").agg(*[F.sum(f"_v_{k}").alias(f"_v_{k}") for k in sums])
    parts = parts.select("_part", *[F.coalesce(F.sum(f"_v_{k}").over(line), F.lit(0)).alias(f"_b_{k}") for k in sums])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.select("*", *[F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)).alias(f"_w_{k}") for k in sums]).join(F.broadcast(parts), "_part")
    return out.select(*rows.columns, *[(F.col(f"_b_{k}") + F.col(f"_w_{k}")).alias(k) for k in sums])


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, r, source_size, target) of each source of (source, size).

    Sources by code point, null last, are numbered r = 1.. and weigh the given
    weights, repeating. They share ``share`` times all words; what exceeds
    ``most`` times a source's size goes to the others by weight. Sorted by the
    share at which they fill up, full sources are a prefix, found by cumulative
    sums.
    """
    per = save(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source_sizes")
    every = per.agg(F.count("*").alias("n"), F.sum("source_size").alias("words")).first()
    n, goal = every["n"], float(every["words"] or 0) * share
    named = running(per, n, [F.col("source").asc_nulls_last()], r=F.lit(1)).withColumn("r", (F.col("r") + 1).cast("int"))
    w = F.get(F.array(*[F.lit(float(x)) for x in weights]), (F.col("r") - 1) % len(weights))
    named = save(named.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most)), "named_sources")
    weight = named.agg(F.sum("w").alias("w")).first()["w"] or 0.0
    filled = running(named, n, [(F.col("cap") / F.col("w")).asc(), F.col("r").asc()], cap_before=F.col("cap"), w_before=F.col("w"))
    filled = filled.withColumn("level", (goal - F.col("cap_before")) / (F.lit(weight) - F.col("w_before")))
    # the first source, in order of filling up, that does not: its level is that of all after it
    free = filled.where(F.col("cap") / F.col("w") > F.col("level")).agg(F.min_by("level", F.struct(F.col("cap") / F.col("w"), "r")).alias("x")).first()["x"]
    level = float("inf") if free is None else free
    return named.select("source", "r", "source_size", F.least(F.col("cap"), F.col("w") * F.lit(level)).alias("target"))


def source_slots(goals: DataFrame, slots: int) -> DataFrame:
    """(slot, r, rank): the source of each slot, and its number among that source's slots.

    Points and the starts of the sources' shares are put in order cell by cell.
    """
    spark = goals.sparkSession
    every = goals.agg(F.count("*").alias("n"), F.sum("target").alias("t")).first()
    total = every["t"] or 1.0
    cells = max(16, -(-slots // CELL_SLOTS))
    cum = running(goals.where("target > 0").select("r", "target"), every["n"], [F.col("r").asc()], lo=F.col("target")).withColumn("hi", F.col("lo") + F.col("target"))
    cell = lambda x: F.least(F.floor(x * cells).cast("int"), F.lit(cells - 1))
    shares = cum.select("r", (F.col("lo") / total).alias("lo"), (F.col("hi") / total).alias("hi"))
    starts = shares.select("r", "lo", F.explode(F.sequence(cell(F.col("lo")), F.greatest(cell(F.col("lo")), cell(F.col("hi"))))).alias("cell"))
    starts = starts.select("cell", F.greatest("lo", F.col("cell") / cells).alias("u"), F.lit(None).cast("long").alias("slot"), "r")
    point = (F.col("id") + 0.5) * GOLDEN
    line = spark.range(slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("u"))
    line = line.select(cell(F.col("u")).alias("cell"), "u", "slot", F.lit(None).cast("int").alias("r"))
    order = Window.partitionBy("cell").orderBy("u", F.col("slot").asc_nulls_first(), "r")
    placed = starts.unionByName(line).withColumn("r", F.last("r", ignorenulls=True).over(order)).where("slot is not null and r is not null")
    placed = save(placed.select("slot", "r", F.floor(F.col("slot") / CHUNK).alias("chunk")), "placed")
    before = placed.groupBy("r", "chunk").agg(F.count("*").alias("n"))
    before = before.select("r", "chunk", (F.sum("n").over(Window.partitionBy("r").orderBy("chunk")) - F.col("n")).alias("base"))
    within = F.row_number().over(Window.partitionBy("r", "chunk").orderBy("slot")) - 1
    ranked = placed.withColumn("within", within).join(before, ["r", "chunk"]).select("slot", "r", (F.col("base") + F.col("within")).alias("rank"))
    # a source too small for a point of the schedule still gets one slot, at the end
    none = goals.where("target >= 0.5").join(placed.select("r").distinct(), "r", "left_anti").select((F.col("r") + slots).cast("long").alias("slot"), "r", F.lit(0).cast("long").alias("rank"))
    return ranked.unionByName(none)


def streams(sizes: DataFrame, goals: DataFrame, seed: int, buckets: int) -> DataFrame:
    """sizes with r, target, source_size, and each document's place in its source's stream of words."""
    key = F.xxhash64(F.lit(seed), "doc_id", "size")
    rows = sizes.join(goals.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("key", key).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "size"), F.lit(buckets)))
    before = rows.groupBy("r", "bucket").agg(F.sum("size").alias("n"))
    before = before.select("r", "bucket", (F.sum("n").over(Window.partitionBy("r").orderBy("bucket")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("r", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("within", F.sum("size").over(inside) - F.col("size")).join(before, ["r", "bucket"]).select("doc_id", "source", "size", "r", "source_size", "target", (F.col("base") + F.col("within")).alias("at"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = SHARE, most: int = MOST, block: int = BLOCK, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(documents, schedule).

    documents: doc_id, source, size, r, source_size, target, at. schedule: slot,
    doc_id, source, size, at, epoch, start, stop: the words [start, stop) of a
    document that the slot takes.
    """
    sizes = save(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size")), "sizes")
    counts = sizes.agg(F.count("*").alias("n"), F.sum("size").alias("words")).first()
    words = int((counts["words"] or 0) * share)
    per = max(1, min(block, words // SLOTS))
    goals = save(targets(sizes, weights, share, most), "targets")
    slots = save(source_slots(goals, -(-words // per)), "slots")
    own = save(streams(sizes, goals, seed, max(1, -(-counts["n"] // BUCKET_ROWS))), "streams")
    release(sizes)
    lot = slots.groupBy("r").agg(F.count("*").alias("n"))
    lot = save(goals.join(lot, "r").select("r", F.round("target").cast("long").alias("words"), "n").where("words > 0"), "lots")
    pieces = own.where("size > 0").join(lot, "r").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(int(most) - 1))))
    pieces = pieces.withColumn("a", F.col("at") + F.col("epoch") * F.col("source_size")).withColumn("b", F.least(F.col("a") + F.col("size"), F.col("words"))).where("a < b")
    # decimals: words times slots may exceed a long
    block = lambda x: f"((cast({x} + 1 as decimal(19,0)) * cast(n as decimal(19,0)) - 1) div words)"
    edge = lambda k: F.expr(f"(cast({k} as decimal(19,0)) * cast(words as decimal(19,0))) div n")
    pieces = pieces.withColumn("rank", F.explode(F.expr(f"sequence({block('a')}, {block('b - 1')})")))
    start = F.greatest("a", edge("rank")) - F.col("a")
    stop = F.least("b", edge("rank + 1")) - F.col("a")
    schedule = pieces.join(slots, ["r", "rank"]).select("slot", "doc_id", "source", "size", "r", "at", "epoch", start.alias("start"), stop.alias("stop")).where("start < stop")
    return own, schedule


def taken(docs: DataFrame, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, and taken: the words that the mix takes of each document."""
    own, schedule = mix(docs, **how)
    sums = schedule.groupBy("r", "at", "doc_id", "size").agg(F.sum(F.col("stop") - F.col("start")).alias("taken"))
    # words of one source start at different places of its stream, so (r, at) is a row's own where size > 0
    full = own.where("size > 0").join(sums, ["r", "at", "doc_id", "size"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))
    empty = own.where("size = 0").select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return full.unionByName(empty)
