"""The archive: at most one row per cell of the behaviour space, kept by quality.

Without the similarity gate the archive is a set function of its rows (per
cell the best, the first of equals), so statuses and contents are windows and
aggregates. With the gate the arrival that takes a cell depends on what was occupied
before; ``gated`` folds the groups of cells that wait for each other.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.text import creature_id, unit
from tessella.operators.components import components
from tessella.operators.percentiles import matched
from tessella.operators.scans import SEGMENT_ROWS, numbered, segments
from tessella.session import ship
from tessella.sources.tables import stage

#: Fixed values of the gate: least distance to an occupied centroid, and what overrides it.
EPSILON, OVERRIDE = 1.0, 1.2
#: Cells that are occupied at the start have arrivals from here downwards.
GIVEN = -(2**61)
INSERTED, REPLACED = "inserted", "replaced"
REJECTED_FILTER, REJECTED_QUALITY, REJECTED_SIMILARITY = "rejected_filter", "rejected_quality", "rejected_similarity"
STATUSES = (INSERTED, REPLACED, REJECTED_FILTER, REJECTED_QUALITY, REJECTED_SIMILARITY)


def passes() -> F.Column:
    return F.col("quality").isNotNull() & F.col("d0").isNotNull()


def best_per_cell(rows: DataFrame, *keys: str, also: dict[str, Column] | None = None) -> DataFrame:
    """The row of best quality of each (keys, cell), the first arrival of equals.

    ``also`` has further aggregates of the candidates of a cell. max_by aggregates before the shuffle, so a popular cell costs a row a task.
    """
    rest = [c for c in rows.columns if c not in (*keys, "cell")]
    best = rows.where(passes()).groupBy(*keys, "cell").agg(F.max_by(F.struct(*rest), F.struct(F.col("quality"), -F.col("arrival"))).alias("b"), *[c.alias(n) for n, c in (also or {}).items()])
    return best.select(*keys, "cell", *[F.col(f"b.{c}").alias(c) for c in rest], *(also or {}))


def insertion_status(rows: DataFrame, *keys: str, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """rows with status: what an archive without the gate says to each at its arrival."""
    found = segments(rows, [*keys, "cell"], ["arrival"], segment_rows).scan({"_held": ("max", F.when(passes(), F.col("quality")))}, inclusive=False)
    held = F.col("_held")
    status = F.when(~passes(), REJECTED_FILTER).when(held.isNull(), INSERTED).when(F.col("quality") > held, REPLACED).otherwise(REJECTED_QUALITY)
    return found.done().withColumn("status", status).drop("_held")


def placed(rows: DataFrame, centroids: DataFrame, scales: tuple[float, float, float], run: str, epsilon: float) -> DataFrame:
    """(run, arrival, quality, cell, near): ``near`` has the other cells whose centroids lie within ``epsilon``, nearest first.

    Rows that do not pass have no cell. Centroids are one array in every row's
    reach, since an archive's capacity bounds them.
    """
    ok = passes() & ~F.isnan("quality") & ~F.isnan("d0")
    packed = centroids.agg(F.array_sort(F.collect_list(F.struct("idx", *[F.col(c).cast("double").alias(c) for c in ("c0", "c1", "c2")]))).alias("_cells"))
    at = [F.col(f"d{k}").cast("double") * F.lit(float(scales[k])) for k in range(3)]
    gap = lambda s: sum(((s[f"c{k}"] - at[k]) * (s[f"c{k}"] - at[k]) for k in range(1, 3)), (s["c0"] - at[0]) * (s["c0"] - at[0]))
    close = F.filter("_gaps", lambda g: (g["gap"] < epsilon * epsilon) & (g["idx"] != F.col("cell")))
    out = rows.select(run, F.col("arrival").cast("long").alias("arrival"), F.col("quality").cast("double").alias("quality"), *[f"d{k}" for k in range(3)]).crossJoin(F.broadcast(packed))
    out = out.withColumn("_gaps", F.when(ok, F.transform("_cells", lambda s: F.struct(gap(s).alias("gap"), s["idx"].cast("long").alias("idx")))))
    out = out.withColumn("cell", F.array_min("_gaps")["idx"])
    return out.select(run, "arrival", "quality", "cell", F.transform(F.array_sort(close), lambda g: g["idx"]).alias("near"))


def taken(pdf: pd.DataFrame, override: float) -> dict[int, int]:
    """The arrival that takes each cell, folded in order of arrival over candidates (arrival, quality, cell, near)."""
    held: dict[int, float] = {}
    since: dict[int, int] = {}
    for arrival, quality, cell, near in pdf.sort_values("arrival")[["arrival", "quality", "cell", "near"]].itertuples(index=False):
        if cell in held:
            held[cell] = max(held[cell], quality)
            continue
        close = next((c for c in near if c in held), None)
        if close is None or quality > override * held[close]:
            held[cell], since[cell] = quality, arrival
    return since


def gated(rows: DataFrame, centroids: DataFrame, scales: tuple[float, float, float] = (1.0, 1.0, 1.0), *, run: str = "run_id", epsilon: float = EPSILON, override: float = OVERRIDE, before: dict[int, float] | None = None, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """(run, arrival, cell, status) with the similarity gate, as if folded in order of arrival per run.

    A candidate for an empty cell is too similar if its scaled descriptors lie
    within ``epsilon`` of an occupied centroid, unless its quality exceeds
    ``override`` times that of the nearest one's resident (of equal distances,
    the lower cell's). ``before`` has the qualities of cells that are occupied at
    the start; it is bounded by the number of cells. Arrivals of a run differ.

    Only the arrival that takes a cell depends on other cells; from then on the
    cell is a running maximum. A candidate with no cell within reach that may be
    occupied before it surely finds its cell taken or takes it, so only candidates
    before the first such one, and the cells within their reach, wait for each
    other. Groups of cells that are linked by these are folded, each in a task of
    its own, and the rest of the statuses are scans.
    """
    kind = rows.schema[run].dataType.simpleString()
    ship(rows.sparkSession)
    every = stage(placed(rows, centroids, scales, run, epsilon), "placed")
    candidates = with_given(every.where("cell is not null"), every, run, before)
    since = stage(occupied_since(candidates, run, kind, override), "taken")
    where = [run, "cell"]
    known = matched(candidates, since, where, how="left").select(run, "arrival", "quality", "cell", "since")
    held = segments(known, where, ["arrival"], segment_rows).scan({"held": ("max", F.when(F.col("arrival") >= F.col("since"), F.col("quality")))}, inclusive=False).done()
    status = F.when(F.col("arrival") == F.col("since"), INSERTED).when(F.col("held").isNull(), REJECTED_SIMILARITY).when(F.col("quality") > F.col("held"), REPLACED).otherwise(REJECTED_QUALITY)
    judged = held.where(F.col("arrival") > GIVEN).select(run, "arrival", "cell", status.alias("status"))
    return judged.unionByName(every.where("cell is null").select(run, "arrival", "cell", F.lit(REJECTED_FILTER).alias("status")))


def with_given(candidates: DataFrame, rows: DataFrame, run: str, before: dict[int, float] | None) -> DataFrame:
    """``candidates`` and, in each run of ``rows``, one for each cell of ``before`` ahead of all arrivals."""
    if not before:
        return candidates
    given = F.array(*[F.struct(F.lit(GIVEN - i).alias("arrival"), F.lit(float(q)).alias("quality"), F.lit(int(c)).cast("long").alias("cell"), F.array().cast("array<bigint>").alias("near")) for i, (c, q) in enumerate(before.items())])
    return candidates.unionByName(rows.select(run).distinct().select(run, F.explode(given).alias("g")).select(run, "g.*"))


def gated_batch(rows: DataFrame, centroids: DataFrame, scales: tuple[float, float, float] = (1.0, 1.0, 1.0), *, run: str = "run_id", epsilon: float = EPSILON, override: float = OVERRIDE, before: dict[int, float] | None = None) -> DataFrame:
    """gated() for one generation of a search: its rows are few, and each run is folded in one task."""
    kind = rows.schema[run].dataType.simpleString()
    ship(rows.sparkSession)
    every = placed(rows, centroids, scales, run, epsilon)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("arrival")
        since, held, status = taken(pdf[pdf["cell"].notna()], override), {}, []
        for arrival, quality, cell in pdf[["arrival", "quality", "cell"]].itertuples(index=False):
            if pd.isna(cell):
                status.append(REJECTED_FILTER)
            elif arrival < since.get(cell, np.inf):
                status.append(REJECTED_SIMILARITY)
            else:
                status.append(INSERTED if cell not in held else REPLACED if quality > held[cell] else REJECTED_QUALITY)
                held[cell] = max(quality, held.get(cell, quality))
        return pd.DataFrame({run: pdf[run], "arrival": pdf["arrival"], "cell": pdf["cell"].astype("Int64"), "status": status})

    whole = with_given(every, rows, run, before)
    return whole.groupBy(run).applyInPandas(fold, f"{run} {kind}, arrival long, cell long, status string").where(F.col("arrival") > GIVEN)


def occupied_since(candidates: DataFrame, run: str, kind: str, override: float) -> DataFrame:
    """(run, cell, since): the arrival that takes each cell that is ever taken."""
    where = [run, "cell"]
    sure = F.min(F.when(F.size("near") == 0, F.col("arrival")))
    ends = stage(candidates.groupBy(*where).agg(F.min("arrival").alias("first"), sure.alias("sure"), F.max("quality").alias("most")), "cells")
    early = matched(candidates, ends.select(*where, "sure"), where, F.expr("size(near) > 0 and (sure is null or arrival < sure)"))
    others = ends.select(run, F.col("cell").alias("other"), F.col("first").alias("other_first"), F.col("most").alias("other_most"))
    links = matched(early.select(*where, "arrival", "quality", F.explode("near").alias("other")), others, [run, "other"], F.expr("other_first < arrival"), "left")
    # one that no occupied cell can reach, or whose quality no neighbour can outweigh, is sure as well
    weighed = links.groupBy(*where, "arrival", "quality").agg(F.max("other_most").alias("most"), F.collect_set(F.when(F.col("other_first").isNotNull(), F.col("other"))).alias("waits"))
    weighed = stage(weighed.withColumn("free", F.col("most").isNull() | (F.col("quality") > override * F.col("most"))), "waiting")
    freed = weighed.where("free").groupBy(*where).agg(F.min("arrival").alias("freed"))
    ends = stage(matched(ends, freed, where, how="left").select(*where, "first", F.least("sure", "freed").alias("sure")), "cells")
    waiting = matched(weighed.where("not free"), ends, where, F.expr("sure is null or arrival < sure")).select(*where, "arrival", F.explode("waits").alias("other"))
    edges = stage(waiting.groupBy(*where, "other").agg(F.max("arrival").alias("needed")), "edges")
    groups = labels(edges.select(run, "cell", "other"), run)
    needed = edges.groupBy(run, F.col("other").alias("cell")).agg(F.max("needed").alias("needed"))
    limits = matched(matched(groups, ends, where), needed, where, how="left")
    upto = matched(candidates, limits, where, F.expr("sure is null or arrival <= greatest(sure, needed)")).select(run, "label", "arrival", "quality", "cell", "near")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        found = taken(pdf, override)
        return pd.DataFrame({run: pd.Series([pdf[run].iloc[0]] * len(found), dtype=pdf[run].dtype), "cell": pd.Series(list(found), dtype="int64"), "since": pd.Series(list(found.values()), dtype="int64")})

    folded = upto.groupBy(run, "label").applyInPandas(fold, f"{run} {kind}, cell long, since long")
    alone = matched(ends, groups, where, how="left").where("label is null").select(*where, F.col("first").alias("since"))
    return alone.unionByName(folded)


def labels(edges: DataFrame, run: str) -> DataFrame:
    """(run, cell, label): the least cell of each connected group of a run's cells, for cells with edges (cell, other)."""
    return components(edges, "cell", "other", run)


def union(*archives: DataFrame, run: str = "run_id", segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """The rows of several archives with an id across all of them, in the order of run and cell."""
    whole = archives[0]
    for more in archives[1:]:
        whole = whole.unionByName(more, allowMissingColumns=True)
    return numbered(whole, [], [run, "cell"], segment_rows).done().withColumnRenamed("i", "id")


def located(spark, path: str) -> str:
    """The archive table that ``path`` means: itself, the one in it, or that of its only run; else an error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(conf)
    there = lambda p: fs.exists(jvm.org.apache.hadoop.fs.Path(p))
    if path.rstrip("/").endswith("/archive") and there(path):
        return path.rstrip("/")
    if there(f"{path}/archive"):
        return f"{path.rstrip('/')}/archive"
    runs = [f.getPath().toString() for f in fs.listStatus(at) if there(f"{f.getPath().toString()}/archive")] if fs.exists(at) else []
    if len(runs) != 1:
        raise FileNotFoundError(f"{path} has {len(runs)} archives, not one" if fs.exists(at) else f"{path} does not exist")
    return f"{runs[0]}/archive"


def fill(best: DataFrame, capacity: int, *keys: str) -> DataFrame:
    return best.groupBy(*keys).agg(F.countDistinct("cell").alias("occupied")).withColumn("fill", F.col("occupied") / F.lit(float(capacity)))


def with_creature_id(rows: DataFrame, run: str = "run_id", seed: str = "seed") -> DataFrame:
    return rows.withColumn("creature_id", creature_id(F.col(run), F.col(seed)))


def random_parents(children: DataFrame, best: DataFrame, seed: int, *, key: str = "child") -> DataFrame:
    """Each child with a uniformly drawn occupied cell as its parent, by unit() of seed and child.

    Occupied cells are bounded by the capacity; children are not shuffled.
    """
    numbered = best.withColumn("_n", (F.row_number().over(Window.orderBy("cell")) - 1).cast("long"))
    total = numbered.agg(F.count("*").alias("_total"))
    draw = F.least(F.floor(unit(F.lit(seed), F.col(key)) * F.col("_total")), F.col("_total") - 1).cast("long")
    drawn = children.crossJoin(F.broadcast(total)).withColumn("_n", draw)
    return drawn.join(F.broadcast(numbered.select("_n", F.col("cell").alias("parent_cell"), F.col("arrival").alias("parent"))), "_n", "left").drop("_n", "_total")


def lineage(rows: DataFrame, child: str, parent: str) -> DataFrame:
    """(node, root, depth) by pointer jumping: the known part of a path doubles every round.

    A parent that is no row itself is a root. Cycles are not allowed.
    """
    now = stage(rows.select(F.col(child).alias("node"), F.coalesce(F.col(parent), F.col(child)).alias("root"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("depth")), "lineage")
    while True:
        far = now.where("depth > 0").select(F.col("node").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"))
        joined = now.join(far, "root", "left")
        if joined.where("up is not null").isEmpty():
            return now
        now = stage(joined.select("node", F.coalesce("up", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), "lineage")
