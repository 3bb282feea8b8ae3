"""The driver's tables read as rollouts, traces, creatures, fields and ownership.

Each view has a DataFrame and the same thing as a DuckDB common table
expression; only exact arithmetic is used, so both give the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIZE = 16
CELLS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("long")
    c = F.col
    rows = e.withColumn("k", k)
    return rows.select(
        (c("user_id") % 10).alias("run_id"), c("event_id").alias("arrival"), c("event_id").alias("seed"), c("ts").alias("created_at"), "user_id", "event_type", "k", "value",
        c("value").alias("d0"), F.hour("ts").cast("double").alias("d1"), (c("k") / F.lit(10.0)).alias("d2"),
        F.when(c("event_type") != "error", c("value") / (c("value") + 50.0)).alias("quality"),
        F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("parent"),
    )


ROLL = r"""roll AS (
  SELECT user_id % 10 AS run_id, event_id AS arrival, event_id AS seed, ts AS created_at, user_id, event_type, k, value, value AS d0, CAST(hour(ts) AS DOUBLE) AS d1, k / 10.0 AS d2,
    CASE WHEN event_type <> 'error' THEN value / (value + 50.0) END AS quality, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS parent
  FROM (SELECT *, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS k FROM events)
)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollouts with what the quality filters need."""
    c = F.col
    return rollouts(spark, sf_dir).withColumns({"initial_mass": F.lit(100.0), "final_mass": c("value"), "final_signal": c("k") / 10.0, "bbox_mean": F.pmod("k", F.lit(10)) / 10.0, "n_steps": F.when(c("event_type") == "click", 60).otherwise(200), "drift": (c("arrival") % 7) / 20.0, "compactness": c("k") / 100.0, "has_signal": c("arrival") % 3 == 0})


JUDGED = ROLL + r""", judged AS (
  SELECT *, 100.0::DOUBLE AS initial_mass, value AS final_mass, k / 10.0 AS final_signal, (k % 10) / 10.0 AS bbox_mean, CASE WHEN event_type = 'click' THEN 60 ELSE 200 END AS n_steps, (arrival % 7) / 20.0 AS drift, k / 100.0 AS compactness, arrival % 3 = 0 AS has_signal FROM roll
)"""


def centroids(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(CELLS).select(i.alias("idx"), ((i % 4) * 15.0).alias("c0"), (F.floor(i / 4) * 6.0).alias("c1"), ((i * 7) % 10 * 1.0).alias("c2"))


CENTRES = f"centre AS (SELECT i AS idx, (i % 4) * 15.0::DOUBLE AS c0, (i // 4) * 6.0::DOUBLE AS c1, (i * 7) % 10 * 1.0::DOUBLE AS c2 FROM range({CELLS}) t(i))"
CELLED = (
    ROLL
    + ", "
    + CENTRES
    + """, celled AS (
  SELECT * EXCLUDE (rn, gap) FROM (
    SELECT roll.*, idx AS cell, (d0 - c0) * (d0 - c0) + (d1 - c1) * (d1 - c1) + (d2 - c2) * (d2 - c2) AS gap, row_number() OVER (PARTITION BY arrival ORDER BY (d0 - c0) * (d0 - c0) + (d1 - c1) * (d1 - c1) + (d2 - c2) * (d2 - c2), idx) AS rn
    FROM roll, centre) WHERE rn = 1
)"""
)
STATUS = (
    CELLED
    + """, status AS (
  SELECT *, CASE WHEN quality IS NULL THEN 'rejected_filter' WHEN held IS NULL THEN 'inserted' WHEN quality > held THEN 'replaced' ELSE 'rejected_quality' END AS status
  FROM (SELECT *, max(quality) OVER (PARTITION BY run_id, cell ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM celled)
)"""
)


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("double")
    by = Window.partitionBy("creature").orderBy("ts", "event_id")
    rows = e.withColumn("creature", F.col("user_id") % 10).withColumn("step", F.row_number().over(by).cast("long"))
    return rows.select("creature", "step", F.col("value").alias("com_y"), k.alias("com_x"), F.least(F.col("value") / 500.0, F.lit(1.0)).alias("bbox"), F.sqrt("value").alias("gyradius"))


TRACE = r"""trace AS (
  SELECT user_id % 10 AS creature, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS step, value AS com_y, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS com_x, least(value / 500.0, 1.0) AS bbox, sqrt(value) AS gyradius FROM events
), framed AS (
  SELECT *, count(*) OVER (PARTITION BY creature) AS n, row_number() OVER (PARTITION BY creature ORDER BY step DESC) AS rn,
    com_y - lag(com_y) OVER w AS dy, com_x - lag(com_x) OVER w AS dx, gyradius - lag(gyradius) OVER w AS dg FROM trace WINDOW w AS (PARTITION BY creature ORDER BY step)
), speeds AS (SELECT *, sqrt(dy * dy + dx * dx) AS speed, atan2(dy, dx) AS angle FROM framed),
turns AS (SELECT *, lag(speed) OVER w AS before, angle - lag(angle) OVER w AS turn FROM speeds WINDOW w AS (PARTITION BY creature ORDER BY step))"""


def creatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    part = lambda a, n: F.transform(F.slice("embedding", a, n), lambda x: x.cast("double"))
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("run"), F.transform(part(1, 16), F.abs).alias("emission"), part(17, 16).alias("receptor"), part(33, 3).alias("d"), F.least(F.greatest((F.element_at("embedding", 36).cast("double") + 1.0) / 2.0, F.lit(0.0)), F.lit(1.0)).alias("quality"))


CREATURE = """creature AS (
  SELECT vec_id AS id, CAST(label AS BIGINT) AS run, list_transform(embedding[1:16], lambda x: abs(x::DOUBLE)) AS emission, list_transform(embedding[17:32], lambda x: x::DOUBLE) AS receptor, list_transform(embedding[33:35], lambda x: x::DOUBLE) AS d, least(greatest((embedding[36]::DOUBLE + 1.0) / 2.0, 0.0), 1.0) AS quality FROM embeddings
)"""


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(F.col("l_linenumber").cast("long").alias("entity"), (F.col("l_suppkey") % SIZE).cast("int").alias("y"), (F.col("l_partkey") % SIZE).cast("int").alias("x")).agg(F.sum("l_quantity").alias("value"))


FIELD = f"field AS (SELECT CAST(l_linenumber AS BIGINT) AS entity, l_suppkey % {SIZE} AS y, l_partkey % {SIZE} AS x, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"


def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cell = li.groupBy((F.year("l_shipdate") - 1995).cast("int").alias("snap"), (F.col("l_suppkey") % SIZE).cast("int").alias("y"), (F.col("l_partkey") % SIZE).cast("int").alias("x"), F.col("l_returnflag").alias("species")).agg(F.sum("l_quantity").alias("q"), (F.sum(F.round(F.col("l_discount") * 100) - F.round(F.col("l_tax") * 100)) / F.count("*")).alias("g"))
    whole = Window.partitionBy("snap", "y", "x")
    return cell.withColumn("m", F.sum("q").over(whole)).withColumn("w", F.col("q") / F.col("m")).drop("q")


OWN = f"""own AS (
  SELECT snap, y, x, species, q / sum(q) OVER (PARTITION BY snap, y, x) AS w, sum(q) OVER (PARTITION BY snap, y, x) AS m, g FROM (
    SELECT CAST(year(l_shipdate) - 1995 AS INT) AS snap, CAST(l_suppkey % {SIZE} AS INT) AS y, CAST(l_partkey % {SIZE} AS INT) AS x, l_returnflag AS species, sum(l_quantity) AS q, sum(round(l_discount * 100) - round(l_tax * 100)) / count(*) AS g FROM lineitem GROUP BY ALL)
)"""


def mass_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    month = (F.year("o_orderdate") - 1990) * 12 + F.month("o_orderdate")
    return o.groupBy(F.col("o_orderstatus").alias("species"), month.cast("long").alias("step")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("mass")).withColumn("mass", F.col("mass").cast("double"))


HISTORY = "hist AS (SELECT o_orderstatus AS species, CAST((year(o_orderdate) - 1990) * 12 + month(o_orderdate) AS BIGINT) AS step, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) AS mass FROM orders GROUP BY ALL)"
