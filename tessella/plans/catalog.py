"""Registry of the engine's queries: name -> builder, and name -> DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.functions import params, text, vectors
from tessella.operators import archive, calibration, cards, fields, metrics, ownership, pairs, percentiles, quality, ranges, series, simulation, spawn, views
from tessella.plans import adapters as V
from tessella.sources import tables
from tessella.sources.tables import stage
from tessella.streaming import events as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "archive_best"


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a number of places: sums may differ in the last bits with their order."""
    return df.select(*[(F.round(F.col(f.name), places) + F.lit(0.0)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema])


def query(sql: str | None = None):
    """Register a builder under its name, with its DuckDB equivalent when there is one."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def celled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration.nearest(V.rollouts(spark, sf_dir), V.centroids(spark))


def with_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.insertion_status(celled(spark, sf_dir), "run_id")


# --- filter and rank, calibration, archive ----------------------------------------------------

REASON = """CASE WHEN NOT (final_mass + final_signal BETWEEN 50.0 AND 200.0 AND final_mass >= 5.0) THEN 'dead' WHEN bbox_mean >= 0.6 THEN 'exploded' WHEN final_mass <= 0 THEN 'no_descriptors' WHEN n_steps < 100 OR drift > 0.2 THEN 'unstable' END"""
RATED = (
    V.JUDGED
    + f""", rated AS (SELECT *, {REASON} AS reason FROM judged), scored AS (
  SELECT arrival, run_id, reason, CASE WHEN reason IS NULL OR reason = 'unstable' THEN d0 END AS d0, CASE WHEN reason IS NULL THEN
    CASE WHEN has_signal THEN 0.5 * least(greatest(compactness, 0.0), 1.0) + 0.3 * least(greatest(1.0 - drift / 0.2, 0.0), 1.0) + 0.2 * least(greatest(final_mass / 100.0, 0.0), 1.0)
    ELSE 0.6 * least(greatest(compactness, 0.0), 1.0) + 0.4 * least(greatest(1.0 - drift / 0.2, 0.0), 1.0) END END AS quality FROM rated)"""
)


@query(f"WITH {RATED} SELECT arrival, reason, round(d0, 6) AS d0, round(quality, 6) AS quality FROM scored")
def quality_pipeline(spark, sf_dir):
    return quality.evaluate(V.judged(spark, sf_dir).drop("quality")).select("arrival", "reason", "d0", "quality")


@query(f"WITH {RATED} SELECT run_id, coalesce(reason, 'accepted') AS reason, count(*) AS n FROM scored GROUP BY ALL")
def reject_breakdown(spark, sf_dir):
    rows = quality.evaluate(V.judged(spark, sf_dir).drop("quality"))
    return rows.groupBy("run_id", F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


SCALE = V.ROLL + """, long AS (SELECT 0 AS axis, d0 AS v FROM roll UNION ALL SELECT 1, d1 FROM roll UNION ALL SELECT 2, d2 FROM roll), scale AS (
  SELECT axis, quantile_cont(v, 0.05) AS p5, quantile_cont(v, 0.95) AS p95 FROM long GROUP BY axis)"""


@query(f"WITH {SCALE} SELECT axis, round(p5, 6) AS p5, round(p95, 6) AS p95, round(CASE WHEN p95 > p5 THEN 1 / (p95 - p5) ELSE 1.0 END, 6) AS scale FROM scale")
def axis_scale(spark, sf_dir):
    return calibration.axis_scale(V.rollouts(spark, sf_dir))


@query(f"WITH {V.CELLED} SELECT arrival, cell FROM celled")
def nearest_cell(spark, sf_dir):
    return celled(spark, sf_dir).select("arrival", "cell")


@query(f"WITH {V.CELLED} SELECT run_id, cell, arrival, round(quality, 6) AS quality, run_id || '-' || arrival AS creature_id FROM (SELECT *, row_number() OVER (PARTITION BY run_id, cell ORDER BY quality DESC, arrival) AS rn FROM celled WHERE quality IS NOT NULL) WHERE rn = 1")
def archive_best(spark, sf_dir):
    best = archive.best_per_cell(celled(spark, sf_dir), "run_id")
    return archive.with_creature_id(best).select("run_id", "cell", "arrival", "quality", "creature_id")


@query(f"WITH {V.STATUS} SELECT run_id, arrival, cell, status FROM status")
def insertion_status(spark, sf_dir):
    return with_status(spark, sf_dir).select("run_id", "arrival", "cell", "status")


GATED = f"""gap AS (SELECT run_id, arrival, quality, list(g ORDER BY idx) AS g FROM (SELECT roll.run_id, roll.arrival, roll.quality, idx, (d0 - c0) * (d0 - c0) + (d1 - c1) * (d1 - c1) + (d2 - c2) * (d2 - c2) AS g FROM roll, centre) GROUP BY ALL),
  seq AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY arrival) AS n, CASE WHEN quality IS NOT NULL THEN list_position(g, list_min(g)) END AS c FROM gap),
  fold AS (
    SELECT run_id, CAST(0 AS BIGINT) AS n, list_transform(range({V.CELLS}), lambda i: CAST(NULL AS DOUBLE)) AS held, CAST(NULL AS BIGINT) AS arrival, CAST(NULL AS BIGINT) AS cell, '' AS status FROM (SELECT DISTINCT run_id FROM roll)
    UNION ALL
    SELECT run_id, n, CASE WHEN status IN ('inserted', 'replaced') THEN list_transform(held, lambda h, i: CASE WHEN i = c THEN quality ELSE h END) ELSE held END, arrival, c - 1, status FROM (
      SELECT *, CASE WHEN c IS NULL THEN 'rejected_filter' WHEN held[c] IS NOT NULL THEN CASE WHEN quality > held[c] THEN 'replaced' ELSE 'rejected_quality' END
        WHEN near IS NOT NULL AND g[near] < 64.0 AND NOT quality > 1.2 * held[near] THEN 'rejected_similarity' ELSE 'inserted' END AS status FROM (
        SELECT *, list_position(list_transform(g, lambda v, i: CASE WHEN held[i] IS NOT NULL THEN v END), list_min(list_transform(g, lambda v, i: CASE WHEN held[i] IS NOT NULL THEN v END))) AS near
        FROM (SELECT s.run_id, s.n, s.arrival, s.quality, s.g, s.c, f.held FROM fold f JOIN seq s ON s.run_id = f.run_id AND s.n = f.n + 1)))
  )"""


@query(f"WITH RECURSIVE {V.ROLL}, {V.CENTRES}, {GATED} SELECT run_id, arrival, cell, status FROM fold WHERE n > 0")
def archive_gated(spark, sf_dir):
    return archive.gated(V.rollouts(spark, sf_dir), V.centroids(spark), epsilon=8.0)


@query(f"WITH {V.CELLED} SELECT run_id, count(DISTINCT cell) AS occupied, round(count(DISTINCT cell) / {V.CELLS}.0, 6) AS fill FROM celled WHERE quality IS NOT NULL GROUP BY run_id")
def archive_fill(spark, sf_dir):
    return archive.fill(archive.best_per_cell(celled(spark, sf_dir), "run_id"), V.CELLS, "run_id")


@query(f"WITH {V.CELLED} SELECT run_id, cell, count(*) AS n, round(avg(quality), 6) AS mean_quality FROM celled GROUP BY ALL")
def cell_population(spark, sf_dir):
    return celled(spark, sf_dir).groupBy("run_id", "cell").agg(F.count("*").alias("n"), F.avg("quality").alias("mean_quality"))


def sql_unit(*parts: str) -> str:
    """text.unit() in DuckDB."""
    return f"(('0x' || substr(md5({" || ':' || ".join(parts)}), 1, 12))::BIGINT / 281474976710656.0)"


@query(f"WITH {V.CELLED}, best AS (SELECT cell, arrival, row_number() OVER (ORDER BY cell) - 1 AS n FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY quality DESC, arrival) AS rn FROM celled WHERE quality IS NOT NULL) WHERE rn = 1) SELECT c.child, best.cell AS parent_cell, best.arrival AS parent FROM (SELECT range AS child FROM range(1000)) c JOIN best ON best.n = CAST(floor({sql_unit("'7'", "c.child")} * (SELECT count(*) FROM best)) AS BIGINT)")
def random_parent(spark, sf_dir):
    best = archive.best_per_cell(celled(spark, sf_dir))
    return archive.random_parents(spark.range(1000).withColumnRenamed("id", "child"), best, 7)


@query(f"WITH RECURSIVE {V.ROLL}, up AS (SELECT arrival AS node, arrival AS root, 0 AS depth FROM roll WHERE parent IS NULL UNION ALL SELECT roll.arrival, up.root, up.depth + 1 FROM roll JOIN up ON roll.parent = up.node) SELECT node, root, CAST(depth AS BIGINT) AS depth FROM up")
def lineage_depth(spark, sf_dir):
    return archive.lineage(V.rollouts(spark, sf_dir), "arrival", "parent")


@query(f"WITH {V.ROLL} SELECT a.arrival AS child, b.arrival AS parent, round(a.quality - b.quality, 6) AS gain FROM roll a JOIN roll b ON a.parent = b.arrival")
def lineage_gain(spark, sf_dir):
    rows = V.rollouts(spark, sf_dir)
    up = rows.select(F.col("arrival").alias("parent"), F.col("quality").alias("before"))
    return rows.join(up, "parent").select(F.col("arrival").alias("child"), "parent", (F.col("quality") - F.col("before")).alias("gain"))


@query(f"""WITH RECURSIVE {V.ROLL}, {V.CENTRES}, pts AS (SELECT arrival, d0, d1, d2 FROM roll WHERE quality IS NOT NULL), r AS (
  SELECT 0 AS round, idx, c0, c1, c2 FROM centre), a1 AS (SELECT arg_min(idx, struct_pack(g := (d0 - c0) * (d0 - c0) + (d1 - c1) * (d1 - c1) + (d2 - c2) * (d2 - c2), i := idx)) AS cell, any_value(d0) AS d0, any_value(d1) AS d1, any_value(d2) AS d2 FROM pts, r GROUP BY arrival),
  r1 AS (SELECT idx, coalesce(avg(a1.d0), any_value(c0)) AS c0, coalesce(avg(a1.d1), any_value(c1)) AS c1, coalesce(avg(a1.d2), any_value(c2)) AS c2 FROM r LEFT JOIN a1 ON a1.cell = idx GROUP BY idx),
  a2 AS (SELECT arg_min(idx, struct_pack(g := (d0 - c0) * (d0 - c0) + (d1 - c1) * (d1 - c1) + (d2 - c2) * (d2 - c2), i := idx)) AS cell, any_value(d0) AS d0, any_value(d1) AS d1, any_value(d2) AS d2 FROM pts, r1 GROUP BY arrival)
  SELECT idx, round(coalesce(avg(a2.d0), any_value(c0)), 6) AS c0, round(coalesce(avg(a2.d1), any_value(c1)), 6) AS c1, round(coalesce(avg(a2.d2), any_value(c2)), 6) AS c2 FROM r1 LEFT JOIN a2 ON a2.cell = idx GROUP BY idx""")
def kmeans_lloyd(spark, sf_dir):
    return calibration.kmeans(calibration.survivors(V.rollouts(spark, sf_dir)), V.centroids(spark), 2)


BOX = ", ".join(f"round(lo{k} + {sql_unit("'3'", f"'{k}'", 'i')} * (hi{k} - lo{k}), 6) AS c{k}" for k in range(3))


@query(f"WITH {V.ROLL}, box AS (SELECT min(d0) AS lo0, max(d0) AS hi0, min(d1) AS lo1, max(d1) AS hi1, min(d2) AS lo2, max(d2) AS hi2 FROM roll) SELECT i AS idx, {BOX} FROM range(64) t(i), box")
def uniform_fallback(spark, sf_dir):
    return calibration.uniform_centroids(V.rollouts(spark, sf_dir), 64, 3)


# --- metrics ------------------------------------------------------------------------------------


@query(f"""WITH {V.STATUS} SELECT run_id, count(*) AS n, count_if(status = 'inserted') AS inserted, count_if(status = 'replaced') AS replaced, count_if(status = 'rejected_filter') AS rejected_filter, count_if(status = 'rejected_quality') AS rejected_quality, count_if(status = 'rejected_similarity') AS rejected_similarity,
  round(count_if(status IN ('inserted', 'replaced')) / count(*), 6) AS insertion_share, round((epoch_us(max(created_at)) - epoch_us(min(created_at))) / 1e6, 6) AS wall_seconds FROM status GROUP BY run_id""")
def status_totals(spark, sf_dir):
    return metrics.status_totals(with_status(spark, sf_dir), "run_id")


FRAMES = V.STATUS + """, framed AS (SELECT *, row_number() OVER o - 1 AS i, count_if(status IN ('inserted', 'replaced')) OVER f AS hits, count(*) OVER f AS nrows, epoch_us(last_value(created_at) OVER f) - epoch_us(first_value(created_at) OVER f) AS span
  FROM status WINDOW o AS (PARTITION BY run_id ORDER BY arrival), f AS (PARTITION BY run_id ORDER BY arrival ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING))"""


@query(f"WITH {FRAMES} SELECT run_id, i, round(CASE WHEN nrows >= 2 AND span > 0 THEN hits * 60e6 / span ELSE 0.0 END, 6) AS rate FROM framed WHERE i % 12 = 0")
def rolling_rate(spark, sf_dir):
    return metrics.rolling_rate(with_status(spark, sf_dir), "run_id")


SHARES = ", ".join(f"round(avg(CASE WHEN status = '{s}' THEN 1.0 ELSE 0.0 END) OVER f, 6) AS {s}" for s in archive.STATUSES)


@query(f"WITH {V.STATUS} SELECT * FROM (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY arrival) - 1 AS i, {SHARES} FROM status WINDOW f AS (PARTITION BY run_id ORDER BY arrival ROWS BETWEEN 25 PRECEDING AND 24 FOLLOWING)) WHERE i % 12 = 0")
def rolling_share(spark, sf_dir):
    return metrics.rolling_share(with_status(spark, sf_dir), "run_id")


LAST = ", ".join(f"count_if(status = '{s}') OVER f AS {s}" for s in archive.STATUSES)


@query(f"WITH {V.STATUS} SELECT run_id, arrival, {LAST} FROM status WINDOW f AS (PARTITION BY run_id ORDER BY arrival ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def last10_summary(spark, sf_dir):
    return metrics.last_summary(with_status(spark, sf_dir), "run_id")


@query(f"WITH {V.STATUS}, n AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY arrival) AS i FROM status) SELECT run_id, arrival, round(max(quality) OVER w, 6) AS best, i - max(CASE WHEN status IN ('inserted', 'replaced') THEN i END) OVER w AS gap FROM n WINDOW w AS (PARTITION BY run_id ORDER BY arrival)")
def best_so_far(spark, sf_dir):
    return metrics.best_so_far(with_status(spark, sf_dir), "run_id")


@query(f"WITH {V.ROLL}, h AS (SELECT run_id, CAST(least(floor(quality * 20), 19) AS INT) AS bin, count(*) AS n, avg(quality) AS mean FROM roll WHERE quality IS NOT NULL GROUP BY ALL) SELECT g.run_id, CAST(b AS INT) AS bin, coalesce(n, 0) AS n, round(mean, 6) AS mean FROM (SELECT DISTINCT run_id FROM roll) g CROSS JOIN range(20) t(b) LEFT JOIN h ON h.run_id = g.run_id AND h.bin = b")
def quality_histogram(spark, sf_dir):
    return metrics.quality_histogram(V.rollouts(spark, sf_dir), "run_id")


@query(f"WITH {SCALE} SELECT axis, CAST(CASE WHEN p95 > p5 THEN least(greatest(floor((v - p5) / (p95 - p5) * 28), 0), 27) ELSE 0 END AS INT) AS bucket, count(*) AS n FROM long JOIN scale USING (axis) GROUP BY ALL")
def descriptor_coverage(spark, sf_dir):
    rows = V.rollouts(spark, sf_dir)
    return metrics.coverage(rows, calibration.axis_scale(rows))


@query(f"WITH {V.ROLL}, c AS (SELECT run_id, corr(d0, d1) AS r01, corr(d0, d2) AS r02, corr(d1, d2) AS r12 FROM roll GROUP BY run_id) SELECT run_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(CASE WHEN i = j THEN 1.0 WHEN least(i, j) = 0 AND greatest(i, j) = 1 THEN r01 WHEN least(i, j) = 0 THEN r02 ELSE r12 END, 6) AS r FROM c, range(3) a(i), range(3) b(j)")
def descriptor_corr(spark, sf_dir):
    return metrics.correlations(V.rollouts(spark, sf_dir), "run_id")


@query("SELECT user_id % 10 AS hostname, user_id % 4 AS gpu_index, round(avg(value), 6) AS utilization FROM events GROUP BY ALL")
def gpu_utilisation(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    return metrics.utilisation(e.select((F.col("user_id") % 10).alias("hostname"), (F.col("user_id") % 4).alias("gpu_index"), F.col("value").alias("utilization")))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ROLLUP (event_type)")
def status_rollup(spark, sf_dir):
    return V.table(spark, sf_dir, "events").rollup("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


# --- pairs --------------------------------------------------------------------------------------

DOT = "list_sum(list_transform(range(1, 17), lambda i: a.emission[i] * b.receptor[i]))"
TOD = "list_sum(list_transform(range(1, 17), lambda i: b.emission[i] * a.receptor[i]))"
PAIRS = V.CREATURE + f""", pairs AS (SELECT *, CASE WHEN ab < -0.1 AND ba < -0.1 THEN 'repulsion' WHEN ab > 0.1 AND ba > 0.1 THEN 'competition' WHEN (ab > 0.1 AND ba < -0.1) OR (ab < -0.1 AND ba > 0.1) THEN 'pursuit' ELSE 'blind' END AS mode, abs(ab) + abs(ba) + 0.3 * distance + 0.5 * avg_quality AS score FROM (
  SELECT a.id AS id_a, b.id AS id_b, a.run AS run_a, b.run AS run_b, {DOT} AS ab, {TOD} AS ba, sqrt(list_sum(list_transform(range(1, 4), lambda i: (a.d[i] - b.d[i]) * (a.d[i] - b.d[i])))) AS distance, (a.quality + b.quality) / 2 AS avg_quality FROM creature a JOIN creature b ON a.id < b.id))"""


@query(f"WITH {PAIRS} SELECT mode, count(*) AS n FROM pairs GROUP BY mode")
def pair_modes(spark, sf_dir):
    return pairs.mode_counts(V.creatures(spark, sf_dir))


@query(f"WITH {PAIRS} SELECT mode, rank, id_a, id_b, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY score DESC, id_a, id_b) AS rank FROM pairs) WHERE rank <= 5")
def pair_topk(spark, sf_dir):
    return pairs.best_pairs(V.creatures(spark, sf_dir), 5).select("mode", "rank", "id_a", "id_b", "score")


@query(f"WITH {PAIRS} SELECT least(run_a, run_b) AS run_lo, greatest(run_a, run_b) AS run_hi, count(*) AS n, round(max(score), 6) AS best FROM pairs WHERE run_a <> run_b GROUP BY ALL")
def cross_run_pairs(spark, sf_dir):
    return pairs.cross_pairs(V.creatures(spark, sf_dir), "run").select(F.col("lo").alias("run_lo"), F.col("hi").alias("run_hi"), "n", "best")


BLOCK = "  - name: %s-%d-%d\n    sources:\n      - {creature_id: %d, n: 1}\n      - {creature_id: %d, n: 1}\n"
GOOD = PAIRS.replace("a.id < b.id", "a.id < b.id AND a.quality >= 0.5 AND b.quality >= 0.5")


@query(f"WITH {GOOD} SELECT mode, rank, printf('{BLOCK}', mode, id_a, id_b, id_a, id_b) AS yaml FROM (SELECT *, row_number() OVER (PARTITION BY mode ORDER BY score DESC, id_a, id_b) AS rank FROM pairs) WHERE rank <= 3")
def pair_experiments(spark, sf_dir):
    return pairs.experiment_yaml(pairs.best_pairs(V.creatures(spark, sf_dir), 3, min_quality=0.5))


SPECIES = V.CREATURE + """, species AS (SELECT run AS species, list_transform(range(1, 17), lambda i: list_avg(list_transform(e, lambda v: v[i]))) AS emission, list_transform(range(1, 17), lambda i: list_avg(list_transform(r, lambda v: v[i]))) AS receptor FROM (SELECT run, list(emission ORDER BY id) AS e, list(receptor ORDER BY id) AS r FROM creature GROUP BY run))"""


def species_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = V.creatures(spark, sf_dir)
    mean = lambda name: F.array(*[F.avg(F.get(name, F.lit(i))) for i in range(16)]).alias(name)
    return c.groupBy(F.col("run").alias("species")).agg(mean("emission"), mean("receptor"))


@query(f"WITH {SPECIES} SELECT a.species AS a, b.species AS b, round({DOT}, 6) AS product FROM species a, species b")
def emission_matrix(spark, sf_dir):
    return pairs.emission_matrix(species_means(spark, sf_dir))


@query(f"WITH {V.CREATURE} SELECT id, CAST(list_position(emission, list_max(emission)) - 1 AS INT) AS dominant_channel, round(list_max(emission) / list_sum(emission), 6) AS dominant_fraction FROM creature")
def dominant_channel(spark, sf_dir):
    return pairs.dominant(V.creatures(spark, sf_dir), "emission").select("id", "dominant_channel", "dominant_fraction")


@query(f"WITH {SPECIES} SELECT a.id, round(list_sum(list_transform(range(1, 17), lambda i: a.receptor[i] * s.emission[i])), 6) AS alignment FROM creature a JOIN species s ON a.run = s.species")
def receptor_alignment(spark, sf_dir):
    c, s = V.creatures(spark, sf_dir), species_means(spark, sf_dir).select(F.col("species").alias("run"), F.col("emission").alias("heard"))
    return c.join(s, "run").select("id", vectors.dot(F.col("receptor"), F.col("heard")).alias("alignment"))


@query(f"WITH {V.CREATURE} SELECT id, list_min(receptor) >= -0.3 AND list_max(receptor) <= 0.3 AS in_range FROM creature")
def in_range_params(spark, sf_dir):
    return V.creatures(spark, sf_dir).select("id", vectors.within(F.col("receptor"), -0.3, 0.3).alias("in_range"))


@query(f"WITH {V.CREATURE} SELECT run, round(quantile_cont(quality, 0.999), 6) AS p999, count(*) AS n FROM creature WHERE quality >= 0.45 GROUP BY run")
def intensity_percentile(spark, sf_dir):
    rows = V.creatures(spark, sf_dir).where("quality >= 0.45")
    high = percentiles.percentiles(rows, ["quality"], [0.999], "run")
    return rows.groupBy("run").agg(F.count("*").alias("n")).join(high.select("run", F.col("value").alias("p999")), "run")


# --- series descriptors ---------------------------------------------------------------------------


def described(*columns: str):
    def build(spark, sf_dir):
        return series.descriptors(V.traces(spark, sf_dir)).select("creature", *columns)

    return build


CLIPPED = "round(coalesce(least(greatest({}, 0.0), 100.0), 0.0), 6)"
SERIES = {
    "velocity": "avg(CASE WHEN rn < 50 THEN speed END)",
    "oscillation": "var_pop(CASE WHEN rn <= 50 THEN bbox END)",
    "mass_asymmetry": "abs(avg(CASE WHEN rn < 50 THEN abs(dx) END) - avg(CASE WHEN rn < 50 THEN abs(dy) END)) / nullif(avg(CASE WHEN rn < 50 THEN abs(dx) END) + avg(CASE WHEN rn < 50 THEN abs(dy) END), 0)",
    "displacement_ratio": "sqrt(pow(max(CASE WHEN rn = 1 THEN com_y END) - max(CASE WHEN rn = least(n, 50) THEN com_y END), 2) + pow(max(CASE WHEN rn = 1 THEN com_x END) - max(CASE WHEN rn = least(n, 50) THEN com_x END), 2)) / nullif(sum(CASE WHEN rn < 50 THEN speed END), 0)",
    "angular_velocity": "CASE WHEN count_if(rn < 49 AND speed > 1e-4 AND before > 1e-4) >= 2 THEN avg(CASE WHEN rn < 49 AND speed > 1e-4 AND before > 1e-4 THEN abs(turn + pi() - floor((turn + pi()) / (2 * pi())) * (2 * pi()) - pi()) END) END",
    "morphological_instability": "var_pop(CASE WHEN rn <= 50 THEN gyradius END)",
    "activity": "avg(CASE WHEN rn < 50 THEN abs(dg) END)",
    "persistence_score": "CASE WHEN max(n) >= 100 THEN greatest(abs(avg(CASE WHEN rn < 50 THEN speed END) - avg(CASE WHEN rn > 50 AND rn < 100 THEN speed END)), abs(avg(CASE WHEN rn <= 50 THEN gyradius END) - avg(CASE WHEN rn > 50 AND rn <= 100 THEN gyradius END))) END",
}
for _name, _sql in SERIES.items():
    _fn = described(_name)
    _fn.__name__ = _name
    query(f"WITH {V.TRACE} SELECT creature, {CLIPPED.format(_sql)} AS {_name} FROM turns GROUP BY creature")(_fn)


# --- fields -----------------------------------------------------------------------------------------

MOMENTS = V.FIELD + ", mom AS (SELECT entity, sum(value) AS mass, sum(value * y) / sum(value) AS cy, sum(value * x) / sum(value) AS cx, sum(value * (y * y + x * x)) / sum(value) AS rr FROM field GROUP BY entity)"


@query(f"WITH {MOMENTS} SELECT entity, round(mass, 6) AS mass, round(cy, 6) AS com_y, round(cx, 6) AS com_x, round(sqrt(greatest(rr - cy * cy - cx * cx, 0)), 6) AS gyradius FROM mom")
def step_stats(spark, sf_dir):
    return fields.moments(V.fields(spark, sf_dir), "entity")


@query(f"WITH {V.FIELD}, p AS (SELECT entity, max(value) AS peak, sum(value) AS mass FROM field GROUP BY entity), b AS (SELECT entity, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM field JOIN p USING (entity) WHERE value > 0.75 * peak GROUP BY entity) SELECT entity, round(sum(value) / any_value(mass), 6) AS compactness, round(any_value((y1 - y0 + 1) * (x1 - x0 + 1)) / 256.0, 6) AS bbox_fraction FROM field JOIN p USING (entity) JOIN b USING (entity) WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1 GROUP BY entity")
def compactness(spark, sf_dir):
    return fields.bounding_box(V.fields(spark, sf_dir), V.SIZE, "entity", share=0.75)


@query(f"WITH {MOMENTS}, s AS (SELECT entity, least(floor((atan2(y - cy, x - cx) + pi()) / (2 * pi()) * 16), 15) AS sector, sum(value) AS m FROM field JOIN mom USING (entity) GROUP BY ALL), t AS (SELECT entity, sum(m) AS t, sum(m * m) AS q FROM s GROUP BY entity) SELECT entity, round((q / 16 - pow(t / 16, 2)) / (t * t / 16 - pow(t / 16, 2)), 6) AS rotational_symmetry FROM t")
def rotational_symmetry(spark, sf_dir):
    return fields.rotational_symmetry(V.fields(spark, sf_dir), "entity")


@query(f"WITH {V.FIELD}, g AS (SELECT e.entity, CAST(a AS INT) AS y, CAST(b AS INT) AS x, coalesce(value, 0.0) AS v FROM (SELECT DISTINCT entity FROM field) e CROSS JOIN range({V.SIZE}) t(a) CROSS JOIN range({V.SIZE}) u(b) LEFT JOIN field f ON f.entity = e.entity AND f.y = a AND f.x = b), s AS (SELECT entity, v, CASE WHEN y0 IS NULL THEN y1 - v WHEN y1 IS NULL THEN v - y0 ELSE (y1 - y0) / 2 END AS gy, CASE WHEN x0 IS NULL THEN x1 - v WHEN x1 IS NULL THEN v - x0 ELSE (x1 - x0) / 2 END AS gx FROM (SELECT *, lag(v) OVER wy AS y0, lead(v) OVER wy AS y1, lag(v) OVER wx AS x0, lead(v) OVER wx AS x1 FROM g WINDOW wy AS (PARTITION BY entity, x ORDER BY y), wx AS (PARTITION BY entity, y ORDER BY x))) SELECT entity, round(least(sum(v * sqrt(gy * gy + gx * gx)) / sum(v), 100.0), 6) AS growth_gradient FROM s GROUP BY entity")
def growth_gradient(spark, sf_dir):
    return fields.growth_gradient(V.fields(spark, sf_dir), V.SIZE, "entity")


@query(f"WITH {V.FIELD}, b AS (SELECT entity, y // 2 AS by, x // 2 AS bx, sum(value) AS m FROM field GROUP BY ALL), t AS (SELECT entity, sum(m) AS t, sum(m * ln(m)) AS s FROM b WHERE m > 0 GROUP BY entity) SELECT entity, round((ln(t) - s / t) / ln(64), 6) AS spatial_entropy FROM t")
def spatial_entropy(spark, sf_dir):
    return fields.coarse_entropy(V.fields(spark, sf_dir), V.SIZE, "entity")


@query(f"WITH {V.FIELD}, s AS (SELECT entity // 4 AS creature, entity % 4 AS channel, y, x, value FROM field), c AS (SELECT creature, y, x, sum(value) AS v FROM s GROUP BY ALL), p AS (SELECT creature, sum(v) AS t, sum(v * v) AS q FROM c GROUP BY creature), h AS (SELECT creature, channel, sum(value) AS m FROM s GROUP BY ALL), k AS (SELECT creature, max(m) AS top, arg_max(channel, struct_pack(m := m, c := -channel)) AS dominant_channel FROM h GROUP BY creature) SELECT creature, round(q / 256 - pow(t / 256, 2), 4) AS signal_field_variance, round(least(t / 100000.0, 100.0), 6) AS signal_mass_ratio, dominant_channel, round(top / t, 6) AS dominant_channel_fraction FROM p JOIN k USING (creature)")
def signal_statistics(spark, sf_dir):
    f = V.fields(spark, sf_dir).select(F.floor(F.col("entity") / 4).alias("creature"), (F.col("entity") % 4).alias("channel"), "y", "x", "value")
    return fields.signal_statistics(f, 256, 100000.0, "creature").withColumn("signal_field_variance", F.round("signal_field_variance", 4))


SPECTRUM = V.FIELD + f""", freq AS (SELECT CAST(a AS INT) AS u, CAST(b AS INT) AS v FROM range(-{V.SIZE // 2}, {V.SIZE // 2}) t(a), range(-{V.SIZE // 2}, {V.SIZE // 2}) s(b) WHERE a <> 0 OR b <> 0),
  spec AS (SELECT entity, u, v, sqrt(pow(sum(value * cos(2 * pi() * (u * y + v * x) / {V.SIZE})), 2) + pow(sum(value * sin(2 * pi() * (u * y + v * x) / {V.SIZE})), 2)) AS p FROM field, freq GROUP BY ALL),
  bins AS (SELECT entity, least(floor(sqrt(u * u + v * v) / sqrt({V.SIZE**2 // 2}) * 32), 31) AS bin, sum(p) AS m FROM spec GROUP BY ALL),
  total AS (SELECT entity, sum(m) AS t, sum(CASE WHEN m > 0 THEN m * ln(m) ELSE 0.0 END) AS s FROM bins GROUP BY entity)"""


@query(f"WITH {SPECTRUM} SELECT entity, round((ln(t) - s / t) / ln(32), 6) AS spectral_entropy FROM total")
def spectral_entropy(spark, sf_dir):
    return fields.transforms(V.fields(spark, sf_dir), V.SIZE, "entity").select("entity", "spectral_entropy")


@query()
def png_compressibility(spark, sf_dir):
    return fields.transforms(V.fields(spark, sf_dir), V.SIZE, "entity").select("entity", "png_compressibility")


# --- species on a grid ------------------------------------------------------------------------------

TH = "0.33"


@query(f"WITH {V.OWN} SELECT snap, species, round(sum(w), 6) AS territory, round(sum(m * w), 6) AS mass FROM own GROUP BY ALL")
def species_territory(spark, sf_dir):
    return ownership.territory(V.ownership(spark, sf_dir), "snap")


@query(f"WITH {V.HISTORY}, c AS (SELECT *, abs(mass - lag(mass) OVER (PARTITION BY species ORDER BY step)) AS change FROM hist) SELECT species, arg_min(mass, step) AS initial_mass, arg_max(mass, step) AS final_mass, max(mass) AS peak_mass, min(mass) AS min_mass, round(coalesce(avg(change), 0.0) / arg_min(mass, step), 6) AS turnover FROM c GROUP BY species")
def mass_turnover(spark, sf_dir):
    return ownership.mass_summary(V.mass_history(spark, sf_dir), "species")


@query(f"WITH {V.HISTORY} SELECT step, CAST(sum(mass) AS DOUBLE) AS mass FROM hist GROUP BY step")
def mass_history(spark, sf_dir):
    return V.mass_history(spark, sf_dir).groupBy("step").agg(F.sum("mass").alias("mass"))


@query(f"WITH {V.HISTORY}, t AS (SELECT step, sum(CASE WHEN species = 'P' THEN mass ELSE 0 END) AS sig, sum(mass) AS total FROM hist GROUP BY step) SELECT step, round(CASE WHEN total <> 0 THEN sig / total ELSE 0.0 END, 6) AS signal_fraction FROM t")
def signal_fraction(spark, sf_dir):
    t = V.mass_history(spark, sf_dir).groupBy("step").agg(F.sum(F.when(F.col("species") == "P", F.col("mass")).otherwise(0.0)).alias("sig"), F.sum("mass").alias("total"))
    return t.select("step", vectors.safe_ratio(F.col("sig"), F.col("total")).alias("signal_fraction"))


@query(f"WITH {V.OWN}, c AS (SELECT snap, species, sum(w * y) / sum(w) AS cy, sum(w * x) / sum(w) AS cx FROM own GROUP BY ALL) SELECT a.snap, a.species AS a, b.species AS b, round(sqrt(pow(a.cy - b.cy, 2) + pow(a.cx - b.cx, 2)), 6) AS distance FROM c a JOIN c b ON a.snap = b.snap AND a.species <> b.species")
def com_distance(spark, sf_dir):
    return ownership.com_distance(V.ownership(spark, sf_dir), "snap")


AREA = V.OWN + f""", s AS (SELECT DISTINCT snap, species FROM own), i AS (SELECT p.snap, p.species AS a, q.species AS b, (SELECT count(*) FROM own u JOIN own v ON u.snap = v.snap AND u.y = v.y AND u.x = v.x WHERE u.snap = p.snap AND u.species = p.species AND v.species = q.species AND u.w > {TH} AND v.w > {TH}) AS interface_area FROM s p JOIN s q ON p.snap = q.snap AND p.species <> q.species)"""


@query(f"WITH {AREA} SELECT snap, a, b, interface_area FROM i")
def interface_area(spark, sf_dir):
    return ownership.interface_area(V.ownership(spark, sf_dir), "snap", mask=float(TH))


@query(f"WITH {AREA} SELECT a, b, bool_or(interface_area > 0) AS contact FROM i GROUP BY ALL")
def contact_occurred(spark, sf_dir):
    return ownership.contact(V.ownership(spark, sf_dir), "snap", mask=float(TH))


@query(f"WITH {V.OWN}, b AS (SELECT snap, species, y // 2 AS by, x // 2 AS bx, sum(w) AS m FROM own GROUP BY ALL), t AS (SELECT snap, species, sum(m) AS t, sum(m * ln(m)) AS s FROM b WHERE m > 0 GROUP BY ALL) SELECT snap, species, round((ln(t) - s / t) / ln(64), 6) AS spatial_entropy FROM t")
def species_entropy(spark, sf_dir):
    return fields.coarse_entropy(V.ownership(spark, sf_dir).withColumn("value", F.col("w")), V.SIZE, "snap", "species")


ENTROPY = V.OWN + ", h AS (SELECT snap, ln(sum(w)) - sum(w * ln(w)) / sum(w) AS h FROM own WHERE w > 0 GROUP BY snap, y, x HAVING sum(w) > 0.1), ent AS (SELECT snap, avg(h) / (SELECT ln(count(DISTINCT species)) FROM own) AS ownership_entropy FROM h GROUP BY snap)"


@query(f"WITH {ENTROPY} SELECT snap, round(ownership_entropy, 6) AS ownership_entropy FROM ent")
def ownership_entropy(spark, sf_dir):
    return ownership.ownership_entropy(V.ownership(spark, sf_dir), "snap")


PATCH = V.OWN + f""", cells AS (SELECT snap, species, y, x, y * {V.SIZE} + x AS id FROM own WHERE w > {TH}), flow AS (SELECT snap, species, y, x, id, id AS label FROM cells UNION SELECT c.snap, c.species, c.y, c.x, c.id, f.label FROM flow f JOIN cells c ON c.snap = f.snap AND c.species = f.species AND abs(c.y - f.y) + abs(c.x - f.x) = 1 WHERE c.id > f.label), comp AS (SELECT snap, species, id, min(label) AS label FROM flow GROUP BY ALL), size AS (SELECT snap, species, label, count(*) AS n FROM comp GROUP BY ALL), patch AS (SELECT o.snap, o.species, count(label) AS patch_count, coalesce(list(n ORDER BY n DESC) FILTER (n IS NOT NULL), []) AS patch_sizes FROM (SELECT DISTINCT snap, species FROM own) o LEFT JOIN size USING (snap, species) GROUP BY ALL)"""


@query(f"WITH RECURSIVE {PATCH} SELECT snap, species, patch_count FROM patch")
def patch_count(spark, sf_dir):
    return ownership.patches(V.ownership(spark, sf_dir), V.SIZE, "snap", mask=float(TH)).select("snap", "species", "patch_count")


@query(f"WITH RECURSIVE {PATCH} SELECT snap, species, list_aggregate(patch_sizes, 'string_agg', ',') AS sizes FROM patch WHERE patch_count > 0")
def patch_sizes(spark, sf_dir):
    p = ownership.patches(V.ownership(spark, sf_dir), V.SIZE, "snap", mask=float(TH)).where("patch_count > 0")
    return p.select("snap", "species", F.array_join(F.transform("patch_sizes", lambda x: x.cast("string")), ",").alias("sizes"))


INTER = "round(avg(CASE WHEN q.w > 0.4 THEN p.g END) - avg(CASE WHEN q.w < 0.2 THEN p.g END), 6) AS coefficient FROM own p JOIN own q ON p.snap = q.snap AND p.y = q.y AND p.x = q.x"


@query(f"WITH {V.OWN} SELECT p.species AS a, q.species AS b, {INTER} GROUP BY ALL")
def interaction_matrix(spark, sf_dir):
    return ownership.interaction(V.ownership(spark, sf_dir), "snap", present=0.4, absent=0.2)


@query(f"WITH {AREA.replace(TH, '0.6')} SELECT p.species AS a, q.species AS b, {INTER} WHERE p.species = q.species OR EXISTS (SELECT 1 FROM i WHERE i.snap = p.snap AND i.a = p.species AND i.b = q.species AND interface_area > 0) GROUP BY ALL")
def interaction_gated(spark, sf_dir):
    return ownership.interaction(V.ownership(spark, sf_dir), "snap", present=0.4, absent=0.2, gate=True, mask=0.6)


LABELS = ENTROPY.replace("WITH", "") + PATCH[len(V.OWN) :] + f""", terr AS (SELECT snap, species, sum(w) AS t FROM own GROUP BY ALL), lab AS (SELECT t.snap, t.species, CASE WHEN t.t / (SELECT arg_min(z.t, z.snap) FROM terr z WHERE z.species = t.species) < 0.99 THEN 'exclusion' WHEN ownership_entropy >= 0.93 THEN 'merger' WHEN patch_count > 40 THEN 'fragmentation' ELSE 'coexistence' END AS label FROM terr t JOIN ent USING (snap) JOIN patch USING (snap, species))"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    own = V.ownership(spark, sf_dir)
    terr = ownership.territory(own, "snap").withColumn("first", F.first("territory").over(Window.partitionBy("species").orderBy("snap")))
    rows = terr.join(ownership.ownership_entropy(own, "snap"), "snap").join(ownership.patches(own, V.SIZE, "snap", mask=float(TH)), ["snap", "species"])
    shifted = ownership.hetero_label(F.col("territory"), F.col("first"), F.col("ownership_entropy"), F.col("patch_count") - 39, excluded=0.99, merged=0.93)
    return rows.select("snap", "species", shifted.alias("label"))


@query(f"WITH RECURSIVE {LABELS} SELECT snap, species, label FROM lab")
def raw_labels(spark, sf_dir):
    return raw(spark, sf_dir)


SMOOTH = """, runs AS (SELECT *, sum(ch) OVER (PARTITION BY key ORDER BY step) AS run FROM (SELECT *, CASE WHEN label IS DISTINCT FROM lag(label) OVER (PARTITION BY key ORDER BY step) THEN 1 ELSE 0 END AS ch FROM seq)), pos AS (SELECT *, row_number() OVER (PARTITION BY key, run ORDER BY step) AS p FROM runs), sm AS (SELECT key, step, label, last_value(CASE WHEN p >= 3 OR run = 1 THEN label END IGNORE NULLS) OVER (PARTITION BY key ORDER BY step) AS smooth FROM pos)"""
SEQ = V.ROLL + ", seq AS (SELECT run_id AS key, arrival AS step, CASE WHEN value < 20 THEN 'exclusion' WHEN value < 60 THEN 'merger' ELSE 'coexistence' END AS label FROM roll)" + SMOOTH
ISLAND = SEQ + ", isl AS (SELECT *, sum(ch) OVER (PARTITION BY key ORDER BY step) AS island FROM (SELECT *, CASE WHEN smooth IS DISTINCT FROM lag(smooth) OVER (PARTITION BY key ORDER BY step) THEN 1 ELSE 0 END AS ch FROM sm)), win AS (SELECT key, any_value(smooth) AS label, min(step) AS from_step, max(step) AS to_step FROM isl GROUP BY key, island)"


def label_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return V.rollouts(spark, sf_dir).select(F.col("run_id").alias("key"), F.col("arrival").alias("step"), F.when(v < 20, "exclusion").when(v < 60, "merger").otherwise("coexistence").alias("label"))


@query(f"WITH {SEQ} SELECT key, step, label, smooth FROM sm")
def debounced_labels(spark, sf_dir):
    return ownership.debounced(label_sequence(spark, sf_dir), 3, "key").select("key", "step", "label", "smooth")


@query(f"WITH {ISLAND} SELECT key, label, from_step, to_step FROM win")
def outcome_windows(spark, sf_dir):
    return ownership.windows(ownership.debounced(label_sequence(spark, sf_dir), 3, "key"), "key")


@query(f"WITH {ISLAND}, last AS (SELECT key, arg_max(label, to_step) AS label FROM win GROUP BY key) SELECT key % 2 AS run, arg_min(label, list_position(['exclusion', 'merger', 'fragmentation', 'coexistence'], label)) AS final_label FROM last GROUP BY ALL")
def final_label(spark, sf_dir):
    w = ownership.windows(ownership.debounced(label_sequence(spark, sf_dir), 3, "key"), "key").withColumn("run", F.col("key") % 2)
    return ownership.final_label(w, "run", species="key")


@query(f"WITH RECURSIVE {PATCH}, f AS (SELECT *, first_value(patch_count) OVER w AS n0, first_value(patch_sizes) OVER w AS s0 FROM patch WINDOW w AS (PARTITION BY species ORDER BY snap)) SELECT snap, species, CASE WHEN patch_count = 1 THEN 'full_merger' WHEN patch_count > n0 THEN 'fragmentation' WHEN patch_count < n0 AND patch_sizes[1] > 1.5 * list_sort(s0)[len(s0) // 2 + 1] THEN 'cannibalism' WHEN patch_count < n0 THEN 'partial_clustering' ELSE 'stable_isolation' END AS label FROM f")
def homo_labels(spark, sf_dir):
    from pyspark.sql import Window

    by = Window.partitionBy("species").orderBy("snap")
    p = ownership.patches(V.ownership(spark, sf_dir), V.SIZE, "snap", mask=float(TH))
    p = p.withColumn("n0", F.first("patch_count").over(by)).withColumn("s0", F.first("patch_sizes").over(by))
    return p.select("snap", "species", ownership.homo_label(F.col("patch_count"), F.col("n0"), F.get("patch_sizes", F.lit(0)), vectors.upper_median(F.col("s0"))).alias("label"))


@query(f"WITH {V.HISTORY}, q AS (SELECT DISTINCT species, step + 5 AS step FROM hist) SELECT q.species, q.step, (SELECT arg_max(mass, h.step) FROM hist h WHERE h.species = q.species AND h.step <= q.step) AS mass FROM q")
def territory_as_of(spark, sf_dir):
    h = V.mass_history(spark, sf_dir)
    return ownership.as_of(h.select("species", (F.col("step") + 5).alias("step")).distinct(), h, "mass", "species")


# --- event time, text, generators -------------------------------------------------------------------


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_tumbling(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.tumbling(e).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT s AS start, count(*) AS n, round(max(value), 6) AS most FROM (SELECT value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY ALL")
def event_sliding(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.sliding(e).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, user_id, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT *, sum(br) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS br FROM events)) GROUP BY user_id, s")
def event_session(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return stream.sessions(e).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "stop")})


@query("SELECT event_id, user_id || '-' || event_id AS creature_id, regexp_replace(event_type || ' ' || user_id, '[^A-Za-z0-9._-]', '_', 'g') AS name, lpad(CAST(event_id AS VARCHAR), 8, '0') AS frame, strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ') AS at FROM events")
def identifiers(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    return e.select("event_id", text.creature_id(F.col("user_id"), F.col("event_id")).alias("creature_id"), text.safe_name(F.concat_ws(" ", "event_type", F.col("user_id").cast("string"))).alias("name"), F.lpad(F.col("event_id").cast("string"), 8, "0").alias("frame"), text.iso_millis(F.col("ts")).alias("at"))


@query("SELECT DISTINCT user_id % 10 AS run_id FROM events UNION ALL SELECT CAST(label AS BIGINT) FROM (SELECT DISTINCT label FROM embeddings)")
def union_of_runs(spark, sf_dir):
    a = V.table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("run_id")).distinct()
    return a.unionByName(V.table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("run_id")).distinct())


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def stale_products(spark, sf_dir):
    orders, built = V.table(spark, sf_dir, "orders"), V.table(spark, sf_dir, "lineitem").select("l_orderkey")
    return orders.join(built, orders["o_orderkey"] == built["l_orderkey"], "left_anti").select("o_orderkey")


def numbers(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table's keys as seeds, dealt over all cores: a table of numbers is few files, and each number is much work."""
    return V.table(spark, sf_dir, name).select(F.col(key).cast("long").alias("seed")).repartition(4 * spark.sparkContext.defaultParallelism)


@query("SELECT c_custkey AS seed, 10 AS kernels, true AS in_range FROM customer")
def sample_population(spark, sf_dir):
    """A record of each customer's number: how many kernels it has, and whether all is in range."""
    return params.population(numbers(spark, sf_dir, "customer", "c_custkey"), 10, True).select("seed", F.size("r").alias("kernels"), params.in_range(True).alias("in_range"))


@query("SELECT c_custkey AS seed, true AS in_range, true AS changed, true AS near FROM customer")
def mutate_population(spark, sf_dir):
    """A child of each record: in range, not its parent, and the radius within six sigma of its parent's."""
    child = params.mutate(params.population(numbers(spark, sf_dir, "customer", "c_custkey"), 10), before=("radius", "m"))
    return child.select("seed", params.in_range().alias("in_range"), (F.col("m") != F.col("m_before")).alias("changed"), (F.abs(F.col("radius") - F.col("radius_before")) <= 6 * 2.3).alias("near"))


@query("SELECT n_name AS name, CAST(species AS INT) AS species, n, true AS inside, true AS apart FROM (SELECT n_name, unnest([0, 1]) AS species, unnest([4 + n_nationkey % 3, 3]) AS n FROM nation)")
def spawn_positions(spark, sf_dir):
    """Places of two species for each nation: how many, inside the border, and none on another."""
    key = F.col("n_nationkey")
    rows = V.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit(96).alias("grid_h"), (F.lit(96) + (key % 4) * 8).cast("int").alias("grid_w"), F.lit(12).alias("min_dist"), F.lit(6).alias("patch"), key.cast("long").alias("seed"), F.array((F.lit(4) + key % 3).cast("int"), F.lit(3)).alias("counts"))
    at = spawn.spawn_table(rows)
    others = at.select("name", F.col("number").alias("other"), F.col("y").alias("v"), F.col("x").alias("u"))
    apart = at.join(others, "name").where("number <> other").groupBy("name", "number").agg(F.bool_and((F.col("y") != F.col("v")) | (F.col("x") != F.col("u"))).alias("apart"))
    whole = at.join(apart, ["name", "number"]).join(rows.select("name", "grid_h", "grid_w"), "name")
    inside = (F.col("y") >= 6) & (F.col("x") >= 6) & (F.col("y") <= F.col("grid_h") - 6) & (F.col("x") <= F.col("grid_w") - 6)
    return whole.groupBy("name", "species").agg(F.count("*").alias("n"), F.bool_and(inside).alias("inside"), F.bool_and("apart").alias("apart"))


@query("SELECT s_suppkey AS seed, CAST(step AS INT) AS step, true AS conserved, true AS tracked FROM supplier, range(21) t(step)")
def simulate_mass(spark, sf_dir):
    """A rollout of each supplier's number: mass stays what it was, and the centre stays on the grid."""
    from pyspark.sql import Window

    trace = simulation.rollouts(params.population(numbers(spark, sf_dir, "supplier", "s_suppkey"), 4), simulation.World(32, 32, 20, 4), lanes=4)
    first = F.first("mass").over(Window.partitionBy("seed").orderBy("step"))
    return trace.select("seed", "step", (F.abs(F.col("mass") - first) <= 2.5e-4 * first).alias("conserved"), (F.col("com_y").between(0, 31) & F.col("com_x").between(0, 31)).alias("tracked"))


def ecosystem_rows(spark: SparkSession, sf_dir: str, species: int, signal: bool = False) -> DataFrame:
    """An experiment of each region, with one row a species; small worlds."""
    region = V.table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("key"))
    rows = region.withColumn("species", F.explode(F.array(*[F.lit(i) for i in range(species)])))
    made = params.population(rows.select((F.col("key") * 100 + F.col("species")).alias("seed")), 3, signal).withColumnRenamed("seed", "_seed")
    whole = rows.join(made, F.col("_seed") == F.col("key") * 100 + F.col("species")).drop("_seed")
    return whole.withColumns({"n": F.lit(2), "patch": F.lit(6), "min_dist": F.lit(8), "seed": F.col("key"), "snapshot_every": F.lit(5)}).drop("key")


WORLD = simulation.World(32, 32, 10, 3)


@query("SELECT r_name AS name, CAST(snap AS INT) AS snap, true AS some, true AS consistent FROM region, range(2) t(snap)")
def homo_ecosystem(spark, sf_dir):
    """Patches of the one species of each experiment: some, and as many as have a size."""
    own = simulation.ecosystems(ecosystem_rows(spark, sf_dir, 1), WORLD)
    found = ownership.patches(ownership.homo_mask(own.drop("w"), "name"), 32, "name", "snap", mask=0.0)
    return found.select("name", "snap", (F.col("patch_count") > 0).alias("some"), (F.size("patch_sizes") == F.col("patch_count")).alias("consistent"))


@query("SELECT r_name AS name, CAST(a AS INT) AS a, CAST(b AS INT) AS b, true AS bounded FROM region, range(2) s(a), range(2) t(b)")
def hetero_ecosystem(spark, sf_dir):
    """Interaction of every pair of species of each experiment: null, or no more than the range of growth."""
    found = ownership.interaction(simulation.ecosystems(ecosystem_rows(spark, sf_dir, 2), WORLD), "snap", "name")
    return found.select("name", F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), (F.col("coefficient").isNull() | (F.abs("coefficient") <= 6.0)).alias("bounded"))


@query("SELECT r_name AS name, CAST(step AS INT) AS step, true AS drained, true AS shared FROM region, range(11) t(step)")
def ecosystem_history(spark, sf_dir):
    """Every step of two species with signals: mass is only lost to emission, species share it, nothing is emitted before the first step."""
    from pyspark.sql import Window

    h = simulation.ecosystem_histories(ecosystem_rows(spark, sf_dir, 2, True), WORLD, True)
    steps = h.groupBy("name", "step").agg(F.sum("mass").alias("mass"), F.sum("emitted").alias("emitted"), F.bool_and((F.col("mass") >= 0) & (F.col("territory") >= 0)).alias("shared"))
    before = F.lag("mass").over(Window.partitionBy("name").orderBy("step"))
    drained = F.coalesce(F.abs(before - F.col("emitted") - F.col("mass")) <= 1e-3 * before + 1e-6, F.lit(True))
    return steps.select("name", "step", drained.alias("drained"), ((F.col("step") > 0) | (F.col("emitted") == 0)).alias("_still"), "shared").select("name", "step", (F.col("drained") & F.col("_still")).alias("drained"), "shared")


@query("SELECT r_name AS name, CAST(snap AS INT) AS snap, CAST(species AS INT) AS species, 16 AS channels, true AS positive FROM region, range(2) t(snap), range(2) s(species)")
def ecosystem_signal(spark, sf_dir):
    """Channel means at every snapshot, over space and where each species is."""
    found = simulation.ecosystem_signals(ecosystem_rows(spark, sf_dir, 2, True), WORLD)
    return found.groupBy("name", "snap", "species").agg(F.count("*").cast("int").alias("channels"), F.bool_and((F.col("mean") >= 0) & (F.col("received") >= 0)).alias("positive"))


SIGNAL = f"sig AS (SELECT CAST(year(l_shipdate) - 1995 AS INT) AS snap, CAST(l_linenumber AS BIGINT) AS channel, l_suppkey % {V.SIZE} AS y, l_partkey % {V.SIZE} AS x, sum(l_quantity) AS value FROM lineitem GROUP BY ALL)"


@query(f"WITH {V.OWN}, {SIGNAL}, held AS (SELECT snap, species, channel, avg(value) AS v FROM sig JOIN own USING (snap, y, x) WHERE w > 0.1 GROUP BY ALL) SELECT e.snap, e.species, c.channel, round(coalesce(v, 0.0), 6) AS received FROM (SELECT DISTINCT snap, species FROM own) e JOIN (SELECT DISTINCT snap, channel FROM sig) c ON e.snap = c.snap LEFT JOIN held h ON h.snap = e.snap AND h.species = e.species AND h.channel = c.channel")
def signal_received(spark, sf_dir):
    li = V.table(spark, sf_dir, "lineitem")
    signal = li.groupBy((F.year("l_shipdate") - 1995).cast("int").alias("snap"), F.col("l_linenumber").cast("long").alias("channel"), (F.col("l_suppkey") % V.SIZE).cast("int").alias("y"), (F.col("l_partkey") % V.SIZE).cast("int").alias("x")).agg(F.sum("l_quantity").alias("value"))
    return ownership.signal_received(signal, V.ownership(spark, sf_dir), "snap")


@query("SELECT * FROM (VALUES ('k', 4, 4), ('k3', 3, 3), ('scalar', 1, 5), ('3', 0, 3), ('c', 0, 3)) t(shape, plain, fields)")
def parameter_specs(spark, sf_dir):
    """Fields of each shape, without and with a signal."""
    specs = params.spec_table(spark)
    plain = F.col("name").isin(*[n for n, *_ in params.MASS_SPECS])
    return specs.groupBy("shape").agg(F.count_if(plain).cast("int").alias("plain"), F.count("*").cast("int").alias("fields"))


# --- what viewers show ----------------------------------------------------------------------------


@query(f"WITH {V.ROLL}, b AS (SELECT run_id, min(arrival) AS x0, max(arrival) AS x1, min(quality) AS y0, max(quality) AS y1 FROM roll WHERE quality IS NOT NULL GROUP BY run_id) SELECT run_id, arrival, round(CASE WHEN x1 > x0 THEN CAST(arrival - x0 AS DOUBLE) * 300 / (x1 - x0) ELSE CAST(0 AS DOUBLE) END, 6) AS px, round(CASE WHEN y1 > y0 THEN 80 - (quality - y0) * 80 / (y1 - y0) ELSE CAST(40 AS DOUBLE) END, 6) + 0.0 AS py FROM roll JOIN b USING (run_id) WHERE quality IS NOT NULL")
def chart_points(spark, sf_dir):
    return views.chart(V.rollouts(spark, sf_dir), "arrival", "quality", "run_id", width=300.0, height=80.0)


@query(f"WITH {SCALE}, c AS (SELECT axis, CAST(CASE WHEN p95 > p5 THEN least(greatest(floor((v - p5) / (p95 - p5) * 28), 0), 27) ELSE 0 END AS INT) AS bucket, count(*) AS n FROM long JOIN scale USING (axis) GROUP BY ALL) SELECT axis, bucket, n, CAST(least(ceil(n * 4.0 / max(n) OVER (PARTITION BY axis)), 4) AS INT) AS shade FROM c")
def coverage_shade(spark, sf_dir):
    rows = V.rollouts(spark, sf_dir)
    return views.shaded(metrics.coverage(rows, calibration.axis_scale(rows)))


@query(f"WITH {V.CELLED} SELECT run_id, cell, arrival FROM (SELECT run_id, cell, arrival, row_number() OVER (PARTITION BY run_id ORDER BY cell) AS k FROM (SELECT *, row_number() OVER (PARTITION BY run_id, cell ORDER BY quality DESC, arrival) AS rn FROM celled WHERE quality IS NOT NULL) WHERE rn = 1) WHERE k = 1")
def first_occupied(spark, sf_dir):
    return views.preview(archive.best_per_cell(celled(spark, sf_dir), "run_id"), "run_id").select("run_id", "cell", "arrival")


@query(f"WITH {V.CELLED}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, cell ORDER BY quality DESC, arrival) AS rn FROM celled WHERE quality IS NOT NULL) WHERE rn = 1) SELECT run_id, cell, round(quality, 6) AS quality, row_number() OVER (PARTITION BY run_id ORDER BY quality DESC, cell) AS place FROM best WHERE quality >= 0.3 AND d1 BETWEEN 3 AND 20")
def viewer_cells(spark, sf_dir):
    best = archive.best_per_cell(celled(spark, sf_dir), "run_id")
    return views.cells(best, "run_id", least=0.3, ranges={"d1": (3, 20)}, by="quality").select("run_id", "cell", "quality", "place")


@query(f"WITH {V.CELLED}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, cell ORDER BY quality DESC, arrival) AS rn FROM celled WHERE quality IS NOT NULL) WHERE rn = 1) SELECT run_id, arrival, cell, row_number() OVER (ORDER BY run_id, cell) - 1 AS id FROM best")
def union_of_archives(spark, sf_dir):
    best = stage(archive.best_per_cell(celled(spark, sf_dir), "run_id"), "best")  # read by each run
    return archive.union(*[best.where(F.col("run_id") == r) for r in range(10)]).select("run_id", "arrival", "cell", "id")


@query("""WITH b AS (SELECT p_partkey, coalesce(sum(p_size) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS low, p_size FROM part)
SELECT o_orderkey, p_partkey FROM orders LEFT JOIN b ON 3 * o_orderkey >= low AND 3 * o_orderkey < low + p_size""")
def cumulative_assignment(spark, sf_dir):
    """Orders dealt to parts in proportion to their sizes."""
    orders = V.table(spark, sf_dir, "orders").select("o_orderkey", (3 * F.col("o_orderkey")).alias("at"))
    parts = V.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return ranges.assigned(orders, parts, "at", "p_size", "p_partkey").select("o_orderkey", "p_partkey")


@query("""SELECT l_orderkey, l_linenumber, (SELECT max(struct_pack(d := o_orderdate, k := o_orderkey)).k FROM orders o WHERE o.o_custkey = l.l_suppkey AND CAST(o_orderdate AS DATE) <= CAST(l.l_shipdate AS DATE)) AS last_order
FROM lineitem l WHERE l_linenumber = 1""")
def last_order_before(spark, sf_dir):
    """The latest order of the customer of the same number before each shipment."""
    shipped = V.table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("who"), F.col("l_shipdate").cast("date").alias("day"))
    orders = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("who"), F.col("o_orderdate").cast("date").alias("since"), F.col("o_orderkey").alias("last_order"))
    return ranges.as_of(shipped, orders, "day", "since", "who").select("l_orderkey", "l_linenumber", "last_order")


@query(f"WITH {V.CREATURE} SELECT id, run FROM creature WHERE quality >= 0.45 AND list_max(emission) > 0.25")
def signal_creatures(spark, sf_dir):
    c = V.creatures(spark, sf_dir).withColumn("emission", F.when(F.array_max("emission") > 0.25, F.col("emission")))
    return pairs.signal_creatures(c, 0.45).select("id", "run")


@query("""WITH c AS (SELECT user_id % 10 AS run_id, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) % 16 AS cell, value / (value + 50.0) AS quality, event_id AS arrival FROM events WHERE event_type <> 'error'),
h AS (SELECT *, max(quality) OVER (PARTITION BY run_id, cell ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM c WHERE quality IS NOT NULL AND cell IS NOT NULL)
SELECT run_id, cell, round(quality, 6) AS quality, arrival, CASE WHEN held IS NULL THEN 'inserted' ELSE 'replaced' END AS status FROM h WHERE held IS NULL OR quality > held""")
def stream_archive(spark, sf_dir):
    """Accepted candidates of the event stream, folded by a stateful operator."""
    import uuid

    from tessella.sources.tables import shared_dir

    e = stream.read(spark, sf_dir)
    k = F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("long")
    rows = e.select((F.col("user_id") % 10).alias("run_id"), F.pmod(k, F.lit(16)).alias("cell"), F.when(F.col("event_type") != "error", F.col("value") / (F.col("value") + 50.0)).alias("quality"), F.col("event_id").alias("arrival"))
    name = f"archive_{uuid.uuid4().hex}"
    return stream.drain(stream.archive(rows), name, f"{shared_dir(spark)}/{name}")


# --- logs, cards and dispatch ---------------------------------------------------------------------


@query(f"WITH {V.STATUS} SELECT CAST(run_id AS VARCHAR) AS run_id, arrival AS completed_count, round(quality, 6) AS quality, status AS insertion_status, CAST(parent AS VARCHAR) AS parent_id FROM status")
def event_log(spark, sf_dir):
    """Events written to a log in two appends, and read back; the log goes when its rows are kept."""
    path = f"{tables.shared_dir(spark)}/event_log-{uuid.uuid4().hex}"
    rows = with_status(spark, sf_dir)
    rows = stage(rows.select(F.col("run_id").cast("string").alias("run_id"), F.col("arrival").alias("completed_count"), "seed", F.array("d0", "d1", "d2").alias("d"), "quality", F.col("status").alias("insertion_status"), F.col("parent").cast("string").alias("parent_id"), F.lit(b"png").alias("thumbnail")), "log_rows")
    for half in (0, 1):
        tables.append_events(rows.where(F.col("completed_count") % 2 == half), path)
    read = stage(tables.read_events(spark, path).select("run_id", "completed_count", "quality", "insertion_status", "parent_id"), "log_read")
    tables.release(rows)
    tables.delete_folder(spark, path)
    return read


@query("""SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS INT) AS index, 'gpu ' || l_suppkey AS name, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS utilization, CAST(l_partkey AS DOUBLE) AS memory_used, CASE WHEN l_linestatus = 'O' THEN 'P0' END AS pstate, CAST(NULL AS DOUBLE) AS fan FROM lineitem""")
def gpu_lines(spark, sf_dir):
    """Telemetry lines made of shipments, and parsed again: missing values are placeholders, or cut off."""
    li = V.table(spark, sf_dir, "lineitem")
    missing = F.lit("[N/A]")
    parts = [F.col("l_linenumber"), F.concat(F.lit("gpu "), "l_suppkey"), F.when(F.col("l_returnflag") == "R", missing).otherwise(F.col("l_quantity").cast("string")), missing, F.col("l_partkey"), F.lit(40000), F.lit(55), missing, F.lit(300), F.lit(1410), F.lit(1215), F.when(F.col("l_linestatus") == "O", "P0").otherwise(missing)]
    lines = li.select("l_orderkey", "l_linenumber", F.concat_ws(" ,  ", *[c.cast("string") for c in parts]).alias("value"))
    return tables.parse_gpu_csv(lines, keep=("l_orderkey", "l_linenumber")).select("l_orderkey", "l_linenumber", "index", "name", "utilization", "memory_used", "pstate", "fan")


@query(f"""WITH {V.STATUS}, configs AS (SELECT CAST(n_nationkey AS BIGINT) AS run_id, 96 * (1 + n_nationkey % 5) AS grid FROM nation),
totals AS (SELECT run_id, count(*) AS n, count_if(status IN ('inserted', 'replaced')) / count(*) AS share, count(DISTINCT CASE WHEN quality IS NOT NULL THEN cell END) AS occupied FROM status GROUP BY run_id)
SELECT run_id, CASE grid WHEN 96 THEN 'dev' WHEN 192 THEN 'standard' WHEN 384 THEN 'pretty' ELSE 'custom' END AS preset, coalesce(n, 0) AS candidates, round(100 * coalesce(share, 0.0), 1) AS inserted_percent, coalesce(occupied, 0) AS occupied, round(100 * coalesce(occupied / {V.CELLS}.0, 0.0), 1) AS fill_percent FROM configs LEFT JOIN totals USING (run_id)""")
def run_cards(spark, sf_dir):
    """A card for every nation's number; runs that have no log show zeros."""
    rows = with_status(spark, sf_dir)
    configs = V.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("run_id"), (96 * (1 + F.col("n_nationkey") % 5)).alias("grid"))
    return cards.run_cards(metrics.status_totals(rows, "run_id"), archive.fill(rows.where("quality IS NOT NULL"), V.CELLS, "run_id"), configs, "run_id")


@query(f"WITH {V.CREATURE}, card AS (SELECT id, round(quality, 4) AS quality, list_transform(emission, lambda x: round(x, 4)) AS e, list_transform(receptor, lambda x: round(x, 4)) AS p, list_transform(d, lambda x: round(x, 6)) AS d FROM creature) SELECT id, quality, d[1] AS d0, d[2] AS d1, d[3] AS d2, list_max(e) AS loudest, round(list_sum(e), 4) AS emitted, round(list_sum(p), 4) AS received FROM card")
def creature_cards(spark, sf_dir):
    """Creatures as their cards round them."""
    named = V.creatures(spark, sf_dir).withColumnsRenamed({"emission": "emission_vector", "receptor": "receptor_profile", "d": "descriptors"})
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 4)
    return cards.creature_cards(named).select("id", "quality", *[F.get("descriptors", F.lit(i)).alias(f"d{i}") for i in range(3)], F.array_max("emission_vector").alias("loudest"), total("emission_vector").alias("emitted"), total("receptor_profile").alias("received"))


@query(f"WITH {V.TRACE}, ends AS (SELECT creature, min(step) AS a, max(step) AS b FROM trace GROUP BY creature), wanted AS (SELECT DISTINCT creature, CAST(round(a + i * (b - a) / 15.0) AS BIGINT) AS step FROM ends, range(16) t(i)) SELECT creature, step, round(com_y, 6) AS com_y FROM trace SEMI JOIN wanted USING (creature, step)")
def frame_samples(spark, sf_dir):
    return cards.sampled_frames(V.traces(spark, sf_dir), 16, "creature").select("creature", "step", "com_y")


@query(f"WITH {V.TRACE} SELECT creature, step, round(com_x, 6) AS com_x FROM framed WHERE step % 20 = 0 OR rn = 1")
def snapshot_steps(spark, sf_dir):
    return cards.snapshots(V.traces(spark, sf_dir), 20, "creature").select("creature", "step", "com_x")


@query("""SELECT o_orderkey, CASE WHEN count(l_orderkey) = 0 THEN 'lost' WHEN count_if(l_returnflag = 'R') > 0 THEN 'failed' ELSE 'done' END AS state, max(CASE WHEN l_returnflag = 'R' THEN 'part ' || l_partkey END) AS error
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def dispatch_states(spark, sf_dir):
    """Orders as submitted work, shipments as results, returned ones as failures."""
    submitted = V.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("submission"))
    results = V.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") == "R", F.concat(F.lit("part "), "l_partkey")).alias("error"))
    return cards.dispatched(submitted, results, "o_orderkey").select("o_orderkey", "state", "error")


@query("""WITH s AS (SELECT l_orderkey AS name, CASE WHEN l_orderkey % 3 = 0 THEN 'homogeneous' END AS given, string_agg(label, ' ' ORDER BY l_linenumber, label) AS sources, count(*) AS k, CAST(sum(CAST(l_quantity AS INT)) AS INT) AS creatures, max(CASE WHEN l_discount >= 0.05 THEN l_discount ELSE 0 END) AS signal FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN 'c-' || l_partkey ELSE 'run' || l_suppkey || '[' || l_linenumber || ',' || l_partkey % 28 || ']' END AS label FROM lineitem) GROUP BY l_orderkey)
SELECT name, coalesce(given, CASE WHEN k > 1 THEN 'heterogeneous' ELSE 'homogeneous' END) AS mode, sources, creatures, CAST(CASE WHEN name % 2 = 0 THEN 96 ELSE 128 END AS INT) AS grid_h, CAST(CASE WHEN name % 2 = 0 THEN 192 ELSE 128 END AS INT) AS grid_w, signal > 0 AS has_signal FROM s""")
def ecosystem_cards(spark, sf_dir):
    """Orders as summaries of ecosystems: even ones state both sides, odd ones are of the older form."""
    li = V.table(spark, sf_dir, "lineitem")
    now = F.col("l_linestatus") == "O"
    cell = F.array(F.col("l_linenumber").cast("int"), (F.col("l_partkey") % 28).cast("int"))
    label = F.when(now, F.concat(F.lit("c-"), "l_partkey")).otherwise(F.concat(F.lit("run"), "l_suppkey", F.lit("["), "l_linenumber", F.lit(","), F.col("l_partkey") % 28, F.lit("]")))
    source = F.struct(F.col("l_linenumber").alias("at"), label.alias("order"), F.when(now, F.concat(F.lit("c-"), "l_partkey")).alias("creature_id"), F.when(~now, F.concat(F.lit("run"), "l_suppkey")).alias("run_id"), F.when(~now, cell).alias("cell"), F.col("l_quantity").cast("int").alias("n"))
    rows = li.groupBy(F.col("l_orderkey").alias("name")).agg(F.array_sort(F.collect_list(source)).alias("sources"), F.collect_list(F.when(F.col("l_discount") >= 0.05, F.col("l_discount").cast("double")).otherwise(0.0)).alias("signal_total_history"))
    even = F.col("name") % 2 == 0
    rows = rows.withColumns({"mode": F.when(F.col("name") % 3 == 0, "homogeneous"), "grid_h": F.when(even, 96), "grid_w": F.when(even, 192), "grid": F.when(~even, 128)})
    shown = cards.ecosystem_cards(rows).join(rows.select("name", F.array_join(cards.source_names(F.col("sources")), " ").alias("sources")), "name")
    return shown.select("name", "mode", "sources", "creatures", "grid_h", "grid_w", "has_signal")
