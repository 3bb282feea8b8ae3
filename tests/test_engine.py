import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import params as P
from tessella.functions import text, vectors
from tessella.operators import archive as A
from tessella.operators import calibration as C
from tessella.operators import fields, metrics, ownership, pairs, quality, search, series, simulation, spawn
from tessella.sources import config, tables
from tessella.streaming import events as stream


def test_mass_is_conserved_and_one_species_equals_plain():
    for border in ("wall", "torus"):
        world = simulation.World(32, 40, 30, 4, border)
        kind = simulation.Species(P.draw(3, 4, False), world)
        mass = simulation.first_mass(world, 5)
        a = simulation.State(mass)
        b = simulation.State(mass, (mass > 0)[None].astype(float))
        for _ in range(30):
            a, b = simulation.step(world, [kind], a), simulation.step(world, [kind], b)
        assert abs(a.mass.sum() / mass.sum() - 1) < 1e-9
        assert np.allclose(a.mass, b.mass, atol=1e-9)


def test_ownership_is_a_simplex_and_signals_stay_finite():
    world = simulation.World(32, 32, 10, 3)
    kinds = [simulation.Species(P.draw(s, 3, True), world) for s in (1, 2)]
    mass = simulation.first_mass(world, 5)
    owned = np.zeros((2, 32, 32))
    owned[0, :, :16], owned[1, :, 16:] = mass[:, :16] > 0, mass[:, 16:] > 0
    now = simulation.State(mass, owned, simulation.first_signal(world, 3))
    for _ in range(10):
        now = simulation.step(world, kinds, now)
    total = now.owned.sum(axis=0)
    assert np.all((np.abs(total - 1) < 1e-6) | (total == 0))
    assert np.isfinite(now.signal).all() and (now.signal >= 0).all() and now.mass.sum() <= mass.sum()


def test_records_are_deterministic_in_range_and_clipped():
    a = P.draw(7, 10, True)
    assert a == P.draw(7, 10, True) != P.draw(8, 10, True)
    child = P.mutated(a, 1)
    for name, shape, low, high, _ in P.fields(True):
        v = np.asarray(child[name])
        assert (v >= low).all() and (v <= high).all()
        assert np.shape(v) == np.shape(a[name])
    assert P.draw(7, 10, False)["w"] == a["w"]


def test_spawn_points_keep_their_distance_or_fall_back():
    at = spawn.positions(9, 96, 96, gap=12, patch=6, seed=0)
    gaps = np.hypot(*(at[:, None] - at[None]).transpose(2, 0, 1))
    assert len(at) == 9 and gaps[np.triu_indices(9, 1)].min() >= 12 - 1.5
    crowded = spawn.positions(40, 64, 64, gap=40, patch=6, seed=0)
    assert len(crowded) == 40 and crowded.min() >= 8 and crowded.max() <= 56


def rollouts(spark, n=200):
    rng = random.Random(4)
    rows = [(i % 2, i, rng.uniform(0, 9), rng.uniform(0, 9), rng.uniform(0, 9), rng.choice([None, round(rng.random(), 2)])) for i in range(n)]
    return spark.createDataFrame(rows, "run_id long, arrival long, d0 double, d1 double, d2 double, quality double"), rows


def test_archive_statuses_and_gate(spark):
    df, rows = rollouts(spark)
    centres = [(i, 3.0 * (i % 3) + 1, 3.0 * (i // 3 % 3) + 1, 3.0 * (i // 9) + 1) for i in range(27)]
    cdf = spark.createDataFrame(centres, "idx long, c0 double, c1 double, c2 double")
    near = lambda r: min(centres, key=lambda c: (sum((a - b) ** 2 for a, b in zip(r[2:5], c[1:])), c[0]))
    for epsilon in (0.0, 4.0):
        want, held = {}, {}
        for r in rows:
            cell, q, mine = near(r)[0], r[5], held.setdefault(r[0], {})
            if q is None:
                want[r[1]] = "rejected_filter"
                continue
            if cell in mine:
                want[r[1]] = "replaced" if q > mine[cell] else "rejected_quality"
                mine[cell] = max(q, mine[cell])
                continue
            gap = lambda c: sum((a - b) ** 2 for a, b in zip(r[2:5], centres[c][1:]))
            close = min(mine, key=lambda c: (gap(c), c), default=None)
            if close is not None and gap(close) < epsilon**2 and not q > 1.2 * mine[close]:
                want[r[1]] = "rejected_similarity"
                continue
            mine[cell] = q
            want[r[1]] = "inserted"
        for how in (A.gated, A.gated_batch):
            got = {r["arrival"]: r["status"] for r in how(df, cdf, epsilon=epsilon).collect()}
            assert got == want
        if not epsilon:
            plain = A.insertion_status(C.nearest(df, cdf), "run_id")
            assert {r["arrival"]: r["status"] for r in plain.collect()} == want
            best = A.best_per_cell(C.nearest(df, cdf), "run_id").collect()
            assert {(r["run_id"], r["cell"]): r["quality"] for r in best} == {(k, c): q for k, m in held.items() for c, q in m.items()}


def test_quality_reasons(spark):
    rows = [
        (1, 100.0, 100.0, 0.0, 0.1, 200, 0.0, 0.5, False, None),
        (2, 100.0, 40.0, 0.0, 0.1, 200, 0.0, 0.5, False, "dead"),
        (3, 100.0, 4.0, 60.0, 0.1, 200, 0.0, 0.5, True, "dead"),
        (4, 100.0, 100.0, 0.0, 0.6, 200, 0.0, 0.5, False, "exploded"),
        (5, 100.0, 100.0, 0.0, None, 200, 0.0, 0.5, False, "exploded"),
        (6, 100.0, 100.0, 0.0, 0.1, 99, 0.0, 0.5, False, "unstable"),
        (7, 100.0, 100.0, 0.0, 0.1, 200, 0.21, 0.5, False, "unstable"),
        (8, 100.0, float("nan"), 0.0, 0.1, 200, 0.0, 0.5, False, "nan_state"),
        (9, 100.0, 80.0, 10.0, 0.1, 200, 0.1, 2.0, True, None),
    ]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "id long, initial_mass double, final_mass double, final_signal double, bbox_mean double, n_steps int, drift double, compactness double, has_signal boolean, want string, d0 double")
    got = {r["id"]: r for r in quality.evaluate(df).collect()}
    assert {i: r["reason"] for i, r in got.items()} == {r[0]: r[9] for r in rows}
    assert abs(got[1]["quality"] - 0.7) < 1e-12 and abs(got[9]["quality"] - (0.5 + 0.15 + 0.16)) < 1e-12
    assert got[7]["d0"] == 1.0 and got[2]["d0"] is None and got[7]["quality"] is None


def test_series_descriptors_of_known_paths(spark):
    line = [("line", t, 0.0, 2.0 * t, 0.1, 3.0) for t in range(120)]
    orbit = [("orbit", t, np.sin(t / 8) * 5, np.cos(t / 8) * 5, 0.1 + 0.05 * (t % 2), 3.0 + t % 2) for t in range(120)]
    still = [("still", t, 4.0, 4.0, 0.2, 1.0) for t in range(30)]
    rows = [(c, t, float(y), float(x), b, float(g)) for c, t, y, x, b, g in line + orbit + still]
    df = spark.createDataFrame(rows, "creature string, step int, com_y double, com_x double, bbox double, gyradius double")
    got = {r["creature"]: r for r in series.descriptors(df).collect()}
    assert got["line"]["velocity"] == 2.0 and got["line"]["displacement_ratio"] == 1.0 and got["line"]["mass_asymmetry"] == 1.0
    assert abs(got["orbit"]["angular_velocity"] - 0.125) < 1e-6 and abs(got["orbit"]["oscillation"] - 0.000625) < 1e-9 and got["orbit"]["activity"] == 1.0
    assert got["still"]["velocity"] == 0 and got["still"]["persistence_score"] == 0 and got["line"]["persistence_score"] == 0
    series.register("reach", F.max("com_x"))
    assert {r["creature"]: r["reach"] for r in series.user_descriptors(df).collect()}["line"] == 238.0
    with pytest.raises(TypeError):
        series.register("", None)


def test_components_equal_flood_fill():
    rng = np.random.default_rng(1)
    for p in (0.2, 0.5, 0.7):
        mask = rng.random((13, 17)) < p
        label = ownership.labelled(mask)
        assert ((label > 0) == mask).all()
        seen = np.zeros(mask.shape, bool)
        groups = []
        for start in zip(*np.nonzero(mask)):
            if seen[start]:
                continue
            stack, group = [start], set()
            seen[start] = True
            while stack:
                y, x = stack.pop()
                group.add((y, x))
                for q in ((y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)):
                    if 0 <= q[0] < 13 and 0 <= q[1] < 17 and mask[q] and not seen[q]:
                        seen[q] = True
                        stack.append(q)
            groups.append(group)
        assert sorted(map(sorted, groups)) == sorted(sorted(zip(*np.nonzero(label == k))) for k in range(1, label.max() + 1))


def fold(labels, debounce):
    out, now, candidate, count = [], labels[0], None, 0
    for x in labels:
        if x == now:
            candidate, count = None, 0
        elif x == candidate:
            count += 1
        else:
            candidate, count = x, 1
        if candidate is not None and count >= debounce:
            now, candidate, count = candidate, None, 0
        out.append(now)
    return out


def test_debounce_equals_the_fold(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for k in range(60):
        labels = [rng.choice("abc") if rng.random() < 0.5 else "a" for _ in range(25)]
        rows += [(k, t, x) for t, x in enumerate(labels)]
        want[k] = fold(labels, 3)
    df = spark.createDataFrame(rows, "key int, step int, label string")
    smooth = ownership.debounced(df, 3, "key")
    got = {}
    for r in smooth.orderBy("key", "step").collect():
        got.setdefault(r["key"], []).append(r["smooth"])
    assert got == want
    spans = ownership.windows(smooth, "key").where("key = 0").orderBy("from_step").collect()
    assert [x for s in spans for x in [s["label"]] * (s["to_step"] - s["from_step"] + 1)] == want[0]


def test_transforms_ranges(spark):
    rows = [(1, y, x, 1.0) for y in range(8) for x in range(8)] + [(2, 3, 3, 5.0)]
    df = spark.createDataFrame(rows, "entity int, y int, x int, value double")
    got = {r["entity"]: r for r in fields.transforms(df, 8, "entity").collect()}
    assert got[1]["spectral_entropy"] < 1e-6 < got[2]["spectral_entropy"] <= 1 and 0 < got[1]["png_compressibility"] <= 1.5
    e = {r["entity"]: r["spatial_entropy"] for r in fields.coarse_entropy(df, 8, "entity").collect()}
    assert abs(e[1] - 1) < 1e-12 and e[2] == 0


GOOD = {"name": "a", "grid": [64, 96], "steps": 20, "snapshot_every": 5, "border": "wall", "output_format": "gif", "spawn": {"min_dist": 20, "patch": 6, "seed": 0}, "sources": [{"run": "r", "creature_id": "r-1", "n": 2}, {"run": "r", "cell": [1, 2, 3], "n": 1, "patch": 4}]}


@pytest.mark.parametrize("change", [{"name": " "}, {"grid": 0}, {"grid": [1]}, {"grid": "x"}, {"steps": True}, {"steps": 4}, {"border": "x"}, {"output_format": "x"}, {"spawn": {}}, {"sources": []}, {"sources": [{"run": "r", "n": 1}]}, {"sources": [{"run": "r", "n": 0, "creature_id": "x"}]}, {"sources": [{"run": "r", "n": 1, "cell": [1, 2, -3]}]}])
def test_bad_experiments_are_refused(change):
    with pytest.raises(config.ConfigError):
        config.parse({"experiments": [GOOD | change]})


def test_experiments_join_the_archive(spark, tmp_path):
    import yaml

    path = tmp_path / "e.yaml"
    path.write_text(yaml.safe_dump({"experiments": [GOOD, GOOD | {"name": "b", "sources": GOOD["sources"][:1]}]}))
    frame = config.experiments(spark, config.load(str(path)))
    assert {r["name"]: r["mode"] for r in frame.collect()} == {"a": "heterogeneous", "b": "homogeneous"}
    archive = spark.createDataFrame([("r-1", True, 10)], "creature_id string, has_signal boolean, kernels int")
    rows = config.with_sources(frame, archive).collect()
    assert sorted((r["name"], r["species"], r["found"], r["patch"]) for r in rows) == [("a", 0, True, 6), ("a", 1, False, 4), ("b", 0, True, 6)]
    with pytest.raises(config.ConfigError):
        config.parse({"experiments": [GOOD, GOOD]})


def test_logs_documents_and_artifacts(spark, tmp_path):
    good = {"run_id": "r", "seed": 1, "quality": 0.5, "insertion_status": "inserted", "created_at": 2.0}
    (tmp_path / "log.jsonl").write_text("\n".join([json.dumps(good), "{broken", json.dumps(good | {"seed": 2})]))
    events = tables.read_events(spark, str(tmp_path / "log.jsonl"))
    assert sorted(r["seed"] for r in events.collect()) == [1, 2]
    tables.append_events(events, f"{tmp_path}/out")
    tables.append_events(events.withColumn("thumb", F.lit(b"x")), f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").count() == 4
    doc = tables.summary_json(spark.createDataFrame([("a", float("inf"), [1.0, float("nan")])], "name string, x double, v array<double>"), "name").first()["document"]
    assert json.loads(doc) == {"name": "a", "x": None, "v": [1.0, None]}
    tables.write_artifacts(spark.createDataFrame([("p/q.bin", b"abc")], "path string, content binary"), str(tmp_path / "art"))
    assert (tmp_path / "art/p/q.bin").read_bytes() == b"abc"
    for n in (1, 2):
        tables.checkpoint_table(spark.range(n), f"{tmp_path}/ck")
        assert tables.read_checkpoint(spark, f"{tmp_path}/ck").count() == n
    assert tables.latest(spark, str(tmp_path), "*.bin").endswith("/p")
    gpu = tables.parse_gpu_csv(spark.createDataFrame([("0, RTX, 55, [N/A], 100, 200, 60, 70.5, 200, 1, 2, P0, [N/A]",)], "value string")).first()
    assert gpu["utilization"] == 55.0 and gpu["memory_utilization"] is None and gpu["fan"] is None and gpu["pstate"] == "P0"


def test_streams_equal_batches(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    batch = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = stream.drain(stream.tumbling(stream.read(spark, data)), "tumble", f"{tmp_path}/c1", "complete")
    key = lambda df: sorted((str(r["start"]), r["event_type"], r["n"]) for r in df.collect())
    assert key(got) == key(stream.tumbling(batch))
    rows = lambda e: e.select((F.col("user_id") % 3).alias("run_id"), (F.col("event_id") % 5).alias("cell"), (F.col("value") / 100).alias("quality"), F.col("event_id").alias("arrival"))
    out = stream.drain(stream.archive(rows(stream.read(spark, data))), "arch", f"{tmp_path}/c2").groupBy("run_id", "cell").agg(F.max("quality").alias("q")).collect()
    want = rows(batch).groupBy("run_id", "cell").agg(F.max("quality").alias("q")).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, want))


def test_search_fills_an_archive(spark):
    events, best = search.search(spark, simulation.World(24, 24, 8, 3), budget=12, calibration=6, cells=8, batch=6, random_phase=6)
    assert events.count() == 12 and set(r["status"] for r in events.collect()) <= set(A.STATUSES)
    assert best.count() <= 8


def test_small_functions(spark):
    assert text.cluster_address("h") == "h:6379" and text.cluster_address("ray://h:1") == "ray://h:1" and text.cluster_address(None) is None
    assert metrics.progress(0, 5, 1.0) is None and metrics.progress(2, 6, 4.0) == 8.0
    row = spark.range(1).select(text.run_of(F.lit("a-b-12")).alias("run"), text.number_or_null(F.lit("[N/A]")).alias("n"), text.finite_or_null(F.lit(float("inf"))).alias("f"), vectors.upper_median(F.array(*[F.lit(x) for x in (4, 1, 3, 2)])).alias("m"), vectors.dot(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(2.0))).alias("d"), text.data_url(F.lit(b"a")).alias("u"), text.frame_path(F.lit("f"), F.lit(7)).alias("p")).first()
    assert tuple(row) == ("a-b", None, None, 3, 0.0, "data:image/png;base64,YQ==", "f/00007")
    yaml = pairs.experiment_yaml(spark.createDataFrame([("pursuit", 1, 3, 4)], "mode string, rank int, id_a int, id_b int")).first()["yaml"]
    assert yaml.startswith("  - name: pursuit-3-4\n")
