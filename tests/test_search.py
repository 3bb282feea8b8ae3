import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella import cli
from tessella.functions import params as P
from tessella.operators import archive as A
from tessella.operators import descriptors as D
from tessella.operators import search as S
from tessella.operators import series, simulation, views
from tessella.sources import config, tables
from tessella.streaming import events as stream

WORLD = simulation.World(24, 24, 104, 2)


@pytest.mark.parametrize("signal", [False, True])
def test_stacked_lanes_equal_one_rollout_after_another(spark, signal):
    world = simulation.World(20, 20, 12, 3)
    records = P.population(P.seeds(spark, 5, 5), 3, signal)
    key = lambda df: df.orderBy("seed", "step").toPandas()
    one, many = (key(simulation.rollouts(records.coalesce(1), world, signal, lanes=n)) for n in (1, 3))
    assert len(one) == 5 * 13 and np.allclose(one.to_numpy(float), many.to_numpy(float), equal_nan=True, rtol=1e-9, atol=1e-9)
    kind = simulation.Species(P.draw(6, 3, signal), world)
    now = simulation.State(simulation.first_mass(world, 6), None, simulation.first_signal(world, 6) if signal else None)
    for t in range(1, 13):
        now = simulation.step(world, [kind], now)
        row = one[(one["seed"] == 6) & (one["step"] == t)].iloc[0]
        assert abs(row["mass"] - now.mass.sum()) < 1e-8 and abs(row["signal_total"] - (now.signal.sum() if signal else 0)) < 1e-8


def test_a_thousand_steps_keep_their_mass():
    world = simulation.World(48, 48, 1000, 4)
    kind = simulation.Lanes([P.draw(11, 4, False)], world)
    first = mass = simulation.first_mass(world, 11)[None]
    for _ in range(1000):
        mass, _ = kind.step(mass, None)
    assert abs(mass.sum() / first.sum() - 1) < 2.5e-4


def test_descriptors_are_three_known_ones(tmp_path):
    assert [d.key for d in D.resolve(D.DEFAULT)] == list(D.DEFAULT) and len(D.REGISTRY) == 18
    for names, signal in ((("velocity", "gyradius"), False), (("velocity", "velocity", "gyradius"), False), (("velocity", "gyradius", "nothing"), True), (("velocity", "gyradius", "signal_mass_ratio"), False)):
        with pytest.raises(ValueError):
            D.resolve(names, signal)
    assert D.resolve(("velocity", "gyradius", "signal_mass_ratio"), True)[2].signal_only
    assert D.metadata("spectral_entropy").label == "spectral entropy" and D.metadata("odd_one").label == "odd one"
    (tmp_path / "mine.py").write_text("from pyspark.sql import functions as F\nDESCRIPTORS = [('mean_box', F.avg('bbox'))]\n")
    (tmp_path / "bad.py").write_text("DESCRIPTORS = [('x', 3)]\n")
    (tmp_path / "none.py").write_text("x = 1\n")
    assert D.load_module(str(tmp_path / "mine.py")) == ["mean_box"]
    assert D.resolve(("velocity", "gyradius", "mean_box"))[2].source == D.USER
    for name in ("bad", "none"):
        with pytest.raises(TypeError):
            D.load_module(str(tmp_path / f"{name}.py"))
    series.REGISTRY.pop("mean_box")


def test_axes_come_from_tails_and_final_fields(spark):
    records = P.population(P.seeds(spark, 0, 4), 2, True)
    trace = tables.stage(simulation.rollouts(records, WORLD, True, lanes=2, capture=True), "trace")
    rows = trace.toPandas()
    got = D.describe(trace, WORLD, ("gyradius", "spatial_entropy", "dominant_channel_fraction"), True).toPandas().set_index("seed")
    moving = D.describe(trace, WORLD, ("velocity", "oscillation", "compactness"), True).toPandas().set_index("seed")
    for seed, r in rows.groupby("seed"):
        r = r.sort_values("step")
        last = r.iloc[-1]
        assert r["field"].notna().sum() == 1 and len(last["field"]) == 24 * 24 and abs(sum(last["field"]) - last["mass"]) < 1e-6
        blocks = np.array(last["field"]).reshape(8, 3, 8, 3).sum(axis=(1, 3)).ravel()
        p = blocks[blocks > 0] / blocks.sum()
        assert abs(got.loc[seed, "d0"] - min(last["gyradius"], 100)) < 1e-9
        assert abs(got.loc[seed, "d1"] + (p * np.log(p)).sum() / np.log(64)) < 1e-6
        assert abs(got.loc[seed, "d2"] - max(last["channels"]) / sum(last["channels"])) < 1e-9
        assert got.loc[seed, "drift"] == 0 and got.loc[seed, "n_steps"] == 105
        at = r[["com_y", "com_x"]].to_numpy()
        speed = lambda part: np.hypot(*np.diff(part, axis=0).T).mean()
        box = r["bbox"].to_numpy()
        want = max(abs(speed(at[-50:]) - speed(at[-100:-50])), abs(box[-50:].var() - box[-100:-50].var()))
        assert abs(moving.loc[seed, "d0"] - speed(at[-50:])) < 1e-9 and abs(moving.loc[seed, "drift"] - want) < 1e-9


@pytest.mark.parametrize("change", [{"budget": 0}, {"batch": 0}, {"workers": True}, {"random_phase": -1}, {"descriptors": ("velocity",)}, {"descriptors": ("velocity", "gyradius", "signal_mass_ratio")}])
def test_bad_settings_are_refused(change):
    with pytest.raises(ValueError):
        S.SearchConfig(**change)


def test_a_search_folds_each_generation_once(spark, tmp_path):
    told = []
    config = S.SearchConfig(budget=12, random_phase=4, batch=2, workers=2, calibration=6, cells=5, checkpoint_every=5, epsilon=0.0, descriptors=("gyradius", "spectral_entropy", "signal_mass_ratio"), signal=True)
    events, best = S.search(spark, WORLD, config, back=told.append, checkpoint=f"{tmp_path}/cells")
    rows = sorted(events.collect(), key=lambda r: r["arrival"])
    assert [r["arrival"] for r in rows] == list(range(12)) and [t["done"] for t in told] == [4, 8, 12]
    held = {}
    for r in rows:
        if r["quality"] is None or r["d0"] is None:
            assert r["status"] == A.REJECTED_FILTER
        elif r["cell"] not in held or r["quality"] > held[r["cell"]]:
            assert r["status"] == (A.REPLACED if r["cell"] in held else A.INSERTED)
            held[r["cell"]] = r["quality"]
        else:
            assert r["status"] == A.REJECTED_QUALITY
    assert {r["cell"]: r["quality"] for r in best.collect()} == held == {r["cell"]: r["quality"] for r in tables.read_checkpoint(spark, f"{tmp_path}/cells").collect()}
    assert all(r["parent"] is None for r in rows[:4]) and told[-1]["occupied"] == len(held)


def test_histories_and_signals_agree_with_snapshots(spark):
    made = P.population(spark.range(2).withColumnRenamed("id", "seed"), 2, True).withColumnRenamed("seed", "species")
    rows = tables.stage(made.withColumns({"name": F.lit("e"), "n": F.lit(2), "patch": F.lit(4), "min_dist": F.lit(6), "seed": F.lit(3).cast("long"), "snapshot_every": F.lit(4)}), "eco")
    world = simulation.World(24, 24, 10, 2)
    history = simulation.ecosystem_histories(rows, world, True).toPandas()
    snaps = simulation.ecosystems(rows, world, True).toPandas()
    signals = simulation.ecosystem_signals(rows, world).toPandas()
    assert sorted(history["step"].unique()) == list(range(11)) and sorted(signals["step"].unique()) == [4, 8, 10]
    for (t, k), part in snaps.assign(own=snaps["w"] * snaps["m"]).groupby(["step", "species"]):
        row = history[(history["step"] == t) & (history["species"] == k)].iloc[0]
        assert abs(row["mass"] - part["own"].sum()) < 1e-4 and abs(row["territory"] - part["w"].sum()) < 1e-3
    total = history.groupby("step")["signal_total"].first()
    for t, part in signals[signals["species"] == 0].groupby("step"):
        assert len(part) == P.CHANNELS and abs(part["mean"].sum() * 24 * 24 - total[t]) < 1e-6 * (1 + total[t])
    assert simulation.trajectories(rows, world, True).groupBy("step").agg(F.sum("m")).count() == 3


def test_checkpoints_indexes_and_documents(spark, tmp_path):
    path = f"{tmp_path}/table"
    assert tables.read_checkpoint(spark, path) is None
    for n in (3, 5, 2):
        tables.checkpoint_table(spark.range(n), path)
        assert tables.read_checkpoint(spark, path).count() == n
    reader = tables.read_checkpoint(spark, path)
    tables.checkpoint_table(spark.range(9), path)
    assert reader.count() == 2
    found = spark.createDataFrame([("a", 1), ("b", 1)], "key string, modified int")
    build = lambda todo: todo.withColumn("n", F.length("key") + F.col("modified"))
    first = tables.incremental(found, f"{tmp_path}/index", build)
    assert sorted(map(tuple, first.collect())) == [("a", 1, 2), ("b", 1, 2)]
    seen = []
    again = tables.incremental(spark.createDataFrame([("b", 3), ("c", 1)], "key string, modified int"), f"{tmp_path}/index", lambda todo: build(todo) if seen.append(sorted(r["key"] for r in todo.collect())) is None else None)
    assert seen == [["b", "c"]] and sorted(map(tuple, again.collect())) == [("b", 3, 4), ("c", 1, 2)]
    long = {"items": list(range(5000))}
    (tmp_path / "doc.json").write_text(json.dumps(long, indent=1))
    assert len(tables.merge_document(spark, f"{tmp_path}/doc.json", {"x": 1})["items"]) == 5000
    events = spark.createDataFrame([(2, 3.0), (1, None), (3, 1.0)], "completed_count int, created_at double")
    assert [r["completed_count"] for r in tables.in_order(events).collect()] == [1, 3, 2]


def test_archives_are_found_and_joined_by_cell(spark, tmp_path):
    spark.range(1).write.parquet(f"{tmp_path}/runs/r1/archive")
    for path in ("runs/r1/archive", "runs/r1", "runs"):
        assert A.located(spark, f"{tmp_path}/{path}").endswith("runs/r1/archive")
    spark.range(1).write.parquet(f"{tmp_path}/runs/r2/archive")
    for path in ("runs", "nowhere"):
        with pytest.raises(FileNotFoundError):
            A.located(spark, f"{tmp_path}/{path}")
    raw = {"name": "a", "grid": 32, "steps": 10, "snapshot_every": 5, "border": "wall", "output_format": "gif", "spawn": {"min_dist": 4, "patch": 4, "seed": 0}, "sources": [{"run": "r1", "cell": [1, 2, 3], "n": 1}, {"run": "r1", "creature_id": "r1-9", "n": 1}]}
    frame = config.experiments(spark, config.parse({"experiments": [raw]}))
    known = spark.createDataFrame([("r1", [1, 2, 3], "r1-5", 1.0)], "run_id string, coordinates array<int>, creature_id string, r double")
    rows = sorted(config.with_sources(frame, known).collect(), key=lambda r: r["species"])
    assert [(r["creature_id"], r["found"]) for r in rows] == [("r1-5", True), ("r1-9", False)]
    with pytest.raises(config.ConfigError, match="r1-9"):
        config.require_found(config.with_sources(frame, known))


def test_late_rows_progress_and_generations(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-01 00:10:00", 5, "a", 1.0, None), (2, "2024-01-01 03:00:00", 5, "a", 2.0, None), (3, "2024-01-01 03:30:00", 5, "a", 2.0, None), (4, "2024-01-01 00:20:00", 5, "a", 4.0, None)], "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for i in (1, 2, 3, 4):  # the fourth is late by more than the watermark of an hour
        rows.where(F.col("event_id") == i).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    import os
    import shutil

    os.makedirs(f"{tmp_path}/flat")
    seen = []
    listener = stream.Progress(lambda name, m: seen.append((name, m["rows"])))
    spark.streams.addListener(listener)
    for i in (1, 2, 3, 4):
        part = next(f for f in os.listdir(f"{tmp_path}/in/{i}") if f.endswith(".parquet"))
        shutil.copy(f"{tmp_path}/in/{i}/{part}", f"{tmp_path}/flat/{i}.parquet")
        os.utime(f"{tmp_path}/flat/{i}.parquet", (1000 * i, 1000 * i))
    source = stream.read(spark, f"{tmp_path}/flat", "*.parquet")
    out = stream.drain(stream.tumbling(stream.observed(source, "in"), late="1 hour"), "late", f"{tmp_path}/c").collect()
    assert [(r["n"], r["total"]) for r in out] == [(1, 1.0)]
    spark.streams.removeListener(listener)
    counts = []
    stream.generations(source, lambda batch, number: counts.append((number, batch.count())), f"{tmp_path}/g")
    assert counts == [(0, 1), (1, 1), (2, 1), (3, 1)] and ("in", 1) in seen


def test_views(spark):
    best = spark.createDataFrame([("r", 2, 0.4, 1.0, 0.0, 0.0, 3), ("r", 0, 0.2, 9.0, 0.0, 0.0, 1)], "run_id string, cell long, quality double, d0 double, d1 double, d2 double, arrival long")
    centres = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (2, 1.0, 1.0, 1.0)], "idx long, c0 double, c1 double, c2 double")
    document = json.loads(views.page(best, centres).first()["document"])
    assert [c["cell"] for c in document] == [0, 2] and document[1]["quality"] == 0.4
    assert [r["colour"] for r in spark.createDataFrame([(-1.0,), (0.4,), (1.0,)], "v double").select(views.colour(F.col("v"), ["a", "b", "c"]).alias("colour")).collect()] == ["a", "b", "c"]


def test_commands(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "connect", lambda args: spark)
    assert cli.main(["doctor"]) == 0 and "ok   job" in capsys.readouterr().out
    common = ["search", "--preset", "dev", "--grid", "24", "--steps", "104", "--budget", "6", "--random-phase", "6", "--batch-size", "3", "--workers", "2", "--calibration", "4", "--centroids", "4", "--output-dir", f"{tmp_path}/archive"]
    assert cli.main([*common, "--run-id", "one", "--descriptors", "velocity,gyradius,compactness"]) == 0
    assert "6/6 done" in capsys.readouterr().out
    root = f"{tmp_path}/archive/one"
    assert spark.read.json(f"{root}/events").count() == 6 and tables.read_document(spark, f"{root}/manifest", "run_id string, budget int").where("run_id = 'one'").count() >= 1
    assert cli.main([*common, "--descriptors", "velocity"]) == 2 and "error" in capsys.readouterr().err
    made = P.population(P.seeds(spark, 0, 2), 3).withColumns({"run_id": F.lit("two"), "creature_id": F.concat(F.lit("two-"), F.col("seed").cast("string")), "has_signal": F.lit(False), "arrival": F.col("seed")}).drop("seed")
    made.write.parquet(f"{tmp_path}/archive/two/archive")
    experiment = lambda name, sources: {"name": name, "grid": 24, "steps": 8, "snapshot_every": 4, "border": "torus", "output_format": "gif", "spawn": {"min_dist": 5, "patch": 4, "seed": 1}, "sources": sources}
    document = {"experiments": [experiment("both", [{"run": "two", "creature_id": f"two-{i}", "n": 2} for i in range(2)]), experiment("same", [{"run": "two", "creature_id": "two-0", "n": 3}]), experiment("lost", [{"run": "two", "creature_id": "two-9", "n": 1}])]}
    (tmp_path / "e.yaml").write_text(json.dumps(document))
    assert cli.main(["ecosystem", "--config", f"{tmp_path}/e.yaml", "--archive-dir", f"{tmp_path}/archive", "--output-dir", f"{tmp_path}/eco"]) == 1
    said = capsys.readouterr()
    assert "lost: failed" in said.err and "both: done" in said.out and "same: done" in said.out
    both = json.loads(spark.read.text(f"{tmp_path}/eco/both/summary").first()["value"])
    assert both["name"] == "both" and len(both["interaction"]) == 4 and both["final_label"] and len(both["snapshots"]) == 4
    assert spark.read.parquet(f"{tmp_path}/eco/same/history").count() == 9
