import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.operators import cards
from tessella.sources import tables
from tessella.sources.telemetry import Telemetry
from tessella.streaming import events as stream


def test_run_cards(spark):
    configs = spark.createDataFrame([("a", 96), ("b", 100)], "run string, grid int")
    totals = spark.createDataFrame([("a", 10, 0.25)], "run string, n long, insertion_share double")
    fills = spark.createDataFrame([("a", 4, 0.5)], "run string, occupied long, fill double")
    got = sorted(map(tuple, cards.run_cards(totals, fills, configs, "run").collect()))
    assert got == [("a", "dev", 10, 25.0, 4, 50.0), ("b", "custom", 0, 0.0, 0, 0.0)]


def test_ecosystem_cards_of_old_and_new_summaries(spark):
    kind = "name string, grid int, n_creatures int, sources array<struct<creature_id:string,run_id:string,cell:array<int>,n:int,patch:int>>, patch int, signal_total_history array<double>"
    rows = [("x", 64, 3, None, 5, [0.0]), ("y", 32, None, [("r-1", "r", None, 2, None), (None, "q", [1, 2, 3], 1, 7)], 5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, kind)
    got = {r["name"]: r for r in cards.ecosystem_cards(df).collect()}
    assert got["x"]["creatures"] == 3 and got["x"]["grid_h"] == 64 and not got["x"]["has_signal"]
    assert got["y"]["creatures"] == 3 and got["y"]["mode"] == "heterogeneous" and got["y"]["has_signal"]
    y = cards.resolved(df).where("name = 'y'").select("sources", cards.source_names(F.col("sources")).alias("names")).first()
    assert y["names"] == ["r-1", "q[1,2,3]"] and [s["patch"] for s in y["sources"]] == [5, 7]


def test_frames_and_snapshots(spark):
    steps = spark.range(0, 103).select(F.col("id").alias("step"))
    assert sorted(r["step"] for r in cards.sampled_frames(steps, 5).collect()) == [0, 26, 51, 77, 102]
    assert sorted(r["step"] for r in cards.snapshots(steps, 40).collect()) == [0, 40, 80, 102]
    q = cards.quantised(np.arange(64.0).reshape(8, 8), 4)
    assert q.shape == (4, 4) and q.max() == 255 and q[0, 0] < q[3, 3]
    with pytest.raises(ValueError):
        cards.require_signal(["velocity", "signal_mass_ratio"], False)


def test_a_failing_group_is_isolated(spark):
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["v"].min() < 0:
            raise RuntimeError("negative")
        return pd.DataFrame({"k": [pdf["k"].iloc[0]], "total": [int(pdf["v"].sum())]})

    df = spark.createDataFrame([(1, 5), (1, 6), (2, -1)], "k long, v long")
    done = cards.isolated(df, "k", work, "k long, total long")
    assert {(r["k"], r["total"], r["error"]) for r in done.collect()} == {(1, 11, None), (2, None, "RuntimeError: negative")}
    sent = spark.createDataFrame([(3, 0), (2, 1), (1, 2)], "k long, submission int")
    assert [(r["k"], r["state"]) for r in cards.dispatched(sent, done, "k").collect()] == [(3, "lost"), (2, "failed"), (1, "done")]


def test_telemetry_stream_and_documents(spark, tmp_path):
    spark.dataSource.register(Telemetry)
    rows = spark.readStream.format("telemetry").option("hosts", "a,b").option("devices", "2").load()
    query = rows.writeStream.format("memory").queryName("tele").option("checkpointLocation", f"{tmp_path}/c").trigger(once=True).start()
    query.awaitTermination()
    got = tables.parse_gpu_csv(spark.table("tele"), "line")
    assert got.count() == 16 and got.where("memory_utilization is not null").count() == 0
    tables.write_document({"run": "r", "fn": print}, spark, f"{tmp_path}/m")
    assert tables.merge_document(spark, f"{tmp_path}/m", {"survivors": 3}) == {"run": "r", "survivors": 3}
    assert tables.merge_document(spark, f"{tmp_path}/none", {"a": 1}) == {"a": 1}
    assert stream.EVENTS.names[0] == "event_id"


def test_creature_cards_round_every_number_and_keep_the_rest(spark):
    rows = [
        ("x", 7, 12.3456789, [[0.123456, None], []], 0.00123456, [0.12345678, None, -2.00000049], 0.98765, 1.23456, "note"),
        ("y", 8, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "creature_id string, seed long, radius double, a array<array<double>>, emission_rate double, descriptors array<double>, quality double, compute_seconds double, `odd.name` string")
    out = cards.creature_cards(df)
    assert out.columns == df.columns
    got = {r["creature_id"]: tuple(r) for r in out.collect()}
    assert got["x"] == ("x", 7, 12.3456789, [[0.1235, None], []], 0.00123, [0.123457, None, -2.0], 0.9877, 1.235, "note")
    assert got["y"] == rows[1] and cards.creature_cards(df.limit(0)).count() == 0
