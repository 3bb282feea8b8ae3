"""The archive as streaming state against a loop over candidates, over restarts."""

import random
import time

import numpy as np

from tessella.operators.archive import INSERTED, REPLACED
from tessella.streaming import events as stream
from tessella.streaming import state as S

SCHEMA = "run_id long, cell long, quality double, arrival long, d0 double"


def feed(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def loop(batches):
    held, out = {}, []
    for rows in batches:
        for run, cell, q, arrival, d0 in sorted(rows, key=lambda r: r[3]):
            if cell is None or q is None or d0 is None:
                continue
            if (run, cell) not in held or q > held[run, cell]:
                out.append((run, cell, q, arrival, REPLACED if (run, cell) in held else INSERTED))
                held[run, cell] = q
    return sorted(out, key=str)


def test_restarts_go_on_from_the_checkpoint(spark, tmp_path):
    rng = random.Random(3)
    make = lambda first, n: [(rng.choice([1, 1, 1, 2, None]), rng.choice([0, 1, 2, None]), rng.choice([None, *[round(rng.random(), 3)] * 9]), first + i, rng.choice([None, 1.0, 1.0, 1.0])) for i in range(n)]
    batches, got = [make(0, 200), make(100, 150), make(-50, 40)], None
    before = spark.conf.get(S.PROVIDER)
    for k, rows in enumerate(batches):
        rng.shuffle(rows)
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        # each run is a new query on the checkpoint of the one before
        got = stream.drain(stream.archive(feed(spark, tmp_path / "in")), f"restart-{tmp_path.name}", f"{tmp_path}/ck")
        assert sorted(map(tuple, got.collect()), key=str) == loop(batches[: k + 1])
    assert spark.conf.get(S.PROVIDER) == before and got.columns == ["run_id", "cell", "quality", "arrival", "status"]


def test_records_of_parts_hold_those_of_the_whole():
    rng = np.random.default_rng(1)
    arrival, quality = rng.permutation(500), rng.integers(0, 60, 500) / 60
    a, q = np.empty(0, np.int64), np.empty(0)
    for part in np.array_split(np.arange(500), 11):
        a, q = S.records(np.concatenate([a, arrival[part]]), np.concatenate([q, quality[part]]))
        assert len(a) <= 60
    whole = S.records(arrival, quality)
    assert (a == whole[0]).all() and (q == whole[1]).all() and (np.diff(q) > 0).all() and (np.diff(a) > 0).all()


def test_state_ends_after_its_time(spark, tmp_path):
    for k, wait in enumerate((0, 3)):
        time.sleep(wait)
        spark.createDataFrame([(1, 1, 0.9 - 0.1 * k, k, 1.0)], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = stream.drain(S.archive(feed(spark, tmp_path / "in"), ttl_ms=1500), f"ttl-{tmp_path.name}", f"{tmp_path}/ck", idle=False)
    assert [r["status"] for r in got.orderBy("arrival").collect()] == [INSERTED, INSERTED]  # the second cell was free again


def test_no_candidates(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    got = stream.drain(stream.archive(feed(spark, tmp_path / "in").drop("d0")), f"none-{tmp_path.name}", f"{tmp_path}/ck")
    assert got.count() == 0
