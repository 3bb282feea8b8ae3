"""The telemetry source: a task a host, restarts, failing hosts, live ticks."""

import time

import pytest
from pyspark.sql import functions as F

from tessella.sources.telemetry import Stretch, Telemetry, Ticks

released = []


def collected(host, first, last):
    if host == "down":
        yield first, "0, seen before it failed"
        raise OSError("no answer")
    for tick in range(first, last):
        yield tick, f"1, {host}-{tick}"


def let_go(hosts, tick):
    released.append((tuple(hosts), tick))


@pytest.fixture
def source(spark):
    spark.dataSource.register(Telemetry)
    return lambda **options: spark.readStream.format("telemetry").options(hosts="a, b,c", devices="2", **{k: str(v) for k, v in options.items()}).load()


def test_a_task_a_host(spark, source, tmp_path):
    seen = []

    def look(batch, number):
        rows = batch.withColumn("task", F.spark_partition_id()).groupBy("hostname").agg(F.collect_set("task").alias("tasks"), F.count("*").alias("n")).collect()
        seen.append({r["hostname"]: (tuple(sorted(r["tasks"])), r["n"]) for r in rows})

    source(until=5).writeStream.foreachBatch(look).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert seen == [{"a": ((0,), 10), "b": ((1,), 10), "c": ((2,), 10)}]
    source(until=12, chunk=3).writeStream.foreachBatch(look).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert {h: (len(t), n) for h, (t, n) in seen[1].items()} == {h: (3, 14) for h in "abc"}  # only the new ticks, in chunks


def test_replays_repeat_nothing(spark, source, tmp_path):
    def run(until):
        source(until=until).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        return sorted((r["hostname"], r["tick"], r["gpu_index"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    want = lambda n: sorted((h, t, d) for h in "abc" for t in range(n) for d in range(2))
    assert run(4) == want(4)
    for name in ("0", ".0.crc"):  # died after the batch was written and before that was noted
        (tmp_path / "c/commits" / name).unlink(missing_ok=True)
    assert run(6) in (want(4), want(6))  # Spark may end a run after the batch that it repeats
    assert run(6) == want(6)


def test_a_batch_that_failed_is_the_same_batch_again(source, tmp_path):
    taken = []

    def look(batch, number):
        taken.append((number, sorted((r["hostname"], r["tick"], r["line"]) for r in batch.collect())))
        if len(taken) == 1:
            raise RuntimeError("first attempt")

    start = lambda until: source(until=until).writeStream.foreachBatch(look).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="first attempt"):
        start(3).awaitTermination()
    for _ in range(2):  # Spark may end a run after the batch that it repeats
        start(9).awaitTermination()
    assert taken[0] == taken[1] and [n for n, _ in taken] == [0, 0, 1]
    assert {t for _, t, _ in taken[1][1]} == {0, 1, 2} and {t for _, t, _ in taken[2][1]} == set(range(3, 9))


def test_probes_failures_and_release():
    reader = Ticks({"hosts": "a,down", "until": "3", "probe": f"{__name__}:collected", "release": f"{__name__}:let_go"})
    parts = reader.partitions(reader.initialOffset(), reader.latestOffset())
    assert parts == [Stretch("a", 0, 3), Stretch("down", 0, 3)] and reader.partitions({"tick": 3}, {"tick": 3}) == []
    rows = [list(reader.read(p)) for p in parts]
    assert rows[0] == [("a", t, 1, f"1, a-{t}", None) for t in range(3)]
    assert rows[1][0][3] == "0, seen before it failed" and rows[1][1] == ("down", 0, None, None, "OSError: no answer")
    reader.commit({"tick": 3})
    assert released == [(("a", "down"), 3)]


def test_live_ticks_follow_the_clock():
    reader = Ticks({"hosts": "a", "interval_ms": "50"})
    start = reader.initialOffset()
    time.sleep(0.2)
    end = reader.latestOffset()
    assert 3 <= end["tick"] - start["tick"] <= 60 and [p.host for p in reader.partitions(start, end)] == ["a"]
