"""Device samples of many hosts as a streaming source, a task a host.

``spark.dataSource.register(Telemetry)`` and then
``spark.readStream.format("telemetry").option("hosts", "a,b").option("devices", 2).load()``.

Offsets are ticks: with ``interval_ms`` those of the clock, from the start of the
query on; without it the ticks up to ``until``, which tests and replays of a known
range use. A micro-batch has one partition for each host and ``chunk`` ticks, read
by the executors, so a long gap is caught up by many tasks. Equal offsets give
equal partitions, so a batch that is repeated after a failure is the same batch,
and a sink that knows its batches (files, or an idempotent foreachBatch) takes it once.

``probe`` (module:function, importable by the executors) gets (host, first, last)
and returns (tick, line) pairs of the thirteen-field lines that the host's
collector kept for the ticks first <= tick < last; without it the lines come from
the tick alone. A probe that fails gives one row with ``error`` and does not end
the stream. ``release`` (module:function) gets (hosts, tick) on the driver when all
before the tick is done, so that collectors can drop it.
"""

from __future__ import annotations

import importlib
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "hostname string, tick long, gpu_index int, line string, error string"


class Telemetry(DataSource):
    @classmethod
    def name(cls) -> str:
        return "telemetry"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return Ticks(self.options)


@dataclass
class Stretch(InputPartition):
    """Ticks first <= tick < last of one host."""

    host: str
    first: int
    last: int


def named(path: str):
    module, _, function = path.partition(":")
    return getattr(importlib.import_module(module), function)


class Ticks(DataSourceStreamReader):
    def __init__(self, options):
        self.hosts = [h.strip() for h in options.get("hosts", "localhost").split(",") if h.strip()]
        self.devices = int(options.get("devices", "1"))
        self.until = int(options.get("until", "4"))
        self.interval_ms = int(options.get("interval_ms", "0"))
        self.chunk = max(1, int(options.get("chunk", "600")))
        self.probe, self.release = options.get("probe"), options.get("release")

    def now(self) -> int:
        return int(time.time() * 1000) // self.interval_ms

    def initialOffset(self) -> dict:
        return {"tick": self.now() if self.interval_ms else 0}

    def latestOffset(self) -> dict:
        return {"tick": self.now() if self.interval_ms else self.until}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        starts = range(start["tick"], end["tick"], self.chunk)
        return [Stretch(host, first, min(first + self.chunk, end["tick"])) for host in self.hosts for first in starts]

    def lines(self, at: Stretch) -> Iterator[tuple[int, str]]:
        if self.probe:
            yield from named(self.probe)(at.host, at.first, at.last)
            return
        for tick in range(at.first, at.last):
            for d in range(self.devices):
                yield tick, f"{d}, device, {(tick * 7 + d * 13) % 101}, [N/A], {1000 + tick}, 8192, 50, 100, 200, 1, 2, P0, [N/A]"

    def read(self, partition: Stretch) -> Iterator[tuple]:
        try:
            for tick, line in self.lines(partition):
                index = line.partition(",")[0].strip()
                yield partition.host, tick, int(index) if index.isdigit() else None, line, None
        except Exception as e:  # one host's failure is a row of that host, as its samples are
            yield partition.host, partition.first, None, None, f"{type(e).__name__}: {e}"

    def commit(self, end: dict) -> None:
        if self.release:
            named(self.release)(self.hosts, end["tick"])
