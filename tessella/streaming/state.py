"""The archive as streaming state, a cell of a run a key."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessella.operators.archive import INSERTED, REPLACED
from tessella.session import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
IDLE = "spark.sql.streaming.noDataMicroBatches.enabled"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Stands for a null run, which pandas would not tell to be one key.
NO_RUN = -(2**63) + 1


@contextmanager
def settings(spark: SparkSession, idle: bool = True):
    """Queries started inside keep their state in RocksDB, and run batches without data only if ``idle``; the session's settings are put back."""
    wanted = {PROVIDER: ROCKSDB, IDLE: str(idle).lower()}
    before = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def records(arrival: np.ndarray, quality: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows, in order of arrival, whose quality exceeds that of all earlier ones."""
    order = np.argsort(arrival, kind="stable")
    arrival, quality = arrival[order], quality[order]
    best = np.maximum.accumulate(np.concatenate([[-np.inf], quality]))[:-1]
    new = quality > best
    return arrival[new], quality[new]


class Cells(StatefulProcessor):
    """Accepted candidates (arrival, quality) of each (run, cell), against the best one before.

    Rows of a key come in frames without order. Of the frames so far only the
    records are held, since records of the whole are among the records of its
    parts; so memory follows what is emitted and not what is read.
    """

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getValueState("best", "quality double", self.ttl_ms) if self.ttl_ms else handle.getValueState("best", "quality double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrival, quality = np.empty(0, np.int64), np.empty(0)
        for frame in rows:
            arrival, quality = records(np.concatenate([arrival, frame["arrival"].to_numpy()]), np.concatenate([quality, frame["quality"].to_numpy()]))
        held = self.best.get()
        if held is not None:
            better = quality > held[0]
            arrival, quality = arrival[better], quality[better]
        if len(quality):
            self.best.update((float(quality[-1]),))
            status = [REPLACED] * len(quality)
            if held is None:
                status[0] = INSERTED
            yield pd.DataFrame({"run": key[0], "cell": key[1], "quality": quality, "arrival": arrival, "status": status})

    def close(self) -> None:
        pass


def archive(rows: DataFrame, key: str = "run_id", ttl_ms: int | None = None) -> DataFrame:
    """Accepted candidates of a stream of (key, cell, quality, arrival): key, cell, quality, arrival and status.

    In a micro-batch candidates are taken in order of arrival; one without a cell
    or a quality, or with a null d0 where there is such a column, is none. The
    state of a cell, its best quality, ends ``ttl_ms`` after its last update, if
    given; a search that is over then costs nothing. Needs RocksDB state, as
    drain() gives it; with ``ttl_ms`` a query that is to end runs no batches without
    data (drain(idle=False)), or it would wait for times that never cease.
    """
    ship(rows.sparkSession)
    if "d0" in rows.columns:
        rows = rows.where("d0 is not null")
    rows = rows.where("cell is not null and quality is not null and not isnan(quality)").selectExpr(f"coalesce(cast({key} as long), {NO_RUN}) as run", "cast(cell as long) as cell", "cast(quality as double) as quality", "cast(arrival as long) as arrival")
    found = rows.groupBy("run", "cell").transformWithStateInPandas(Cells(ttl_ms), "run long, cell long, quality double, arrival long, status string", "Append", "ProcessingTime" if ttl_ms else "None")
    return found.select(F.nullif("run", F.lit(NO_RUN)).alias(key), "cell", "quality", "arrival", "status")
