"""Streams of events: windows in event time, the archive as state, a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pyspark.sql.streaming.listener import StreamingQueryListener

from tessella.sources.tables import shared_dir
from tessella.streaming.state import archive, settings

__all__ = ["archive", "drain", "generations", "log", "observed", "Progress", "read", "sessions", "sliding", "tumbling"]

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def read(spark: SparkSession, folder: str, pattern: str = "events.parquet", files_a_trigger: int = 1) -> DataFrame:
    """The event files of a folder as a stream, with a timestamp that watermarks accept."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 hours", slide: str = "1 hour", late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", size, slide)).agg(F.count("*").alias("n"), F.max("value").alias("most")).select(F.col("window.start").alias("start"), "n", "most")


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", late: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), key, "n", "total")


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append", idle: bool = True) -> DataFrame:
    """Run a stream over what there is and give its rows back as a table of Parquet files.

    Appended rows are written by the file sink; in other modes each batch
    replaces the table, so the last state stays. State is in RocksDB.
    Without ``idle`` no batch runs without data; so watermarks flush nothing at the end.
    """
    spark, path = stream.sparkSession, f"{shared_dir(stream.sparkSession)}/{name}-rows"
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", path)
    else:
        writer = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(path))
    with settings(spark, idle):
        query = writer.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def generations(candidates: DataFrame, fold, checkpoint: str) -> None:
    """Run ``fold(rows, number)`` on each micro-batch of candidates, in order: a search that is fed by a stream."""
    candidates.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def observed(stream: DataFrame, name: str) -> DataFrame:
    """``stream`` with the metrics rows, accepted and best of each micro-batch, for Progress."""
    accepted = F.count_if(F.col("status").isin("inserted", "replaced")) if "status" in stream.columns else F.lit(0)
    best = F.max("quality") if "quality" in stream.columns else F.lit(None).cast("double")
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), accepted.alias("accepted"), best.alias("best"))


class Progress(StreamingQueryListener):
    """Calls ``back(name, metrics)`` with each micro-batch's observed metrics."""

    def __init__(self, back):
        self.back = back

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            self.back(name, row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def log(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream to a JSON log; exactly once by the sink's own commit log."""
    return stream.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
