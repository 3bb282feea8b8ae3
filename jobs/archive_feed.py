"""archive feed: keep the archives of running searches up to date from their event logs.

    python -m jobs.archive_feed --input LOGS --output ARCHIVES --state STATE --config jobs/archive_feed.json

Searches append event files to LOGS. Each run of the job takes the files that it
has not seen, as a file stream with a checkpoint, and brings the archives of the
searches that they belong to up to date: of each cell of the behaviour space the
candidate of best quality, the first of equals. ARCHIVES is one Parquet table,
partitioned by run_id; of other searches nothing is read or written.

STATE holds the stream's checkpoint and a table of what each micro-batch brought,
partitioned by run_id and batch: at most a row a cell. An archive is always made
from these rows, never from itself, so a job that died at any point is made good
by the next run: the stream repeats the last micro-batch, which replaces its own
partitions and those of its runs. Best candidates do not depend on order or
repetition, so late files and rows that a log holds twice change nothing.

Settings (archive_feed.json): ``files`` (a glob), ``schema`` (of the files),
``columns`` (run_id, arrival, quality and d0 to d2 as SQL expressions), ``centroids``
(SQL of idx, c0, c1, c2), ``files_a_batch``.

Cases: rows without run, quality or d0 are no candidates; rows with other nulls
among the descriptors have no nearest cell and are none either; without new files
nothing is written; without any candidate there is no table, and archives() of it
is empty.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import checked, log, main
from tessella.operators import archive, calibration

DEFAULTS = {"files": None, "schema": None, "columns": None, "centroids": None, "files_a_batch": 16}
COLUMNS = ("run_id", "arrival", "quality", "d0", "d1", "d2")
ARCHIVE = "cell long, arrival long, quality double, d0 double, d1 double, d2 double, creature_id string, first_arrival long, run_id long"
BROUGHT = "cell long, arrival long, quality double, d0 double, d1 double, d2 double, first_arrival long, run_id long, batch long"


def candidates(events: DataFrame, config: dict) -> DataFrame:
    """The events that may enter an archive, with their cells."""
    kinds = dict.fromkeys(COLUMNS, "double") | {"run_id": "long", "arrival": "long"}
    rows = events.select(*[F.expr(config["columns"][c]).cast(kinds[c]).alias(c) for c in COLUMNS])
    rows = rows.where(archive.passes() & F.col("run_id").isNotNull() & F.col("arrival").isNotNull())
    centroids = events.sparkSession.sql(config["centroids"])
    return calibration.nearest(rows, centroids).where("cell_distance2 is not null").select(*COLUMNS, F.col("cell").cast("long").alias("cell"))


def best(rows: DataFrame, first: str) -> DataFrame:
    """Of each run and cell the best candidate, and the first arrival of any."""
    top = archive.best_per_cell(rows.select(*COLUMNS, "cell", *({first} - set(COLUMNS))), "run_id", also={"first": F.min(first)})
    return top.select(*COLUMNS, "cell", F.col("first").alias("first_arrival"))


def brought(spark: SparkSession, state: str) -> DataFrame:
    return spark.read.schema(BROUGHT).parquet(f"{state}/brought")


def archives(spark: SparkSession, output: str) -> DataFrame:
    """The archives as they are; no rows before the first."""
    try:
        return spark.read.schema(ARCHIVE).parquet(output)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ARCHIVE)


def take(batch: DataFrame, number: int, output: str, state: str, config: dict) -> None:
    """Bring one micro-batch of events in; taking it again changes nothing."""
    spark = batch.sparkSession
    rows = best(candidates(batch, config), "arrival").withColumn("batch", F.lit(number).cast("long"))
    replace(rows.repartition("run_id"), f"{state}/brought", "run_id", "batch")
    mine = brought(spark, state).where(F.col("batch") == number)
    if mine.isEmpty():
        log.info("batch %d: no candidates", number)
        return
    held = brought(spark, state).join(mine.select("run_id").distinct(), "run_id", "left_semi")
    now = archive.with_creature_id(best(held, "first_arrival"), seed="arrival").repartition("run_id")  # a run has a row a cell
    replace(now.select(*[c.split()[0] for c in ARCHIVE.split(", ")]), output, "run_id")
    counts = mine.agg(F.count("*").alias("cells"), F.countDistinct("run_id").alias("runs")).first()
    log.info("batch %d: %d cells of %d runs brought, their archives written to %s", number, counts["cells"], counts["runs"], output)


def replace(rows: DataFrame, path: str, *by: str) -> None:
    """Write the partitions that ``rows`` has in place of those before; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def run(spark: SparkSession, input: str, output: str, state: str, config: dict) -> DataFrame:
    """Take what is new in ``input`` and return the archives at ``output``."""
    config = checked(config, DEFAULTS)
    stream = spark.readStream.schema(config["schema"]).option("pathGlobFilter", config["files"]).option("maxFilesPerTrigger", config["files_a_batch"]).parquet(input)
    query = stream.writeStream.foreachBatch(lambda batch, number: take(batch, number, output, state, config)).option("checkpointLocation", f"{state}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    for p in query.recentProgress:
        log.info("read %d events of %s in batch %d", p["numInputRows"], input, p["batchId"])
    return archives(spark, output)


PATHS = {"input": "folder of event files", "output": "folder of the archives", "state": "folder of the checkpoint and of what each batch brought"}

if __name__ == "__main__":
    main(__doc__, PATHS, DEFAULTS, run)
