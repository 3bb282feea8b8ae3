"""Intermediate tables, and readers and writers of run artefacts."""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType([
    T.StructField("run_id", T.StringType()),
    T.StructField("completed_count", T.LongType()),
    T.StructField("seed", T.LongType()),
    T.StructField("d", T.ArrayType(T.DoubleType())),
    T.StructField("quality", T.DoubleType()),
    T.StructField("rejection_reason", T.StringType()),
    T.StructField("insertion_status", T.StringType()),
    T.StructField("parent_id", T.StringType()),
    T.StructField("compute_seconds", T.DoubleType()),
    T.StructField("created_at", T.DoubleType()),
])


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Without that setting a local master gets a folder beside the warehouse; on a
    cluster that could be one machine's own, so it is refused.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "_stages"


class Staged(threading.local):
    """Folders of the tables that stage() has written in this thread, in order; queries of other threads have their own."""

    def __init__(self) -> None:
        self.folders: list[str] = []

    def __len__(self) -> int:
        return len(self.folders)


STAGED = Staged()
#: Spark's setting that a finished query deletes its shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it: cuts lineage, survives lost executors.

    The write's shuffle files go as soon as it is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    STAGED.folders.append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release_since(mark: int, *keep: DataFrame) -> None:
    """Delete the tables that stage() has written in this thread since len(STAGED) was ``mark``, but those that ``keep`` reads."""
    kept = {f.rpartition("/")[0].rpartition("/")[2] for df in keep for f in df.inputFiles()}
    for folder in STAGED.folders[mark:]:
        if folder.rpartition("/")[2] not in kept:
            delete_folder(keep[0].sparkSession, folder)
    STAGED.folders[mark:] = [f for f in STAGED.folders[mark:] if f.rpartition("/")[2] in kept]


def release(*frames: DataFrame) -> None:
    """Delete tables of stage() that nothing reads any more."""
    for df in frames:
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            delete_folder(df.sparkSession, folder)


def read_events(spark: SparkSession, path: str, schema: T.StructType = EVENT) -> DataFrame:
    """An event log of JSON lines; lines that are no JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def in_order(events: DataFrame, *keys: str) -> DataFrame:
    """Events by time of creation, run by run; those without a time first, equal times by completed_count."""
    return events.orderBy(*keys, F.col("created_at").asc_nulls_first(), "completed_count")


def incremental(found: DataFrame, built_path: str, build) -> DataFrame:
    """Build products of ``found`` (key, modified) that are missing or older, and put them into the table at ``built_path``.

    ``build`` makes (key, modified, ...) rows of the stale ones. Returns the new table.
    """
    spark = found.sparkSession
    old = read_checkpoint(spark, built_path)
    todo = stage(found if old is None else stale(found, old), "stale")
    fresh = build(todo)
    kept = None if old is None else old.join(todo.select("key"), "key", "left_anti").join(found.select("key"), "key", "left_semi")
    checkpoint_table(fresh if kept is None else kept.select(*fresh.columns).unionByName(fresh), built_path)
    return read_checkpoint(spark, built_path)


def append_events(events: DataFrame, path: str) -> None:
    """Append to a log of JSON lines; binary columns (thumbnails) are left out."""
    plain = [f.name for f in events.schema if not isinstance(f.dataType, T.BinaryType)]
    events.select(plain).write.mode("append").json(path)


def read_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON documents, one a file; what does not parse has null fields."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.from_json("value", schema, {"mode": "PERMISSIVE", "allowNonNumericNumbers": "true"}).alias("d"), F.input_file_name().alias("path")).select("path", "d.*")


def discover(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(folder, modified) of every folder below ``root`` with a file of that name, newest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    return files.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.col("modificationTime").alias("modified")).orderBy(F.desc("modified"), "folder")


def latest(spark: SparkSession, root: str, name: str) -> str | None:
    row = discover(spark, root, name).agg(F.max_by("folder", F.struct("modified", "folder")).alias("f")).first()
    return row["f"] if row else None


def stale(found: DataFrame, built: DataFrame) -> DataFrame:
    """Rows of ``found`` (key, modified) whose product in ``built`` is missing or older."""
    done = built.select("key", F.col("modified").alias("_built"))
    return found.join(done, (found["key"] == done["key"]) & (F.col("_built") >= found["modified"]), "left_anti")


def checkpoint_table(df: DataFrame, path: str) -> None:
    """Replace the table at ``path``: a new version is written, then named by one atomic rename.

    Readers (read_checkpoint) see the old or the new rows at any moment. The
    version before the one replaced goes, so a reader that has just begun keeps
    its files.
    """
    spark = df.sparkSession
    version = f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{version}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    before = current_version(spark, path)
    fresh, name = jvm.org.apache.hadoop.fs.Path(f"{path}/_{version}"), jvm.org.apache.hadoop.fs.Path(f"{path}/_CURRENT")
    out = fs.create(fresh, True)
    out.write(bytearray(f"{version} {before or ''}".encode()))
    out.close()
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), conf).rename(fresh, name, overwrite)
    for f in fs.listStatus(folder):
        old = f.getPath().getName()
        if old.startswith("v-") and old not in (version, before):
            fs.delete(f.getPath(), True)


def current_version(spark: SparkSession, path: str) -> str | None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    name = jvm.org.apache.hadoop.fs.Path(f"{path}/_CURRENT")
    fs = name.getFileSystem(conf)
    if not fs.exists(name):
        return None
    stream = fs.open(name)
    try:
        return bytes(stream.readAllBytes()).decode().split(" ")[0]
    finally:
        stream.close()


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows last given to checkpoint_table(); None before the first."""
    version = current_version(spark, path)
    return spark.read.parquet(f"{path}/{version}") if version else None


def summary_json(df: DataFrame, *keys: str) -> DataFrame:
    """(keys, document): one JSON document a row; infinities and NaN become null."""
    fixed = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.DoubleType):
            c = F.transform(c, lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x))
        fixed.append(c.alias(f.name))
    return df.select(*keys, F.to_json(F.struct(*fixed), {"ignoreNullFields": "false"}).alias("document"))


def write_artifacts(files: DataFrame, root: str) -> None:
    """Write (path, content) rows as files below ``root``, by the executors' file system client."""
    from tessella.sources.files import write_partition

    files.select("path", "content").foreachPartition(lambda rows: write_partition(rows, root))


def parse_gpu_csv(lines: DataFrame, column: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of the thirteen-field telemetry line, after those to keep; placeholders are null."""
    names = ("index", "name", "utilization", "memory_utilization", "memory_used", "memory_total", "temperature", "power", "power_limit", "clock_sm", "clock_memory", "pstate", "fan")
    part = F.split(F.col(column), r"\s*,\s*")
    text = {"name", "pstate"}
    return lines.select(*keep, *[(F.nullif(F.get(part, F.lit(i)), F.lit("[N/A]")) if n in text else F.trim(F.get(part, F.lit(i))).try_cast("int" if n == "index" else "double")).alias(n) for i, n in enumerate(names)])


def write_document(fields: dict, spark: SparkSession, path: str) -> None:
    """Write a run's manifest or configuration as one JSON document; what JSON cannot hold is left out."""
    import json

    def plain(v):
        try:
            json.dumps(v)
            return True
        except TypeError:
            return False

    text = json.dumps({k: v for k, v in fields.items() if plain(v)}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def merge_document(spark: SparkSession, path: str, extra: dict) -> dict:
    """Add fields to a document; a missing or broken one counts as empty."""
    import json

    from pyspark.errors import AnalysisException

    try:
        now = json.loads("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    except (AnalysisException, ValueError):
        now = {}
    write_document(now | extra, spark, path)
    return now | extra
