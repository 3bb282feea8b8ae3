"""Written intermediate tables in the folder that all executors share, and rows told apart by id and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.session import ship
from tessella.sources.tables import release
from tessella.sources.tables import stage as save

__all__ = ["bounded_batches", "release", "save", "text_key", "without"]


def text_key(text_col: str) -> Column:
    """Tells rows of one id apart by their texts."""
    return F.xxhash64(F.col(text_col).cast("string"))


def without(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` less those that ``rows`` (doc_id, key) name, by id and text_key(); all columns are kept.

    The rows are written first, so that Spark knows their size: it broadcasts
    them below its threshold, and shuffles the documents only beyond it.
    """
    out = save(rows.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct(), "left_out")
    return docs.join(out, docs[id_col].cast("long").eqNullSafe(out["_id"]) & (F.xxhash64(docs[text_col].cast("string")) == out["_key"]), "left_anti")


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of a few thousand rows, so that a batch of long texts stays small, for workers that have this package.

    Results are lazy, so the session keeps the setting; it changes no result.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
