"""text atlas: an archive of different texts, so that a corpus can be looked at by kind and not at random.

    python -m jobs.text_atlas --input documents.parquet --output ATLAS --config jobs/text_atlas.json

The texts of a table are measured as a search measures creatures: length, share
of different words and letters a word span a behaviour space, and a text without
repeated lines and of a fair length has a high quality. Each language is scaled by
its own 5 to 95 percent range, cut into ``bins`` parts an axis; the text of best
quality stands for its cell, with the number of texts that it stands for. The
rarest kinds of text have cells of their own, however few they are.

ATLAS is one Parquet table, partitioned by lang, that each run writes as a whole;
equal input gives equal rows, since ties go to the least id.

Settings (text_atlas.json): ``id``, ``text`` and ``lang`` (columns), ``bins`` (an axis),
``least_words`` (shorter texts are left out), ``fair_words`` (from here on length does
not add to quality).

Cases: rows without id or with fewer words (null texts have none) are left out; a
null or empty lang is a language of its own, null; repeated rows count; texts are
read whole; an empty table gives an empty atlas.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import checked, log, main
from tessella.operators import archive, calibration, metrics
from tessella.operators.percentiles import matched
from tessella.sources.tables import release, stage

DEFAULTS = {"id": "doc_id", "text": "text", "lang": "lang", "bins": 6, "least_words": 5, "fair_words": 200}
ATLAS = "cell int, doc_id long, quality double, words long, different double, letters double, texts long, lang string"
WORD = r"[^\x20\x09-\x0D]+"


def measured(docs: DataFrame, config: dict) -> DataFrame:
    """lang, arrival, quality and d0 to d2 of the texts that are long enough."""
    text = F.coalesce(F.col(config["text"]).cast("string"), F.lit(""))
    rows = docs.select(F.nullif(F.col(config["lang"]).cast("string"), F.lit("")).alias("lang"), F.col(config["id"]).cast("long").alias("arrival"), text.alias("t"))
    rows = rows.withColumn("w", F.regexp_extract_all("t", F.lit(WORD), 0)).withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)))
    n = F.size("w")
    rows = rows.where((n >= max(1, config["least_words"])) & F.col("arrival").isNotNull())
    fresh = F.size(F.array_distinct("lines")) / F.size("lines")
    letters = F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    return rows.select("lang", "arrival", (0.6 * F.least(F.lit(1.0), n / F.lit(float(config["fair_words"]))) + 0.4 * fresh).alias("quality"), n.cast("double").alias("d0"), (F.size(F.array_distinct("w")) / n).alias("d1"), (letters / n).alias("d2"))


def atlas(rows: DataFrame, bins: int) -> DataFrame:
    """The best text of each cell of each language, from measured() rows."""
    scale = calibration.axis_scale(rows, "lang").groupBy("lang").agg(*[F.max(F.when(F.col("axis") == i, F.round(end, 6))).alias(f"{end}_{i}") for i in range(3) for end in ("p5", "p95")])
    at = [metrics.bucket(F.col(f"d{i}"), F.col(f"p5_{i}"), F.col(f"p95_{i}"), bins) for i in range(3)]
    cell = reduce(lambda a, b: a * bins + b, reversed(at))
    celled = matched(rows, scale, ["lang"]).select(*rows.columns, cell.alias("cell"))
    best = archive.best_per_cell(celled, "lang", also={"texts": F.count("*")})
    return best.select("cell", F.col("arrival").alias("doc_id"), "quality", F.col("d0").cast("long").alias("words"), F.col("d1").alias("different"), F.col("d2").alias("letters"), "texts", "lang")


def run(spark: SparkSession, input: str, output: str, config: dict) -> DataFrame:
    """Write the atlas of the table at ``input`` and return it as it is at ``output``."""
    config = checked(config, DEFAULTS)
    rows = stage(measured(spark.read.parquet(input), config), "measured")  # the texts are read once
    atlas(rows, config["bins"]).repartition("lang").write.mode("overwrite").partitionBy("lang").parquet(output)
    out = spark.read.schema(ATLAS).parquet(output)
    log.info("read %d texts of %s that are long enough", rows.count(), input)
    for r in archive.fill(out, config["bins"] ** 3, "lang").orderBy("lang").collect():  # a row a language
        log.info("wrote %d cells of %s to %s, %.1f %% of its space", r["occupied"], r["lang"], output, 100 * r["fill"])
    release(rows)
    return out


PATHS = {"input": "table of texts", "output": "folder of the atlas"}

if __name__ == "__main__":
    main(__doc__, PATHS, DEFAULTS, run)
