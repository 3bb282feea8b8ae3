"""The jobs as registered queries: each runs twice into one new folder, and its output is read back."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import archive_feed, text_atlas
from tessella.plans import adapters as V
from tessella.sources.tables import shared_dir

HERE = Path(__file__).resolve().parent


def settings(job: str) -> dict:
    return json.loads((HERE / f"{job}.json").read_text())


def folder(spark: SparkSession, job: str) -> str:
    return f"{shared_dir(spark)}/{job}-{uuid.uuid4().hex}"


FEED_SQL = f"""
WITH {V.CELLED}, ranked AS (
  SELECT run_id, cell, arrival, quality, d0, d1, d2, min(arrival) OVER (PARTITION BY run_id, cell) AS first_arrival, row_number() OVER (PARTITION BY run_id, cell ORDER BY quality DESC, arrival) AS rn
  FROM celled WHERE quality IS NOT NULL
)
SELECT run_id, cell, arrival, round(quality, 6) AS quality, round(d0, 6) AS d0, d1, d2, run_id || '-' || arrival AS creature_id, first_arrival FROM ranked WHERE rn = 1
"""


def job1_archive_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = folder(spark, "job1")
    for _ in range(2):
        out = archive_feed.run(spark, sf_dir, f"{root}/archives", f"{root}/state", settings("archive_feed"))
    return out.withColumns({c: F.round(c, 6) for c in ("quality", "d0")})


ATLAS_SQL = r"""
WITH split AS (
  SELECT nullif(lang, '') AS lang, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS lines FROM documents WHERE doc_id IS NOT NULL
), m AS (
  SELECT lang, doc_id, len(w) AS words, 0.6::DOUBLE * least(1::DOUBLE, len(w)::DOUBLE / 200::DOUBLE) + 0.4::DOUBLE * (len(list_distinct(lines))::DOUBLE / len(lines)::DOUBLE) AS quality,
    len(list_distinct(w))::DOUBLE / len(w)::DOUBLE AS different, length(array_to_string(w, ''))::DOUBLE / len(w)::DOUBLE AS letters
  FROM split WHERE len(w) >= 5
), long AS (
  SELECT lang, doc_id, unnest([0, 1, 2]) AS axis, unnest([words::DOUBLE, different, letters]) AS v FROM m
), scale AS (
  SELECT lang, axis, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.95), 6) AS p95 FROM long GROUP BY ALL
), placed AS (
  SELECT m.*, CAST((SELECT sum(CASE WHEN p95 > p5 THEN least(greatest(floor((v - p5) / (p95 - p5) * 6), 0), 5) ELSE 0 END * CASE axis WHEN 0 THEN 1 WHEN 1 THEN 6 ELSE 36 END)
    FROM scale JOIN (VALUES (0, m.words::DOUBLE), (1, m.different), (2, m.letters)) x(axis, v) USING (axis) WHERE scale.lang IS NOT DISTINCT FROM m.lang) AS INTEGER) AS cell FROM m
), ranked AS (
  SELECT *, count(*) OVER (PARTITION BY lang, cell) AS texts, row_number() OVER (PARTITION BY lang, cell ORDER BY quality DESC, doc_id) AS rn FROM placed
)
SELECT cell, doc_id, round(quality, 6) AS quality, words, round(different, 6) AS different, round(letters, 6) AS letters, texts, lang FROM ranked WHERE rn = 1
"""


def job2_text_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = folder(spark, "job2")
    for _ in range(2):
        out = text_atlas.run(spark, f"{sf_dir}/documents.parquet", f"{root}/atlas", settings("text_atlas"))
    return out.withColumns({c: F.round(c, 6) for c in ("quality", "different", "letters")})


QUERIES = {"job1_archive_feed": job1_archive_feed, "job2_text_atlas": job2_text_atlas}
ORACLE_SQL = {"job1_archive_feed": FEED_SQL, "job2_text_atlas": ATLAS_SQL}
