"""A training-data pipeline of five corpus operators over ``documents``.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its rows are written
as Parquet and read again as the next stage's docs. All stages but the last
return the columns of ``documents``:

language        documents in no known language go
near_duplicates one document of each near-duplicate group stays
decontaminate   documents with a benchmark window go
pii             personal data are replaced in the texts
mix             the words that a mix of the sources takes of each document

Rows are told apart by doc_id and text wherever they go: of rows that repeat a
doc_id, one with another text stays. Cases, besides those of the operators: an
empty table gives empty tables; without labelled rows (of a non-null lang) every
document is in no known language and goes; an empty benchmark leaves all; other
columns, whatever their names, are kept up to the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import decontaminate, language, mixing, ngram_join, pii
from tessella.llm.stage import save
from tessella.sources.tables import STAGED, release_since


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts, and those without a letter, go; very long and mixed ones are judged whole."""
    return language.keep(docs, language.crc_mod(4) != 2)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and similar texts that of the least doc_id stays, with every row that repeats it; texts without words stay."""
    return ngram_join.keep_first(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Any benchmark window in the whole text lets its row go; texts and items without words hit nothing."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are replaced by their kinds; n_chars follows the new text; null texts stay null."""
    return pii.sanitise(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken; empty texts are taken 0 times."""
    return mixing.taken(docs)


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("pii", pii_stage),
    ("mix", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, begun = spark.read.parquet(f"{sf_dir}/documents.parquet"), len(STAGED)
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
        release_since(begun, docs)  # a stage's own tables, and its input, are read no more
    return docs


#: Language models, learned disclosure and the schedule of the mix are not SQL;
#: tests/llm/test_pipeline.py holds the stages against plain versions instead.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
ORACLE = {"pipeline": ORACLE_SQL}
