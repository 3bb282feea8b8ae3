import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
RUN = """
from pyspark.sql import SparkSession
import __spark_entry__ as entry
names = entry.queries()
assert "quality_pipeline" in names and "job1_archive_feed" in names and "pipeline" not in names and not any(n.startswith("op1_") for n in names)
assert set(entry.oracle_sql()) <= set(names)
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
assert names["axis_scale"](spark, "/root/testdata/sf0.001").count() >= 0
"""


def test_everything_else_works_without_the_corpus_operators(tmp_path):
    """The driver removes both folders; corpus_pipeline.py may stay or go."""
    for name in ("tessella", "jobs", "__spark_entry__.py", "corpus_pipeline.py"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", RUN], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
