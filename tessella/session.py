"""Session helpers: a configured SparkSession, and this package on every Python worker."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(name: str = "tessella", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; anything set on the command line or in ``conf`` wins."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send this package's sources to the workers, once for a context; they need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_tessella_shipped", False):
        return
    package = Path(__file__).resolve().parent
    handle, archive = tempfile.mkstemp(prefix="tessella-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, path.relative_to(package.parent))
    context.addPyFile(archive)
    context._tessella_shipped = True
