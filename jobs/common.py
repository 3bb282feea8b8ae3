"""What both jobs share: configuration files, the log, the command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession

from tessella.session import session

log = logging.getLogger("tessella.jobs")


def read_config(spark: SparkSession, path: str, defaults: dict) -> dict:
    """A JSON object by Spark, so its path may be remote; fields it lacks are the defaults, others are errors."""
    rows = spark.read.text(path, wholetext=True).collect()  # one small file
    if len(rows) != 1:
        raise ValueError(f"{path} is {len(rows)} files, not one")
    found = json.loads(rows[0]["value"])
    return checked(found, defaults)


def checked(config: dict, defaults: dict) -> dict:
    unknown = set(config) - set(defaults)
    if unknown:
        raise ValueError(f"unknown fields: {', '.join(sorted(unknown))}; known are {', '.join(sorted(defaults))}")
    whole = defaults | config
    missing = [k for k, v in whole.items() if v is None]
    if missing:
        raise ValueError(f"fields without a value: {', '.join(sorted(missing))}")
    return whole


def main(description: str, paths: dict[str, str], defaults: dict, run: Callable, argv: list[str] | None = None) -> None:
    """The command line of a job: its paths and a config file; creates and stops the session."""
    parser = argparse.ArgumentParser(description=description)
    for name, text in paths.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    parser.add_argument("--config", required=True, help="JSON file with the job's settings")
    args = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = session(description.split(":")[0])
    try:
        config = read_config(spark, args.pop("config"), defaults)
        run(spark, **args, config=config)
    finally:
        spark.stop()
