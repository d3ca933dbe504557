"""What the jobs share: config files and the session of a command line."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable

from pyspark.sql import SparkSession


def configured(spark: SparkSession, path: str | None, known: dict) -> dict:
    """``known`` with the values of a JSON file, which may stand wherever Spark reads; a name that isn't known raises."""
    own = json.loads(spark.read.text(path, wholetext=True).first()[0]) if path else {}
    if unknown := set(own) - set(known):
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return known | own


def command(name: str, paths: dict[str, str], defaults: dict, run: Callable) -> None:
    """The command line of a job: its paths and --config; makes the session and stops it."""
    parser = argparse.ArgumentParser(prog=name)
    for path, text in paths.items():
        parser.add_argument(f"--{path}", required=True, help=text)
    parser.add_argument("--config", help="JSON file with settings")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, settings=configured(spark, given.pop("config"), defaults), **given)
    finally:
        spark.stop()
