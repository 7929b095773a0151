"""What the command lines of the jobs share."""

from __future__ import annotations

import argparse
import logging
import os
import tomllib
from collections.abc import Callable

from pyspark.sql import SparkSession


def main(work: Callable[..., dict], config: str, argv: list[str] | None = None) -> int:
    """Reads the settings, starts a session, runs the job and stops the session.

    Settings are the arguments of the job's function; each may be given on the command line, which goes
    before the config file.
    """
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    known = argparse.ArgumentParser(add_help=False)
    known.add_argument("--config", default=config)
    path, _ = known.parse_known_args(argv)
    with open(path.config, "rb") as f:
        settings = tomllib.load(f)
    conf = settings.pop("spark", {})
    parser = argparse.ArgumentParser(parents=[known], description=work.__doc__)
    for name, value in settings.items():
        parser.add_argument(f"--{name}", default=value, type=type(value))
    given = vars(parser.parse_args(argv))
    given.pop("config")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [root, os.environ.get("PYTHONPATH", "")]))
    spark = SparkSession.builder.appName(work.__name__).config(map=conf).getOrCreate()
    try:
        work(spark, **given)
    finally:
        spark.stop()
    return 0
