"""What the jobs' command lines share: arguments over a config file, a log, a session that ends with the job."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def main(job: Callable[..., object], name: str, paths: dict[str, str], given: list[str] | None = None) -> None:
    """Runs ``job(spark, **paths, **settings)``. ``--set key=value`` goes before the config file's settings."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=job.__doc__)
    for path, meaning in paths.items():
        parser.add_argument(f"--{path}", required=True, help=meaning)
    parser.add_argument("--config", default=str(Path(__file__).with_name(f"{name}.json")), help="settings as JSON")
    parser.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", help="one setting, as JSON")
    args = parser.parse_args(given)
    settings = json.loads(Path(args.config).read_text())
    for one in args.set:
        key, _, value = one.partition("=")
        if key not in settings:
            parser.error(f"no setting {key}; there are {', '.join(settings)}")
        settings[key] = json.loads(value)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        job(spark, **{path: getattr(args, path) for path in paths}, **settings)
    finally:
        spark.stop()
