"""What the jobs' command lines share: options, config files and a session."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path
from typing import Any


def config_of(job: str, path: str | None = None) -> dict[str, Any]:
    """The job's own config file beside it, with the settings of ``path`` in place of its own."""
    config = json.loads((Path(__file__).parent / f"{job}.json").read_text())
    if path:
        given = json.loads(Path(path).read_text())
        if unknown := set(given) - set(config):
            raise ValueError(f"{path}: no such setting: {', '.join(sorted(unknown))}")
        config |= given
    return config


def main(job: str, paths: dict[str, str], run: Callable[..., Any]) -> None:
    """Run ``run(spark, *paths, config=...)`` in a session of its own."""
    from pyspark.sql import SparkSession

    from gridstat.sources.workers import reach

    parser = argparse.ArgumentParser(description=run.__doc__)
    for name, says in paths.items():
        parser.add_argument(f"--{name}", required=True, help=says)
    parser.add_argument("--config", help=f"a JSON file whose settings replace those of jobs/{job}.json")
    given = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(job).getOrCreate()
    try:
        reach(spark)
        run(spark, *(given[name] for name in paths), config=config_of(job, given["config"]))
    finally:
        spark.stop()
