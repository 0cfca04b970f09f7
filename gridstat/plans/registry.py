"""Every query of the engine's own operators, by name, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Doubles rounded as other engines round them, by a product; adding 0.0 takes the sign off a zero."""
    scale = 10.0**digits
    return df.withColumns({n: F.round(F.col(n) * scale) / scale + F.lit(0.0) for n in names})


from . import checks, composites, coupling, jobs, mapping, matrix, nulls, ranking, storage, structure, testing  # noqa: E402, F401
