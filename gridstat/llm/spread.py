"""Joins with a table of one row a key, where some keys have very many rows.

The few keys with more than ``EACH`` rows are written as a table of their own
(it has at most one row for each ``EACH`` rows of the input); their rows are cut
by a hash of the row, and the one row that they meet is repeated for each cut.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstat.sources.scratch import stash

EACH = 1000


def hot_keys(counted: DataFrame, keys: list[str], n: str = "n", each: int = EACH) -> DataFrame:
    """A written table (keys, cuts) of the keys with more than ``each`` rows."""
    return stash(counted.filter(F.col(n) > each).select(*keys, F.ceil(F.col(n) / each).cast("int").alias("cuts")), "hot")


def _on(a: DataFrame, b: DataFrame, keys: list[str], names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[m]) for k, m in zip(keys, names, strict=True)])


def _tagged(rows: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    names = [f"_h{i}" for i in range(len(keys))]
    h = hot.withColumnsRenamed(dict(zip(keys, names, strict=True))).withColumnRenamed("cuts", "_cuts")
    return rows.join(h, _on(rows, h, keys, names), "left").drop(*names)


def cut(rows: DataFrame, hot: DataFrame, keys: list[str], by: Column) -> DataFrame:
    """rows with ``cut``: 0, or for hot keys a number by the hash of ``by``."""
    return _tagged(rows, hot, keys).withColumn("cut", F.pmod(F.xxhash64(by), F.coalesce("_cuts", F.lit(1))).cast("int")).drop("_cuts")


def repeated(one: DataFrame, hot: DataFrame, keys: list[str]) -> DataFrame:
    """one, with ``cut``: every row once for each cut of its key."""
    return _tagged(one, hot, keys).withColumn("cut", F.explode(F.sequence(F.lit(0), F.coalesce("_cuts", F.lit(1)) - 1))).drop("_cuts")


def join(many: DataFrame, one: DataFrame, hot: DataFrame, keys: list[str], by: Column, how: str = "inner", one_keys: list[str] | None = None) -> DataFrame:
    """``many`` (cut by ``by``, which tells its rows apart) joined with ``one``, whose keys may have other names; null keys are equal."""
    names = [f"_k{i}" for i in range(len(keys))]
    if one_keys:
        one = one.withColumnsRenamed(dict(zip(one_keys, keys, strict=True)))
    a, b = cut(many, hot, keys, by), repeated(one, hot, keys)
    b = b.withColumnsRenamed(dict(zip(keys, names, strict=True))).withColumnRenamed("cut", "_cut")
    return a.join(b, _on(a, b, keys, names) & (a["cut"] == b["_cut"]), how).drop(*names, "cut", "_cut")
