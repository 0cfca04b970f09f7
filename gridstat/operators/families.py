"""Record sets with forced references, pools with a fallback, and guards on the size of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstat.functions.ordered import by_keys


def assemble(records: DataFrame, wanted: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """``records`` and every key of ``wanted`` with its row of ``source``, which takes the place of a record of that key.

    A wanted key that ``source`` lacks stops the query.  ``forced`` tells which rows were wanted.
    """
    have = source.withColumn("_have", F.lit(True))
    forced = wanted.select(key).distinct().join(have, key, "left")
    found = F.assert_true(F.col("_have").isNotNull(), F.concat(F.lit("no record of the reference "), F.col(key).cast("string")))
    forced = forced.filter(found.isNull()).select(*source.columns).withColumn("forced", F.lit(True))
    return records.join(wanted.select(key).distinct(), key, "left_anti").select(*source.columns).withColumn("forced", F.lit(False)).unionByName(forced)


def with_fallback(pool: DataFrame, universe: DataFrame, needs: DataFrame, keys: list[str], need: str) -> DataFrame:
    """The pool's rows of every key of ``needs`` that has at least ``need`` of them, else the universe's; ``fell_back`` tells which, ``n_pool`` how many."""
    size = pool.groupBy(*keys).agg(F.count("*").alias("_n"))
    asked = by_keys(needs.select(*keys, need), size, keys, "left").withColumn("_few", F.coalesce("_n", F.lit(0)) < F.col(need))
    own = by_keys(pool, asked.filter(~F.col("_few")).select(*keys), keys, "left_semi").withColumn("fell_back", F.lit(False))
    other = by_keys(universe, asked.filter("_few").select(*keys), keys, "left_semi").withColumn("fell_back", F.lit(True))
    both = own.unionByName(other)
    return by_keys(both, both.groupBy(*keys).agg(F.count("*").alias("n_pool")), keys)


def large_enough(df: DataFrame, keys: list[str], least: int, of: Column | None = None) -> DataFrame:
    """Rows of keys with at least ``least`` rows (for which ``of`` holds)."""
    n = F.sum(of.cast("long")) if of is not None else F.count("*")
    return by_keys(df, df.groupBy(*keys).agg(n.alias("_n")).filter(F.col("_n") >= least).select(*keys), keys, "left_semi")
