"""Running sums and positions over an order of the whole table, without one task for it.

A sample sort: rows are dealt by range of (keys, value, tie-break) at splitters that
Spark samples, so that equal values are spread as their tie-breaks are; each partition
is sorted and scanned once, and written with its sums so far.  What a partition lacks is
one number for the key that goes on into it from the partitions before: a table of at
most one row a partition.  ``keys`` give independent orders.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridstat.sources.scratch import stash


def by_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right``; null keys are equal.  Without keys ``right`` has one row in all."""
    if not keys:
        return left.crossJoin(F.broadcast(right))  # one row
    named = right.withColumnsRenamed({k: f"_t{i}" for i, k in enumerate(keys)})
    on = reduce(lambda x, y: x & y, [left[k].eqNullSafe(named[f"_t{i}"]) for i, k in enumerate(keys)])
    return left.join(named, on, how).drop(*(f"_t{i}" for i in range(len(keys))))


def sorted_by_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``by_keys`` of two sides that both grow with the cells, by sorting them: neither is broadcast, whatever size it is guessed at.

    Spark guesses a table by its files, and those of cells take a few hundredths of what they take in memory.
    """
    return by_keys(left, right.hint("merge"), keys, how)


def with_totals(df: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """df with the other columns of ``totals``, a table of one row for each key (one row in all without keys)."""
    return by_keys(df, totals, keys)


def _new_key(b: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Which rows of a sorted batch are the first of their key in it; nulls are equal."""
    new = np.zeros(b.num_rows, bool)
    new[0] = True
    for k in keys:
        x, y = b.column(k).slice(1), b.column(k).slice(0, b.num_rows - 1)
        apart = pc.fill_null(pc.not_equal(x, y), pc.xor(pc.is_null(x), pc.is_null(y))) if b.num_rows > 1 else pa.array([], pa.bool_())
        new[1:] |= apart.to_numpy(zero_copy_only=False)
    return new


def accumulated(df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str] = {}, least: dict[str, str] = {}) -> DataFrame:
    """df with, under each name, the sum (or the least value) of a column over its key's rows up to this one in ``order``.

    ``order`` should tell rows apart, as rows that it does not are taken in any order and are kept in one task.
    """
    whole = {n for n, c in sums.items() if isinstance(df.schema[c].dataType, T.IntegralType)}
    added = [T.StructField(n, T.LongType() if n in whole else T.DoubleType()) for n in [*sums, *least]]
    columns, names = [*(F.asc_nulls_first(k) for k in keys), *order], [*df.columns, *sums, *least, "_part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, before, carry = TaskContext.get().partitionId(), None, {}
        for b in batches:
            if not b.num_rows:
                continue
            segment = np.cumsum(_new_key(b, keys))
            goes_on = before == [b.column(k)[0].as_py() for k in keys]
            out = []
            for name, column in [*sums.items(), *least.items()]:
                x = pd.Series(pc.fill_null(b.column(column).cast(pa.int64() if name in whole else pa.float64()), 0).to_numpy()).groupby(segment)
                y = (x.cumsum() if name in sums else x.cummin()).to_numpy(copy=True)
                if goes_on:
                    first = segment == segment[0]
                    y[first] = y[first] + carry[name] if name in sums else np.minimum(y[first], carry[name])
                carry[name] = y[-1]
                out.append(pa.array(y))
            before = [b.column(k)[b.num_rows - 1].as_py() for k in keys]
            yield pa.RecordBatch.from_arrays([*b.columns, *out, pa.array(np.full(b.num_rows, part, np.int32))], names)

    schema = T.StructType([*df.schema.fields, *added, T.StructField("_part", T.IntegerType())])
    table = stash(df.repartitionByRange(*columns).sortWithinPartitions(*columns).mapInArrow(run, schema), "ordered")
    total = table.groupBy(*keys, "_part").agg(*(F.sum(c).alias(n) for n, c in sums.items()), *(F.min(c).alias(n) for n, c in least.items()))
    earlier = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = total.select(*keys, "_part", *(F.sum(n).over(earlier).alias(f"_b{n}") for n in sums), *(F.min(n).over(earlier).alias(f"_b{n}") for n in least), F.lag("_part").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_part")).alias("_lag"))
    # one row at most for each partition: its first key, where that began earlier
    offsets = stash(offsets.filter("_lag is not null").drop("_lag"), "offsets")
    joined = by_keys(table, offsets, [*keys, "_part"], "left")
    fixed = {n: F.col(n) + F.coalesce(F.col(f"_b{n}"), F.lit(0)) for n in sums} | {n: F.least(F.col(n), F.col(f"_b{n}")) for n in least}
    return joined.withColumns(fixed).select(*df.columns, *sums, *least)


def running(df: DataFrame, value: str, order: list[str], amount: str | list[str], keys: list[str] = [], name: str | list[str] = "before") -> DataFrame:
    """``name``: the sum of ``amount`` over the rows of the key that come before, in order of ``value`` (nulls first), then ``order``; or several of both."""
    amounts, names = ([amount], [name]) if isinstance(amount, str) else (amount, name)
    out = accumulated(df, keys, [F.asc_nulls_first(c) for c in (value, *order)], dict(zip(names, amounts, strict=True)))
    return out.withColumns({n: F.col(n) - F.col(a) for n, a in zip(names, amounts, strict=True)})


def row_numbers(df: DataFrame, value: str, order: list[str], keys: list[str] = [], name: str = "rn") -> DataFrame:
    """``name``: position from 1 in order of ``value``, then ``order``."""
    return accumulated(df.withColumn("_one", F.lit(1).cast("long")), keys, [F.asc_nulls_first(c) for c in (value, *order)], {name: "_one"}).drop("_one")


def ranks(df: DataFrame, value: str, keys: list[str] = []) -> DataFrame:
    """(keys, value, ties, less): each distinct value, how often it occurs and how many are smaller."""
    return running(df.groupBy(*keys, value).agg(F.count("*").alias("ties")), value, [], "ties", keys, "less")


def average_rank(df: DataFrame, value: str, keys: list[str] = [], name: str = "avg_rank") -> DataFrame:
    """``name``: rank from 1, the mean of its places for tied values."""
    r = ranks(df, value, keys).select(*(F.col(k).alias(f"_a{i}") for i, k in enumerate(keys)), F.col(value).alias("_av"), (F.col("less") + (F.col("ties") + 1) / 2).alias(name))
    on = reduce(lambda x, y: x & y, [df[k].eqNullSafe(r[f"_a{i}"]) for i, k in enumerate(keys)], df[value].eqNullSafe(r["_av"]))
    return df.join(r, on).drop("_av", *(f"_a{i}" for i in range(len(keys))))


def fraction_below(df: DataFrame, value: str, keys: list[str] = [], name: str = "fraction_below") -> DataFrame:
    """``name``: share of the key's rows with a strictly smaller value."""
    r = ranks(df, value, keys)
    r = with_totals(r, r.groupBy(*keys).agg(F.sum("ties").alias("_n")), keys)
    r = r.select(*(F.col(k).alias(f"_a{i}") for i, k in enumerate(keys)), F.col(value).alias("_av"), (F.col("less") / F.col("_n")).alias(name))
    on = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_a{i}")) for i, k in enumerate(keys)], F.col(value).eqNullSafe(F.col("_av")))
    return df.join(r, on).drop("_av", *(f"_a{i}" for i in range(len(keys))))
