"""Distance joins in up to three dimensions, and contact summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridstat.sources.scratch import stash

AXES = ("x", "y", "z")
#: Left points of a cell that a task holds, pairs of points that it compares at once, rows that it gives out at once, and bands of distance that it gives out one after the other.
EACH, PAIRS, GIVEN, BANDS = 2048, 1 << 21, 1 << 16, 16


def distance_join(left: DataFrame, right: DataFrame, cutoff: float, left_keys: list[str], right_keys: list[str], axes: tuple[str, ...] = AXES) -> DataFrame:
    """(left_keys, right_keys, distance): least distance of the points of each pair of keys, if at most ``cutoff``.

    Points fall into cells of that size; right ones are repeated for the neighbouring cells.  The left points of a cell are
    dealt over as many tasks as they are ``EACH``, which hold them and meet the right ones as they come, so that no pair is
    kept or shuffled and no task holds more than its own left points.  Pairs of unique points are each met once and are given
    out as they are met, those of a block by bands of distance and in these by left point, as columns of near or equal values
    take few bytes in files; only points that share their keys are brought together.  Points that lack a coordinate are near nothing.
    """
    spark, cells = left.sparkSession, [f"_c{i}" for i in range(len(axes))]
    size = cutoff * (1 + 1e-9)  # two points at the cutoff are in neighbouring cells however the quotients are rounded
    side = {"_l": (left, left_keys), "_r": (right, right_keys)}
    kinds = {n: df.select(F.struct(*keys).alias(n)).schema[n].dataType for n, (df, keys) in side.items()}

    def points(own: str) -> DataFrame:
        df, keys = side[own]
        names = [F.struct(*keys).alias(n) if n == own else F.lit(None).cast(kinds[n]).alias(n) for n in kinds]
        placed = df.select(*names, *(F.col(c).cast("double").alias(f"_p{i}") for i, c in enumerate(axes)), *(F.floor(F.col(c) / size).alias(k) for c, k in zip(axes, cells, strict=True)))
        return placed.filter(reduce(lambda x, y: x & y, [F.col(f"_p{i}").isNotNull() for i in range(len(axes))]))

    a, b = points("_l"), points("_r")
    for c in cells:
        b = b.withColumn(c, F.explode(F.array(*(F.col(c) + i for i in (-1, 0, 1)))))
    # cells that are cut are at most one for EACH points
    cut = stash(a.groupBy(*cells).agg(F.ceil(F.count("*") / EACH).cast("long").alias("_cuts")).filter("_cuts > 1"), "cells")
    a, b = ((df.withColumn("_cuts", F.lit(1)) if cut.isEmpty() else df.join(F.broadcast(cut), cells, "left").fillna(1, ["_cuts"])) for df in (a, b))
    a = a.withColumn("_cut", F.pmod(F.xxhash64("_l", *(f"_p{i}" for i in range(len(axes)))), "_cuts").cast("long")).withColumn("_right", F.lit(False))
    b = b.withColumn("_cut", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cuts").cast("long") - 1))).withColumn("_right", F.lit(True))
    order = [*kinds, *(f"_p{i}" for i in range(len(axes))), *cells, "_cut", "_right"]
    # few bytes make many pairs, so the number of tasks does not follow from bytes
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    met = a.select(*order).unionByName(b.select(*order)).repartition(tasks, *cells, "_cut").sortWithinPartitions(*cells, "_cut", "_right")
    schema = T.StructType([*kinds["_l"].fields, *kinds["_r"].fields, T.StructField("distance", T.DoubleType())])
    near = met.mapInArrow(_met(cutoff, len(axes), schema.names), schema)
    if all(unique(df, keys) for df, keys in side.values()):
        return near
    return near.groupBy(*left_keys, *right_keys).agg(F.min("distance").alias("distance"))


def _met(cutoff: float, n_axes: int, names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A kernel over points (_l, _r, coordinates, cells, _cut, _right) in the order of their cell, its left ones first."""
    coordinates, where = range(2, 2 + n_axes), range(2 + n_axes, 3 + 2 * n_axes)
    each, pairs, given, bands = EACH, PAIRS, GIVEN, BANDS

    def near(a: pa.RecordBatch, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        keys, other = a.column(0).flatten(), b.column(1).flatten()
        x, y = ([p.column(i).to_numpy() for i in coordinates] for p in (a, b))
        for i in range(0, a.num_rows, each):
            n = min(each, a.num_rows - i)
            width = pairs // n
            for j in range(0, b.num_rows, width):
                square = sum((u[i : i + n, None] - v[None, j : j + width]) ** 2 for u, v in zip(x, y, strict=True))
                at = np.flatnonzero(square <= cutoff * cutoff * (1 + 1e-9))
                distance = np.sqrt(square.ravel()[at])
                at, distance = at[distance <= cutoff], distance[distance <= cutoff]
                order = np.argsort((bands * (1 - distance / cutoff)).astype(np.int8), kind="stable")
                distance, (row, column) = distance[order], np.divmod(at[order], square.shape[1])
                for lo in range(0, len(order), given):
                    r, c = pa.array(row[lo : lo + given] + i), pa.array(column[lo : lo + given] + j)
                    yield pa.RecordBatch.from_arrays([*(k.take(r) for k in keys), *(k.take(c) for k in other), pa.array(distance[lo : lo + given])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in batches:
            place = np.stack([batch.column(i).to_numpy() for i in where])
            right = batch.column(where[-1] + 1).to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero((np.diff(place) != 0).any(0) | (right[1:] != right[:-1])) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                cell, own = tuple(place[:, lo]), batch.slice(lo, hi - lo)
                if not right[lo]:
                    held = [*held, own] if cell == here else [own]
                    here = cell
                elif cell == here:
                    held = held if len(held) == 1 else [pa.concat_batches(held)]
                    yield from near(held[0], own)

    return run


def unique(df: DataFrame, keys: list[str]) -> bool:
    """Has every row keys of its own?  Null keys are equal."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").isEmpty()


def retained_copies(contacts: DataFrame, chains: list[str], least: int = 10, share: float = 0.25) -> DataFrame:
    """Contacts of chain pairs with at least max(least, share of the most) contacts."""
    kept = _retained(contacts.groupBy(*chains).agg(F.count("*").alias("n_contacts")), chains, least, share)
    return contacts.join(kept, chains, "left_semi")


def _retained(n: DataFrame, chains: list[str], least: int, share: float) -> DataFrame:
    top = n.agg(F.max("n_contacts").alias("_top"))  # one row
    return n.crossJoin(F.broadcast(top)).filter(F.col("n_contacts") >= F.greatest(F.lit(float(least)), share * F.col("_top"))).select(*chains)


def interface(contacts: DataFrame, side: list[str], partner: list[str]) -> DataFrame:
    """Each residue of one side once: partners, least, mean and greatest distance."""
    return contacts.groupBy(*side).agg(
        F.count_distinct(*partner).alias("n_partners"), F.min("distance").alias("min_distance"), F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance")
    )


def retained_interface(contacts: DataFrame, side: list[str], partner: list[str], chains: list[str], least: int = 10, share: float = 0.25) -> DataFrame:
    """``interface`` of the ``retained_copies`` of contacts that have one row for each pair of residues, as ``distance_join`` gives them.

    Contacts are summed up by residue and pair of chains where they are found, so that what is shuffled grows with the
    residues, not with the contacts, and they are found once.
    """
    keys = list(dict.fromkeys([*side, *chains]))
    named = reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in partner])
    d = "distance"
    per = stash(contacts.groupBy(*keys).agg(F.count("*").alias("_n"), F.count(F.when(named, 1)).alias("_k"), F.min(d).alias("_lo"), F.sum(d).alias("_t"), F.max(d).alias("_hi")), "contacts")
    kept = stash(_retained(per.groupBy(*chains).agg(F.sum("_n").alias("n_contacts")), chains, least, share), "kept")
    return per.join(kept, chains, "left_semi").groupBy(*side).agg(
        F.sum("_k").alias("n_partners"), F.min("_lo").alias("min_distance"), (F.sum("_t") / F.sum("_n")).alias("mean_distance"), F.max("_hi").alias("max_distance")
    )
