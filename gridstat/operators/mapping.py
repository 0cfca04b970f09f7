"""Coordinate maps between residues and columns, interval projection, provenance and audits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridstat.functions.ordered import by_keys, sorted_by_keys
from gridstat.sources.scratch import stash

from .intervals import point_join
from .matrix import GAP


def coordinate_map(cells: DataFrame, by: list[str] = ["row_id"]) -> DataFrame:
    """(by, col_ix, symbol, residue): 1-based numbers of the symbols that are no gaps, by row."""
    w = Window.partitionBy(*by).orderBy("col_ix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    n = F.sum(F.when(F.col("symbol") != GAP, 1).otherwise(0)).over(w)
    return cells.withColumn("residue", n.cast("int")).filter(F.col("symbol") != GAP).select(*by, "col_ix", "symbol", "residue")


def map_violations(cmap: DataFrame, canonical: DataFrame, by: list[str] = ["row_id"]) -> DataFrame:
    """Residues whose letter in the map is not that of ``canonical`` (by, residue, letter), or that only one of them has."""
    keys = [*by, "residue"]
    named = canonical.withColumnsRenamed({k: f"_c{i}" for i, k in enumerate(keys)})
    j = cmap.join(named, all_of([cmap[k].eqNullSafe(named[f"_c{i}"]) for i, k in enumerate(keys)]), "full")
    # a side that is there has a residue
    own = {k: F.when(F.col("residue").isNull(), F.col(f"_c{i}")).otherwise(F.col(k)) for i, k in enumerate(keys)}
    return j.filter(~F.col("symbol").eqNullSafe(F.col("letter"))).withColumns(own).drop(*(f"_c{i}" for i in range(len(keys))))


def project(features: DataFrame, cmap: DataFrame, reference: str = "row_id") -> DataFrame:
    """(reference, feature, residue, col_ix) for every residue of every inclusive interval that the map has.

    features has (reference or none, feature, start, end); intervals may be of any length, as they are filed in bins.
    """
    keys = [reference] if reference in features.columns else []
    return point_join(cmap, features.select(*keys, "feature", "start", "end"), "residue", "start", "end", keys).select(reference, "feature", "residue", "col_ix")


def coverage(features: DataFrame, projected: DataFrame, references: DataFrame, reference: str = "row_id") -> DataFrame:
    """How much of each interval is mapped, and where; -1 where nothing is."""
    got = projected.groupBy(reference, "feature").agg(F.count("*").alias("n"), F.min("col_ix").alias("lo"), F.max("col_ix").alias("hi"))
    size = F.col("end") - F.col("start") + 1
    every = features if reference in features.columns else references.select(reference).crossJoin(F.broadcast(features))
    j = by_keys(every, got, [reference, "feature"], "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return j.select(reference, "feature", n.alias("residues_in_alignment"), (n / size).alias("coverage"), F.coalesce("lo", F.lit(-1)).alias("column_min"), F.coalesce("hi", F.lit(-1)).alias("column_max"))


def window_columns(cmap: DataFrame, anchor: Column, lo: int, hi: int, by: list[str] = []) -> DataFrame:
    """(by, col_ix): the columns of the anchor's residues lo to hi, one anchor for each group."""
    return cmap.filter(anchor & F.col("residue").between(lo, hi)).select(*by, "col_ix").distinct()


def window_extract(cells: DataFrame, cmap: DataFrame, anchor: Column, lo: int, hi: int, by: list[str] = []) -> DataFrame:
    """(by, row_id, piece): what every row has in the columns of the anchor's residues lo to hi, without gaps.

    Rows with less than half of hi - lo symbols are left out.  The window's columns are written first: they are few, which
    Spark can't guess from the map, and it would broadcast the cells instead.
    """
    columns = stash(window_columns(cmap, anchor, lo, hi, by), "columns")
    inside = by_keys(cells, columns, [*by, "col_ix"]).filter(F.col("symbol") != GAP)
    piece = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col_ix", "symbol"))), lambda x: x["symbol"]), "")
    return inside.groupBy(*by, "row_id").agg(piece.alias("piece")).filter(F.length("piece") >= 0.5 * (hi - lo))


def window_positions(cmap: DataFrame, columns: DataFrame, by: list[str] = []) -> DataFrame:
    """(by, row_id, from, to): the residue that each 1-based place of a row's piece is, by the window's columns."""
    inside = by_keys(cmap, columns, [*by, "col_ix"])
    place = F.row_number().over(Window.partitionBy(*by, "row_id").orderBy("col_ix"))  # as long as the window
    return inside.select(*by, "row_id", F.col("residue").alias("from"), place.alias("to"))


def compose(first: DataFrame, second: DataFrame, keys: list[str] = ["row_id"]) -> DataFrame:
    """Map a -> b and map b -> c (each keys, from, to) to a -> c; null keys are equal, what is mapped to nothing is left out."""
    a = first.select(*keys, F.col("from").alias("_a"), F.col("to").alias("_b")).filter("_b is not null")
    c = second.select(*keys, F.col("from").alias("_b"), F.col("to").alias("_c"))
    return sorted_by_keys(a, c, [*keys, "_b"]).select(*keys, F.col("_a").alias("from"), F.col("_c").alias("to"))


def compose_packed(maps: DataFrame, first: str, second: str, keys: list[str] = ["row_id"]) -> DataFrame:
    """``compose`` of two maps that lie in one row as structs of arrays (from, to) of integers: the same (keys, from, to), and nothing is shuffled."""
    kept = maps.select(*keys, first, second)
    types = {c: kept.schema[c].dataType for c in (first, second)}
    schema = T.StructType([kept.schema[k] for k in keys] + [T.StructField("from", types[first]["from"].dataType.elementType), T.StructField("to", types[second]["to"].dataType.elementType)])

    def entries(pairs: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Sources, targets and rows of the entries of a column of maps."""
        a, b = (x for _, x in sorted(zip([f.name for f in pairs.type], pairs.flatten(), strict=True), key=lambda x: x[0]))
        return pc.list_flatten(a), pc.list_flatten(b), pc.list_parent_indices(a).to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (a, b, own), (at, c, other) = (entries(batch.column(i)) for i in (first, second))
            # what is null meets nothing
            left, right = (np.flatnonzero(x.is_valid().to_numpy(zero_copy_only=False)) for x in (b, at))
            x, y = (v.take(pa.array(i)).cast(pa.int64()).to_numpy() for v, i in ((b, left), (at, right)))
            # numbers of the values that occur, so that (row, value) is one number
            values = np.unique(np.concatenate([x, y]))
            code = lambda row, v: row * (len(values) + 1) + np.searchsorted(values, v)
            asked, held = code(own[left], x), code(other[right], y)
            order = np.argsort(held, kind="stable")
            lo, hi = (np.searchsorted(held[order], asked, side) for side in ("left", "right"))
            n = hi - lo
            met = right[order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]]
            source = np.repeat(left, n)
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(own[source])) for k in keys), a.take(pa.array(source)), c.take(pa.array(met))], [*keys, "from", "to"])

    return kept.mapInArrow(run, schema)


def column_features(columns: DataFrame, intervals: list[tuple[str, int, int]]) -> DataFrame:
    """``features``: names of the column intervals that hold col_ix, as a sorted array."""
    names = F.array(*(F.when(F.col("col_ix").between(a, b), F.lit(n)) for n, a, b in intervals))
    return columns.withColumn("features", F.array_sort(F.filter(names, lambda x: x.isNotNull())))


def invariant(df: DataFrame, ok: Column, message: str) -> DataFrame:
    """The rows, failing at run time at the first that is not as it must be."""
    return df.filter(F.assert_true(ok, F.lit(message)).isNull())


def missing(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``wanted`` whose keys ``have`` lacks; null keys are equal."""
    named = have.select(*(F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)))
    return wanted.join(named, all_of([wanted[k].eqNullSafe(named[f"_h{i}"]) for i, k in enumerate(keys)]), "left_anti")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
