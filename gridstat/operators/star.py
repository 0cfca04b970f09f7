"""Multiple alignment around an anchor: every sequence is aligned with its group's anchor, and insertions share columns.

A first pass cuts windows out of whole sequences; this is the second, which aligns the pieces anew.  The work of a row is
its own pairwise alignment.  What rows have to know of one another is only how many symbols any of them inserts before each
place of the anchor, a maximum by group and place, which is combined before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridstat.functions.alignment import align_many
from gridstat.functions.ordered import by_keys, sorted_by_keys
from gridstat.sources.scratch import stash

from .mapping import compose_packed
from .matrix import GAP


def traces(rows: DataFrame, scores: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """``rows`` (seq, anchor and others) with ``_faced``, the symbol at each place of the anchor or a gap, and ``_inserted``, the symbols before each place.

    Only places with an insertion are in the map; what follows the anchor's last place is at its length.  A row that
    faces the anchor nowhere is there as a whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs, anchors = ([t or "" for t in b.column(c).to_pylist()] for c in ("seq", "anchor"))
            _, k, i, j = align_many(seqs, anchors, scores)
            edges = np.searchsorted(k, np.arange(len(seqs) + 1))
            faced, inserted = [], []
            for r, (seq, anchor) in enumerate(zip(seqs, anchors, strict=True)):
                own, at = i[edges[r] : edges[r + 1]], j[edges[r] : edges[r + 1]]
                line = np.full(len(anchor), GAP)
                if len(own):
                    line[at] = np.array(list(seq))[own]
                faced.append("".join(line))
                # symbols between two faced ones stand before the second; those of the end after the anchor
                first, last = np.append(0, own + 1), np.append(own, len(seq))
                some = np.flatnonzero(last > first)
                place = np.append(at, len(anchor))[some]
                inserted.append([(int(p), seq[s:e]) for p, s, e in zip(place, first[some], last[some], strict=True)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(faced, pa.string()), pa.array(inserted, pa.map_(pa.int32(), pa.string()))], [*b.schema.names, "_faced", "_inserted"])

    schema = T.StructType([*rows.schema.fields, T.StructField("_faced", T.StringType()), T.StructField("_inserted", T.MapType(T.IntegerType(), T.StringType()))])
    return rows.mapInArrow(run, schema)


def star_alignment(rows: DataFrame, anchors: DataFrame, by: list[str], scores: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """(by, row_id, symbols): the rows (by, row_id, seq) as a rectangular matrix of each group around its anchor (by, anchor).

    Columns that no place of the anchor owns hold insertions, from the left.  Taking the gaps out of a row gives its sequence
    again.  Null groups are a group; a null sequence is an empty one, and a row of gaps; groups without an anchor have no rows,
    and one with several anchors stops the query.
    """
    one = anchors.groupBy(*by).agg(F.min("anchor").alias("anchor"), F.count("*").alias("_n"))
    one = one.filter(F.assert_true(F.col("_n") == 1, F.lit("a group has several anchors")).isNull()).drop("_n")
    # few bytes make much work: rows are dealt over all cores, not by size
    dealt = rows.select(*by, "row_id", F.coalesce("seq", F.lit("")).alias("seq")).repartition(rows.sparkSession.sparkContext.defaultParallelism)
    traced = stash(traces(by_keys(dealt, stash(one, "anchors"), by), scores), "traces")
    places = traced.select(*by, F.explode("_inserted").alias("_place", "_piece"))
    widest = places.groupBy(*by, "_place").agg(F.max(F.length("_piece")).alias("_width"))
    # as many entries as an anchor has places, whatever the number of rows
    widths = widest.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_place", "_width"))).alias("_widths"))
    laid = by_keys(traced, widths, by, "left")
    own = lambda p: F.coalesce(F.col("_inserted")[p], F.lit(""))
    columns = F.transform(F.sequence(F.lit(0), F.length("anchor")), lambda p: F.concat(F.rpad(own(p), F.coalesce(F.col("_widths")[p], F.lit(0)), GAP), F.substring("_faced", p + 1, F.lit(1))))
    return laid.select(*by, "row_id", F.array_join(columns, "").alias("symbols"))


def canonical_columns(positions: DataFrame, aligned: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, from, to): the column of the second pass that each canonical residue is in.

    positions has (keys, from, to): the canonical residue at each 1-based place of a piece; aligned has (keys, symbols), one
    row for each keys.  Both maps of a row lie in it and are composed there, so that no row is made for a cell.
    """
    entries = F.collect_list(F.struct("from", "to")).alias("_e")
    first = positions.groupBy(*keys).agg(entries).select(*keys, F.struct(F.col("_e")["from"].alias("from"), F.col("_e")["to"].alias("to")).alias("_first"))
    held = F.filter(F.transform(F.split("symbols", ""), lambda x, i: F.when(~x.isin(GAP, ""), i)), lambda i: i.isNotNull())
    second = aligned.select(*keys, held.alias("_to")).select(*keys, F.struct(F.transform("_to", lambda _, i: i + 1).alias("from"), F.col("_to").alias("to")).alias("_second"))
    return compose_packed(sorted_by_keys(first, second, keys), "_first", "_second", keys)


def column_violations(columns: DataFrame, aligned: DataFrame, canonical: DataFrame, keys: list[str]) -> DataFrame:
    """Entries of ``canonical_columns`` whose column holds another letter than the canonical sequence (keys, residue, letter), or that one of them lacks.

    aligned has one row for each keys.  What is known of a row is brought together once and compared in it, as ``map_violations`` does.
    """
    told = columns.select(*keys, F.col("from").alias("residue"), "to", F.lit(None).cast("string").alias("letter"), F.lit(True).alias("_held"))
    told = told.unionByName(canonical.select(*keys, "residue", F.lit(None).cast("int").alias("to"), "letter", F.lit(False).alias("_held")))
    packed = told.groupBy(*keys).agg(F.collect_list(F.struct("residue", "to", "letter", "_held")).alias("_told"))
    joined = sorted_by_keys(packed, aligned.select(*keys, "symbols"), keys, "left")
    schema = T.StructType([*(joined.schema[k] for k in keys), T.StructField("residue", told.schema["residue"].dataType), T.StructField("symbol", T.StringType()), T.StructField("letter", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            told, texts = b.column("_told"), [t or "" for t in b.column("symbols").to_pylist()]
            row, (residue, to, letter, held) = pc.list_parent_indices(told).to_numpy(), pc.list_flatten(told).flatten()
            held = held.to_numpy(zero_copy_only=False)
            size = np.array([len(t) for t in texts], np.int64)
            # what is nowhere is at the gap behind all symbols
            symbols = np.array([*"".join(texts), GAP], object)
            to = pc.fill_null(to.cast(pa.int64()), -1).to_numpy()
            at = np.where((to >= 0) & (to < size[row]), (np.cumsum(size) - size)[row] + to, len(symbols) - 1)
            known = pd.DataFrame({"row": row, "null": residue.is_null().to_numpy(zero_copy_only=False), "residue": pc.fill_null(residue.cast(pa.int64()), 0).to_numpy()})
            own = known[held].assign(symbol=symbols[at[held]])
            both = own.merge(known[~held].assign(letter=np.array(letter.to_pylist(), object)[~held]), "outer", ["row", "null", "residue"])
            symbol, letter = (both[c].astype(object).where(both[c].notna(), None) for c in ("symbol", "letter"))
            both = both.assign(symbol=symbol, letter=letter)[[x != y for x, y in zip(symbol, letter, strict=True)]]
            residues = pa.array(both["residue"].to_numpy(), mask=both["null"].to_numpy(bool)).cast(residue.type)
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(both["row"].to_numpy())) for k in keys), residues, *(pa.array(both[c].to_list(), pa.string()) for c in ("symbol", "letter"))], schema.names)

    return joined.mapInArrow(run, schema)
