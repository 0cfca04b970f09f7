"""What must hold of a table, counted in the very run that writes it.

A check is an aggregate that Spark observes while the rows pass by, so that it costs no second scan and no driver loop.
A table that fails is deleted and never handed on; the error names every check that failed and by how many rows.
Checks that compare tables come down to rows of one: ``presence``, ``round_trips``, ``extents`` and others below make them.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gridstat.functions.ordered import by_keys, sorted_by_keys
from gridstat.sources.scratch import discard, stash

from .matrix import GAP


@dataclass(frozen=True)
class Check:
    """SQL over a row's columns: ``holds`` is true of all rows that ``among`` names but a share below ``share`` (of none, where that is 0); null is not true.

    With ``some`` there must be a row to judge.
    """

    name: str
    holds: str
    among: str = "true"
    share: float = 0.0
    some: bool = False

    def fails(self, rows: int, wrong: int) -> bool:
        return (self.some and not rows) or (wrong > 0 and not wrong < self.share * rows)


def audit(df: DataFrame, checks: Iterable[Check], name: str = "audited") -> tuple[DataFrame, dict[str, tuple[int, int]]]:
    """The table, written, and for each check how many rows it judged and how many it found wrong.

    Where an executor is lost, rows that are computed again may be counted again: none stays none, and shares are those of the runs.
    """
    checks, seen = list(checks), Observation()
    exprs = []
    for i, c in enumerate(checks):
        exprs += [F.expr(f"count(CASE WHEN {c.among} THEN 1 END)").alias(f"n{i}"), F.expr(f"count(CASE WHEN ({c.among}) AND NOT coalesce({c.holds}, false) THEN 1 END)").alias(f"w{i}")]
    out = stash(df.observe(seen, *exprs), name)
    got = seen.get
    return out, {c.name: (got[f"n{i}"], got[f"w{i}"]) for i, c in enumerate(checks)}


def checked(df: DataFrame, checks: Iterable[Check], name: str = "checked") -> DataFrame:
    """The table, written, if all checks hold of it; else an error, and no table."""
    checks = list(checks)
    out, found = audit(df, checks, name)
    failed = [f"{c.name}: {found[c.name][1]} of {found[c.name][0]} rows" for c in checks if c.fails(*found[c.name])]
    if failed:
        discard(out)
        raise ValueError("; ".join(failed))
    return out


def presence(wanted: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Each wanted key once, with ``found``: does ``have`` hold it?  Null keys are equal."""
    there = have.select(*keys).distinct().withColumn("_there", F.lit(True))
    return by_keys(wanted.select(*keys).distinct(), there, keys, "left").select(*keys, F.coalesce("_there", F.lit(False)).alias("found"))


def all_present(what: str) -> list[Check]:
    """Of ``presence``: forced references, the window's anchor after extraction, features, scopes, canonical sequences."""
    return [Check(f"{what} is missing", "found")]


def extents(rows: DataFrame, by: list[str], symbols: str = "symbols") -> DataFrame:
    """(by, shortest, longest): lengths of a group's rows."""
    size = F.coalesce(F.length(symbols), F.lit(0))
    return rows.groupBy(*by).agg(F.min(size).alias("shortest"), F.max(size).alias("longest"))


RECTANGULAR = [Check("rows of a group differ in length", "shortest = longest")]


def weight_sums(rows: DataFrame, by: list[str], weight: str = "weight") -> DataFrame:
    """(by, n_unusable, total): weights that are no finite number of 0 or more, and the sum of the others."""
    w = F.col(weight).cast("double")
    fine = w.isNotNull() & ~F.isnan(w) & (w >= 0) & (w < float("inf"))
    return rows.groupBy(*by).agg(F.count(F.when(~fine, 1)).alias("n_unusable"), F.coalesce(F.sum(F.when(fine, w)), F.lit(0.0)).alias("total"))


WEIGHED = [Check("a weight is not finite", "n_unusable = 0", some=True), Check("weights sum to nothing", "total > 0", some=True)]


def round_trips(forward: DataFrame, backward: DataFrame, canonical: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, residue, letter, col_ix, symbol, n, back): canonical residues beside what the map makes of them.

    forward has (keys, residue, col_ix, symbol), backward (keys, col_ix, residue), canonical (keys, residue, letter).  ``n``
    says how often the map names a residue; one that only the map has is there with a null letter.  Nothing is joined by
    residue: both sides are grouped, so that null keys are equal and neither side has to be the smaller.
    """
    one = canonical.select(*keys, "residue", "letter")
    both = one.unionByName(forward.select(*keys, "residue", "col_ix", "symbol"), allowMissingColumns=True)
    met = both.groupBy(*keys, "residue").agg(F.max("letter").alias("letter"), F.max("col_ix").alias("col_ix"), F.max("symbol").alias("symbol"), F.count("symbol").alias("n"))
    back = backward.groupBy(*keys, "col_ix").agg(F.min("residue").alias("back"))
    return sorted_by_keys(met, back, [*keys, "col_ix"], "left")


ROUND_TRIP = [
    Check("a canonical residue is not mapped once", "letter IS NOT NULL AND n = 1"),
    Check("a column holds another letter", "symbol = letter"),
    Check("a column leads back to another residue", "back = residue"),
]

#: Of rows (piece, positions): a piece has a canonical position for each symbol.
PIECES = [Check("a piece and its positions differ in length", "length(piece) = size(positions)")]


def provenance_counts(columns: DataFrame, by: list[str], required: list[str], foreign: list[str]) -> DataFrame:
    """(by, n_columns, n_anchored, n_outside, n_foreign) of columns (by, anchored, features array<string>): anchored ones in no required feature, and any in a foreign one."""
    holds = lambda names: F.coalesce(F.arrays_overlap("features", F.array(*map(F.lit, names)).cast("array<string>")), F.lit(False))
    count = lambda c: F.count(F.when(c, 1))
    return columns.groupBy(*by).agg(F.count("*").alias("n_columns"), count(F.col("anchored")).alias("n_anchored"), count(F.col("anchored") & ~holds(required)).alias("n_outside"), count(holds(foreign)).alias("n_foreign"))


PROVENANCE = [
    Check("a fifth of the anchored columns lie outside the required features", "n_outside < 0.2 * greatest(n_anchored, 1)"),
    Check("columns carry features of another family", "n_foreign = 0"),
]

#: Of rows (n_observed, n_mapped, n_equal): how well chains are aligned with their canonical sequence.
ALIGNED = [
    Check("too few residues are mapped", "n_mapped > 0.9 * n_observed", "n_observed > 0"),
    Check("too few mapped residues are equal", "n_equal > 0.95 * greatest(n_mapped, 1)", "n_observed > 0"),
]

#: Of variants (declared, observed): the declared letter stands in the alignment; those outside of it (null) are not judged.
DECLARED = [Check("the alignment holds another letter than declared", f"observed = declared AND observed != '{GAP}'", "observed IS NOT NULL")]
