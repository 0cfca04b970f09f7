"""Alignment of chains with free end gaps, coordinate transfer by it, and exposed area."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridstat.functions.alignment import align_many

PROBE = 1.4
POINTS = 100


def align(a: str, b: str, scores: dict[tuple[str, str], float] | None = None) -> list[tuple[int, int]]:
    """Places (i, j) that face one another in the best alignment of two texts; gaps at either end are free."""
    _, _, i, j = align_many([a], [b], scores)
    return list(zip(i.tolist(), j.tolist(), strict=True))


def alignment_scores(chains: DataFrame, scores: dict[tuple[str, str], float] | None = None) -> DataFrame:
    """(chain, score, n_mapped, n_equal) of rows (chain, observed, canonical): the best alignment's score, its pairs and those of equal letters.

    ``scores`` is a substitution table, of a size that the alphabet bounds; a null text is an empty one, which scores 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([t or "" for t in b.column(c).to_pylist()] for c in ("observed", "canonical"))
            top, k, _, _, same = _faced(x, y, scores)
            n = lambda w=None: pa.array(np.bincount(k, w, len(x)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("chain"), pa.array(top), n(), n(same)], ["chain", "score", "n_mapped", "n_equal"])

    kept = chains.select("chain", "observed", "canonical")
    schema = T.StructType([kept.schema["chain"], T.StructField("score", T.DoubleType()), T.StructField("n_mapped", T.LongType()), T.StructField("n_equal", T.LongType())])
    return kept.mapInArrow(run, schema)


def _faced(x: list[str], y: list[str], scores: dict[tuple[str, str], float] | None) -> tuple[np.ndarray, ...]:
    """Scores, (k, i, j) of the places that face one another, and whether their letters are equal."""
    top, k, i, j = align_many(x, y, scores)
    flat = lambda t: np.frombuffer("".join(t).encode("utf-32-le"), "<u4")
    start = lambda t: np.cumsum([0, *map(len, t)])[:-1].astype(np.int64) if t else np.zeros(0, np.int64)
    return top, k, i, j, flat(x)[start(x)[k] + i] == flat(y)[start(y)[k] + j]


def map_to_canonical(chains: DataFrame, scores: dict[tuple[str, str], float] | None = None, min_coverage: float = 0.9, min_identity: float = 0.95) -> DataFrame:
    """(chain, auth, canonical) from rows (chain, numbers array<int>, observed, canonical): the residue that each observed one is.

    Chains are aligned with the substitution table ``scores``, gaps at either end free.  A chain of which no more than
    ``min_coverage`` is mapped, or no more than ``min_identity`` of that is equal, stops the query; one without residues has no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = ([t or "" for t in b.column(c).to_pylist()] for c in ("observed", "canonical"))
            _, k, i, j, same = _faced(x, y, scores)
            size, mapped, equal = np.array([len(t) for t in x]), np.bincount(k, minlength=len(x)), np.bincount(k, same, len(x))
            wrong = np.flatnonzero((size > 0) & ((mapped <= min_coverage * size) | (equal <= min_identity * mapped)))
            if len(wrong):
                w = wrong[0]
                raise ValueError(f"chain {b.column('chain')[int(w)]}: {mapped[w]} of {size[w]} residues mapped, {int(equal[w])} equal")
            numbers = b.column("numbers")
            starts = numbers.offsets.to_numpy()[:-1] - numbers.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([b.column("chain").take(pa.array(k)), numbers.flatten().take(pa.array(starts[k] + i)).cast(pa.int32()), pa.array((j + 1).astype(np.int32))], ["chain", "auth", "canonical"])

    kept = chains.filter(F.length("observed") > 0).select("chain", "numbers", "observed", "canonical")
    schema = T.StructType([kept.schema["chain"], T.StructField("auth", T.IntegerType()), T.StructField("canonical", T.IntegerType())])
    return kept.mapInArrow(run, schema)


#: A block is so many times as wide as the farthest that two atoms touch.
WIDTH = 4
#: Pairs of touching atoms that are tested at once.
PAIRS = 8192


def sphere(points: int) -> np.ndarray:
    """Directions spread over a sphere along a spiral by the golden section."""
    k = np.arange(points) + 0.5
    polar, turn = np.arccos(1 - 2 * k / points), np.pi * (1 + 5**0.5) * k
    return np.stack([np.cos(turn) * np.sin(polar), np.sin(turn) * np.sin(polar), np.cos(polar)], axis=1)


def _touching(xyz: np.ndarray, radius: np.ndarray, own: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of an atom of ``own`` and another whose spheres meet, all of an i together, by cells as wide as ``reach``."""
    cell = np.floor(xyz / reach).astype(np.int64)
    cell -= cell.min(axis=0) - 1
    shape = cell.max(axis=0) + 2
    code = lambda c: (c[..., 0] * shape[1] + c[..., 1]) * shape[2] + c[..., 2]
    flat = code(cell)
    order = np.argsort(flat, kind="stable")
    flat = flat[order]
    around = np.stack(np.meshgrid(*[(-1, 0, 1)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    asked = code(cell[own][:, None] + around)
    lo, hi = np.searchsorted(flat, asked, "left"), np.searchsorted(flat, asked, "right")
    size = (hi - lo).sum(axis=1)
    edges = np.cumsum(size)
    at = 0
    while at < len(own):
        end = max(at + 1, int(np.searchsorted(edges, (edges[at - 1] if at else 0) + PAIRS * 8, "right")))
        n = (hi - lo)[at:end].ravel()
        first = np.repeat(lo[at:end].ravel() - (np.cumsum(n) - n), n)
        j = order[first + np.arange(n.sum())]
        i = np.repeat(own[at:end], size[at:end])
        gap = xyz[i] - xyz[j]
        near = ((gap * gap).sum(axis=1) < (radius[i] + radius[j]) ** 2) & (i != j)
        yield i[near], j[near]
        at = end


def exposed_area(atoms: DataFrame, points: int = POINTS, probe: float = PROBE) -> DataFrame:
    """(chain, residue, sasa) of atoms (chain, residue, x, y, z, radius): the share of points on each atom's sphere that no neighbour of its chain covers.

    Space is cut into blocks of ``WIDTH`` times the farthest reach of two atoms, and an atom goes to its own block and, as a
    halo, to those that its neighbours may lie in: at most eight.  Blocks are independent, so a chain of any size is spread
    over tasks; a block holds what fits into it, and finds neighbours by cells of its own.  Atoms of one place and radius do not cover
    one another.  Rows without a place or radius are left out; null chains are a chain.
    """
    a = atoms.select("chain", F.col("residue").cast("int").alias("residue"), *(F.col(c).cast("double").alias(c) for c in "xyz"), (F.col("radius").cast("double") + probe).alias("r")).dropna(subset=["x", "y", "z", "r"])
    widest = a.agg(F.max("r").alias("_most"))  # one row
    reach = 2.0 * F.col("_most") * (1 + 1e-9)
    sized = a.crossJoin(F.broadcast(widest)).withColumns({"_reach": reach, "_side": reach * WIDTH})
    for c in "xyz":
        sized = sized.withColumns({f"_o{c}": F.floor(F.col(c) / F.col("_side")), f"_b{c}": F.explode(F.sequence(F.floor((F.col(c) - F.col("_reach")) / F.col("_side")), F.floor((F.col(c) + F.col("_reach")) / F.col("_side"))))})
    mine = (F.col("_ox") == F.col("_bx")) & (F.col("_oy") == F.col("_by")) & (F.col("_oz") == F.col("_bz"))
    halo = sized.withColumn("_own", mine).select("chain", "_bx", "_by", "_bz", "residue", "x", "y", "z", "r", "_reach", "_own")

    def run(block: pa.Table) -> pa.Table:
        own = np.flatnonzero(block.column("_own").to_numpy())
        if not len(own):
            return block.select(["chain", "residue"]).slice(0, 0).append_column("area", pa.array([], pa.float64()))
        xyz = np.stack([block.column(c).to_numpy() for c in "xyz"], axis=1)
        radius = block.column("r").to_numpy()
        unit = sphere(points)
        free = np.full(len(xyz), points)
        for i, j in _touching(xyz, radius, own, block.column("_reach")[0].as_py()):
            if not len(i):
                continue
            first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
            covered = np.zeros((len(first), points), bool)
            group = np.cumsum(np.append(True, i[1:] != i[:-1])) - 1
            for at in range(0, len(i), PAIRS):
                p, q, g = i[at : at + PAIRS], j[at : at + PAIRS], group[at : at + PAIRS]
                gap = xyz[p] - xyz[q]
                # |gap + r u| < r' without the points themselves
                far = (gap * gap).sum(axis=1) + radius[p] ** 2 - radius[q] ** 2
                inside = 2 * radius[p][:, None] * (gap @ unit.T) < -far[:, None]
                starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
                covered[g[starts]] |= np.logical_or.reduceat(inside, starts, axis=0)
            free[i[first]] = points - covered.sum(axis=1)
        area = 4 * np.pi * radius[own] ** 2 * free[own] / points
        at = pa.array(own)
        return pa.table({"chain": block.column("chain").take(at), "residue": block.column("residue").take(at), "area": area})

    schema = T.StructType([halo.schema["chain"], T.StructField("residue", T.IntegerType()), T.StructField("area", T.DoubleType())])
    return halo.groupBy("chain", "_bx", "_by", "_bz").applyInArrow(run, schema).groupBy("chain", "residue").agg(F.sum("area").alias("sasa"))
