"""SimHash near-duplicates: fingerprints linked at few differing bits, and their connected components.

Every segment of ``width`` bits of a fingerprint is mapped to its number of set
bits.  A differing bit moves one of these counts by one, so the Manhattan distance
of two such vectors is at most the fingerprints' Hamming distance.  Of two
fingerprints that differ in at most ``2 * REACH`` = 4 bits one half differs in at
most two, so that this half's vectors lie at Manhattan distance two or less and
some grid point lies within one of both.  The range join is therefore an equi-join:
each fingerprint is entered at the grid points within one of its vectors, about 50
in all, and those that share a point are verified by their bits.

Distinct fingerprints are joined, not documents: any number of equal ones is one
row.  A grid point with more than ``CELL`` fingerprints is never expanded into
pairs: in rounds, all of them are held against a changing hub (a combinable
aggregate) and components are formed, until a round finds no link; what still is
in another component than most of the point's fingerprints is then compared, block
by block, with all of them.  Kernels return spanning edges, not pairs.  No cap
drops a link.

``width`` is 2 up to ``WIDE`` distinct fingerprints and 1 beyond (finer grid, more
entries); the result is exact with either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridstat.sources.scratch import discard, stash

from . import spread
from .arrowtext import trim
from .components import components

SHINGLE, SEED, LINK = 4, 42, 4
CELL = 100
WIDE = 1 << 24
ROUNDS = 12
#: Rows of grid points that a kernel compares at once, and shingles that it counts at once.
ROWS, COUNTED = 100_000, 1 << 15
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint_of(text: str | None, k: int = SHINGLE, seed: int = SEED) -> int:
    """The majority of each bit over the XXH64 of all k-word shingles, as a signed number; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # at U+0020 and U+0009-000D
    if not words:
        return 0
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start, end = (end - size)[: max(len(words) - k + 1, 1)].tolist(), end[min(k, len(words)) - 1 :].tolist()
    joined, xxh = b" ".join(words), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for i in range(0, len(start), COUNTED):
        spans = zip(start[i : i + COUNTED], end[i : i + COUNTED], strict=True)
        h = np.fromiter((xxh(joined[a:b], seed) for a, b in spans), "<u8")
        ones += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(start), bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def fingerprint(text: pd.Series) -> pd.Series:
    return text.map(fingerprint_of).astype("int64")


def grid_points(fp: Column, width: int) -> Column:
    """The numbers of the grid points within one of the vectors of both halves."""
    keys = []
    for half in (0, 1):
        bits = F.shiftrightunsigned(fp, 32 * half).bitwiseAND(F.lit(0xFFFFFFFF))
        counts = bits if width == 1 else bits - F.shiftrightunsigned(bits, 1).bitwiseAND(F.lit(0x55555555))
        own = counts + F.lit(half << 33)
        for step in (1, -1):
            # a count goes up where it is not full and down where it is not zero
            full = 0 if step < 0 else width
            count = [F.shiftrightunsigned(counts, i).bitwiseAND(F.lit(3 if width == 2 else 1)) for i in range(0, 32, width)]
            keys += [F.when(c != full, own + F.lit(step * (1 << i * width))) for i, c in enumerate(count)]
        keys.append(own)
    return F.array_compact(F.array(*keys))


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) that join what the links a - b join."""
    node, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(node))
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        for end in (a, b):
            np.minimum.at(label, end, least)
            np.minimum.at(label, before[end], least)
        label = label[label]
        if (label == before).all():
            break
    other = label != np.arange(len(node))
    return node[other], node[label[other]]


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    node, least = spanning(np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64),) * 2
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(least, pa.int64())], ["a", "b"])


def _within(cells: DataFrame, bits: int) -> DataFrame:
    """Spanning edges of the links among the fingerprints of each grid point, of which none has very many."""

    def compare(cell: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b, lag = [], [], 1
        near = np.arange(len(cell))
        while len(near):
            near = near[near + lag < len(cell)]
            near = near[cell[near] == cell[near + lag]]
            hit = near[np.bitwise_count((fp[near] ^ fp[near + lag]).view(np.uint64)) <= bits]
            a.append(fp[hit])
            b.append(fp[hit + lag])
            lag += 1
        return _edges(a, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for x in batches:
            held.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
            if sum(len(c) for c, _ in held) < ROWS:
                continue
            cell, fp = (np.concatenate(v) for v in zip(*held, strict=True))
            last = int(np.searchsorted(cell, cell[-1]))  # the last point may go on in the next batch
            yield compare(cell[:last], fp[:last])
            held = [(cell[last:], fp[last:])]
        if held:
            yield compare(*(np.concatenate(v) for v in zip(*held, strict=True)))
        trim()

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def _between(blocks: DataFrame, bits: int) -> DataFrame:
    """Spanning edges of the links between two blocks (fx, rx) and (fy, ry) of fingerprints of other components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for row in range(x.num_rows):
                fx, rx, fy, ry = (c[row].values.to_numpy() for c in x.columns)
                i, j = np.nonzero((np.bitwise_count((fx[:, None] ^ fy[None, :]).view(np.uint64)) <= bits) & (rx[:, None] != ry[None, :]))
                yield _edges([fx[i]], [fy[j]])
        trim()

    return blocks.select("fx", "rx", "fy", "ry").mapInArrow(run, "a long, b long")


def _rooted(rows: DataFrame, root: DataFrame | None) -> DataFrame:
    if root is None:
        return rows.withColumn("root", F.col("fp"))
    return rows.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _crowded(members: DataFrame, hot: DataFrame, links: DataFrame, bits: int) -> DataFrame:
    """``links`` and those within grid points of very many fingerprints."""
    root = stash(components(links), "components")
    differ = F.bit_count(F.col("fp").bitwiseXOR(F.col("hub.fp")))
    for turn in range(ROUNDS):
        now = stash(_rooted(members, root), "placed")
        hubs = now.groupBy("cell").agg(F.min_by(F.struct("fp", "root"), F.xxhash64("fp", "cell", F.lit(turn))).alias("hub"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        told = spread.join(now, hubs.filter("lo < hi").select("cell", "hub"), hot, ["cell"], F.col("fp"))
        # one edge joins two components, by their names
        found = stash(told.filter((F.col("root") != F.col("hub.root")) & (differ <= bits)).select(F.col("root").alias("a"), F.col("hub.root").alias("b")).distinct(), "links")
        discard(now)
        if found.isEmpty():
            break
        links = links.unionByName(found)
        root, old = stash(components(links), "components"), root
        discard(old)
    # what still is apart from most of its point meets all of it, in blocks
    now = stash(_rooted(members, root), "placed")
    sizes = now.groupBy("cell", "root").agg(F.count("*").alias("n")).groupBy("cell").agg(F.max_by("root", "n").alias("most"), F.count("*").alias("roots")).filter("roots > 1")
    mixed = stash(spread.join(now, sizes.select("cell", "most"), hot, ["cell"], F.col("fp")), "mixed")
    cut = spread.cut(mixed, hot, ["cell"], F.col("fp"))
    block = lambda rows, n: rows.groupBy("cell", "cut").agg(F.collect_list("fp").alias(f"f{n}"), F.collect_list("root").alias(f"r{n}")).drop("cut")
    more = stash(_between(block(cut.filter("root != most"), "x").join(block(cut, "y"), "cell"), bits).distinct(), "links")
    discard(now, mixed, root)
    return links.unionByName(more)


def classes(docs: DataFrame, bits: int = LINK, width: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id (least doc_id of its component).

    Null, empty and blank texts have fingerprint 0 and are linked like any other; a text of fewer words than a shingle is
    one shingle.  Rows are linked as rows, so that null and repeated doc_ids are allowed: a component's name is its least
    doc_id that is not null, or null where it has none.  doc_id may have any type that has an order.  Other columns are not
    read.  An empty table gives an empty one.  A text is held by one task, its shingles are counted ``COUNTED`` at a time.
    """
    if not 0 <= bits <= LINK:
        raise ValueError(f"the grid finds links of at most {LINK} bits")
    rows = stash(docs.select("doc_id", fingerprint("text").alias("fp"), F.monotonically_increasing_id().alias("row")), "fingerprints")
    kinds = stash(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "kinds")
    width = width or (2 if kinds.count() <= WIDE else 1)
    cells = kinds.select(F.explode(grid_points(F.col("fp"), width)).alias("cell"), "fp")
    hot = spread.hot_keys(cells.groupBy("cell").agg(F.count("*").alias("n")), ["cell"], each=CELL)
    crowded = not hot.isEmpty()
    links = stash(_within(cells.join(hot, "cell", "left_anti") if crowded else cells, bits), "links").distinct()
    if crowded:
        members = stash(cells.join(hot.select("cell"), "cell", "left_semi"), "members")
        links = _crowded(members, hot, links, bits)
        discard(members)
    root = stash(components(links), "components")
    named = kinds.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stash(named.join(least, "root").select("fp", "component_id", "n"), "named")
    discard(hot, root)
    out = spread.join(rows, named.drop("n"), spread.hot_keys(named, ["fp"]), ["fp"], F.col("row"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
