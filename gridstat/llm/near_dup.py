"""Near-duplicate classes by dart-throwing MinHash.

A document is a weighted set of word shingles.  Every element has a fixed random
stream of darts: points of a Poisson process over rank (time of arrival) and
weight, each aimed at one of ``COORDS`` coordinates.  A document sees the darts
that lie below its elements' weights and keeps the earliest of each coordinate,
so two documents agree in a coordinate with the probability of their weighted
Jaccard similarity.  Darts are thrown in order of rank until every coordinate is
filled; that takes elements + t log t throws, not elements * t.

``BANDS`` bands of ``ROWS`` coordinates give the join keys.  At similarity 0.8 a
pair shares no band with probability (1 - 0.8 ** 4) ** 24 = 3e-6.  Documents with
the same shingles are one class from the start.  Candidates are checked exactly
on their shingle sets; only pairs that pass are links, and classes are the
connected components.

Buckets are never expanded into all their pairs.  In rounds, each bucket names a
hub by a hash (a combinable aggregate, so that a bucket of any size takes no
single task); each member of another component than the hub's is checked against
the hub, of all its buckets, whose signature is nearest; then components are
formed anew.
When a round links few, what is left is completed exactly, without comparing all
members of a bucket: let D be the shingles in which a document differs from its
bucket's hub.  Two documents are similar only if their D differ little; if not
both are similar to the hub, they then share more than half of a D.  So the
rarest half of a D must meet the other (prefix filtering).  Copies of one text
with edits of their own never do, however many they are.  Documents far from
their hub are compared by their own shingles in the same way.
Pairs whose signatures agree in fewer than ``NEAR`` coordinates are not looked at
again: fewer agree at 0.8 with probability below 1e-8; with 0 every candidate is.
A bucket or group of copies with very many members is cut wherever it is joined
with its one hub or representative (``spread``).

Defined cases: texts of one to four words are one shingle; texts without words
(empty ones too) are one class, null texts are each their own; a null doc_id
is judged like the others (and is the class id of none); rows with equal doc_id
and text are one class; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridstat.sources.scratch import discard, stash

from . import spread
from .arrowtext import Texts, Words, alnum_table, mix, texts, trim, window_hashes
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
COORDS = 96
ROWS = 4
BANDS = COORDS // ROWS
NEAR = 53
ROUNDS = 12
#: The rounds end when fewer than one in so many checked pairs is a link.
SLOW = 20
#: Jaccard distance from the hub up to which differences from it are looked at.
FAR = 0.8
_U = np.uint64
SIGNATURE_SCHEMA = "row string, doc_id long, n long, f1 long, f2 long, bands array<long>, sig binary"


def shingle_sets(t: Texts, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles (52-bit hashes, sorted within a row), how often each occurs, and each row's range."""
    w = Words(t, alnum_table())
    h, at = window_hashes(w, k)
    row = w.row[at]
    short = np.flatnonzero((np.diff(w.off) > 0) & (np.diff(w.off) < k))
    extra = np.zeros(len(short), _U)
    for i in range(k - 1):
        has = w.off[short] + i < w.off[short + 1]
        extra[has] = mix(extra[has] * _U(31) + w.hash[w.off[short[has]] + i])
    key = np.sort(np.concatenate([(row.astype(_U) << _U(52)) | (h >> _U(12)), (short.astype(_U) << _U(52)) | (extra >> _U(12))]))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    off = np.searchsorted(key >> _U(52), np.arange(t.n + 1).astype(_U))
    return key & _U((1 << 52) - 1), count, off


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashes to numbers in (0, 1]."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(element: np.ndarray, weight: np.ndarray, off: np.ndarray, coords: int = COORDS) -> np.ndarray:
    """Rows of ``coords`` 64-bit names of the earliest darts; a row without weight has zeros.

    ``off`` gives each row's range of elements; an element's weight is a positive number.
    """
    n = len(off) - 1
    row = np.repeat(np.arange(n), np.diff(off))
    cells = np.ceil(weight).astype(np.int64)
    # one stream of darts for each element and each unit of weight, the last unit perhaps seen in part
    unit = np.arange(int(cells.sum())) - np.repeat(np.cumsum(cells) - cells, cells)
    src = np.repeat(np.arange(len(element)), cells)
    seed = mix(element[src] * _U(0xD1342543DE82EF95) + unit.astype(_U) * _U(0x2545F4914F6CDD1D) + _U(1))
    seen = np.minimum(weight[src] - unit, 1.0)
    row = row[src]
    total = np.bincount(row, seen, n)
    full = total > 0
    # so many ranks that a coordinate stays empty in about one row of a hundred
    limit = np.zeros(n)
    limit[full] = coords * (np.log(coords) + 4.6) / total[full]
    best = np.full(n * coords, np.inf)
    name = np.zeros(n * coords, _U)
    clock = np.zeros(len(seed))
    turn = np.zeros(len(seed), _U)
    live = np.arange(len(seed))
    pending = np.flatnonzero(full)
    while len(live):
        waiting = []
        while len(live):
            turn[live] += _U(1)
            x = mix(seed[live] + turn[live] * _U(0x9E3779B97F4A7C15))
            clock[live] -= np.log(_unit(x))
            late = clock[live] > limit[row[live]]
            waiting.append(live[late])
            live, x = live[~late], x[~late]
            y = mix(x ^ _U(0xA0761D6478BD642F))
            shown = ((y >> _U(40)).astype(np.float64) * 2.0**-24) < seen[live]
            thrown = live[shown]
            slot = row[thrown] * coords + ((y[shown] & _U(0xFFFFFFFF)) % _U(coords)).astype(np.int64)
            _keep(best, name, slot, clock[thrown], mix(y[shown]))
        # rows with an empty coordinate go on from where each stream stopped
        gap = np.isinf(best.reshape(n, coords)).any(axis=1) & full
        pending = pending[gap[pending]]
        if not len(pending):
            break
        limit[pending] *= 1.5
        mark = np.zeros(n, bool)
        mark[pending] = True
        held = np.concatenate(waiting)
        held = held[mark[row[held]]]
        # the arrival that was too late is still to come: undo it
        turn_back = mix(seed[held] + turn[held] * _U(0x9E3779B97F4A7C15))
        clock[held] += np.log(_unit(turn_back))
        turn[held] -= _U(1)
        live = held
    return name.reshape(n, coords)


def _keep(best: np.ndarray, name: np.ndarray, slot: np.ndarray, rank: np.ndarray, who: np.ndarray) -> None:
    better = rank < best[slot]
    slot, rank, who = slot[better], rank[better], who[better]
    order = np.argsort(-rank, kind="stable")  # of several for one slot the earliest is written last
    slot, rank, who = slot[order], rank[order], who[order]
    best[slot], name[slot] = rank, who


def sketch(docs: DataFrame, counts: bool = False, coords: int = COORDS, rows: int = ROWS) -> DataFrame:
    """Per row: a name of the row, doc_id, number of shingles, fingerprint of their set, band keys, and 16 bits of each coordinate.

    ``counts`` weighs a shingle by its occurrences instead of 1; the fingerprint then covers them.
    """
    bands = coords // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            null = b.column(1).is_null().to_numpy(zero_copy_only=False)
            for t in texts(b.column(1)):
                e, c, off = shingle_sets(t)
                weight = c.astype(np.float64) if counts else np.ones(len(e))
                name = signatures(e, weight, off, coords)
                n = np.diff(off)
                total = [np.concatenate([np.zeros(1, _U), np.cumsum(mix(e * _U(2 * k + 3) + (c.astype(_U) if counts else _U(1))), dtype=_U)]) for k in (0, 1)]
                f = [(s[off[1:]] - s[off[:-1]]).view(np.int64) for s in total]
                key = np.zeros((t.n, bands), _U)
                for j in range(rows):
                    key = mix(key * _U(0x9E3779B97F4A7C15) + name.reshape(t.n, bands, rows)[:, :, j] + np.arange(bands, dtype=_U))
                skip = null[t.first : t.first + t.n]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{part}:{at + i}" for i in range(t.n)]),
                        b.column(0).slice(t.first, t.n),
                        pa.array(np.where(skip, -1, n)),
                        pa.array(f[0]),
                        pa.array(f[1]),
                        pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(n > 0, bands, 0))]).astype(np.int32)), pa.array(key[n > 0].reshape(-1).view(np.int64))),
                        pa.array([x.tobytes() for x in (name & _U(0xFFFF)).astype("<u2")], pa.binary()),
                    ],
                    [x.split()[0] for x in SIGNATURE_SCHEMA.split(", ")],
                )
                at += t.n

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SIGNATURE_SCHEMA)


def _sets(docs: DataFrame) -> DataFrame:
    """doc_id and its sorted shingles, in 64-bit numbers one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in texts(b.column(1)):
                e, _, off = shingle_sets(t)
                cut = [e[i:j].astype("<u8").tobytes() for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(t.first, t.n), pa.array(cut, pa.binary())], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles binary")


#: Bytes and rows of shingle sets that are compared at once.
_SLICE_BYTES, _SLICE_ROWS = 8 << 20, 4096


def _slices(b: pa.RecordBatch, x: int, y: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of a batch with the sets of two of its binary columns, one after the other, and their sizes."""
    flat, offs = [], []
    for c in (b.column(x), b.column(y)):
        off = np.frombuffer(c.buffers()[1], np.int32, b.num_rows + 1, 4 * c.offset).astype(np.int64) // 8
        raw = c.buffers()[2]
        flat.append(np.frombuffer(raw, "<u8", len(raw) // 8) if raw is not None else np.empty(0, "<u8"))
        offs.append(off)
    size = offs[0] + offs[1]
    at = 0
    while at < b.num_rows:
        end = int(np.searchsorted(size, size[at] + _SLICE_BYTES // 8, "right")) - 1
        end = min(max(end, at + 1), b.num_rows, at + _SLICE_ROWS)
        yield b.slice(at, end - at), *(f[o[at] : o[end]] for f, o in zip(flat, offs, strict=True)), *(np.diff(o[at : end + 1]) for o in offs)
        at = end


def _numbered(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """52-bit shingles with the number of their row in front."""
    return np.repeat(np.arange(len(sizes), dtype=_U) << _U(52), sizes) | values


def _similar(pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose sets ``sa``, ``sb`` have at least this Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, x, y, n, m in _slices(b, 2, 3):
                both = np.sort(np.concatenate([_numbered(x, n), _numbered(y, m)]))
                same = np.bincount((both[1:][both[1:] == both[:-1]] >> _U(52)).astype(np.int64), minlength=own.num_rows)
                keep = pa.array(same >= threshold * (n + m - same))
                yield pa.RecordBatch.from_arrays([own.column(0).filter(keep), own.column(1).filter(keep)], ["a", "b"])
        trim()

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _alike(pairs: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """Pairs whose signatures agree in at least so many coordinates; the count stays as ``agree``."""
    wide = pairs.join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("gb")), "b").join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("ga")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(c.to_pylist()), "<u2").reshape(b.num_rows, -1) for c in (b.column(2), b.column(3)))
            agree = (x == y).sum(axis=1)
            keep = pa.array(agree >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(agree, pa.int32()).filter(keep)], ["a", "b", "agree"])

    return wide.select("a", "b", "ga", "gb").mapInArrow(run, "a long, b long, agree int")


def _differences(pairs: DataFrame, threshold: float) -> DataFrame:
    """For each (hub, doc): the shingles that only one of them has, if they are near, else or also the document's own.

    Rows: hub (null for a document's own shingles), doc_id, root, n, size, need, linked, shingle.  ``need`` is how many of
    them a similar document of another component must share.  By the triangle inequality two similar documents are both
    near the hub or both far from it.  A document far from several hubs comes once for each with its own shingles, which
    ranks them earlier and so can only add candidates.
    """
    loose = (1 - threshold) / (1 + threshold)  # sets of n and m shingles are similar if they differ in at most loose * (n + m)
    names = ["hub", "doc_id", "root", "n", "size", "need", "linked", "shingle"]

    def rows(own: pa.RecordBatch, key: np.ndarray, chosen: np.ndarray, n: np.ndarray, size: np.ndarray, need: np.ndarray, linked: np.ndarray, near: bool) -> pa.RecordBatch:
        row = (key >> _U(52)).astype(np.int64)
        key, row = key[chosen[row]], row[chosen[row]]
        at = pa.array(row)
        hub = own.column(0).take(at) if near else pa.nulls(len(row), pa.int64())
        ints = [pa.array(v[row].astype(np.int32)) for v in (n, size, np.maximum(need, 1))]
        return pa.RecordBatch.from_arrays([hub, own.column(1).take(at), own.column(2).take(at), *ints, pa.array(linked[row]), pa.array((key & _U((1 << 52) - 1)).view(np.int64))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, h, x, m, n in _slices(b, 3, 4):
                both = np.sort(np.concatenate([_numbered(h, m), _numbered(x, n)]))
                twin = np.zeros(len(both), bool)
                twin[1:] = both[1:] == both[:-1]
                twin[:-1] |= twin[1:]
                only = both[~twin]
                size = np.bincount((only >> _U(52)).astype(np.int64), minlength=own.num_rows)
                apart = 2 * size / np.maximum(m + n + size, 1)  # Jaccard distance
                need = np.floor((size + loose * (m - n)) / 2).astype(np.int64) + 1
                yield rows(own, only, apart <= FAR, n, size, need, size <= loose * (m + n), True)
                yield rows(own, _numbered(x, n), apart > FAR - (1 - threshold), n, n, np.ceil(n * threshold).astype(np.int64), np.zeros(own.num_rows, bool), False)
        trim()

    return pairs.select("hub", "doc_id", "root", "sh", "sx").mapInArrow(run, "hub long, doc_id long, root long, n int, size int, need int, linked boolean, shingle long")


def _overlapping(tokens: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different components that share a shingle among the rarest that a similar pair must share.

    A document that is linked to the hub can be similar to one that is not only if
    they share more than half of its differences, so its rarest half meets all of
    the other's; of two that are not linked, the rarest halves meet.  Where two first
    meet, what is left of both must be enough for all that they must share.
    """
    keys = ["hub", "shingle"]
    both = tokens.groupBy(*keys).agg(F.count("*").alias("df"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("df > 1")
    same = tokens["hub"].eqNullSafe(both["hub"]) & (tokens["shingle"] == both["shingle"])
    own = tokens.join(both, same).select(tokens["*"], "df", "lo", "hi")
    by_doc = Window.partitionBy("hub", "doc_id")
    # shingles of one document alone come first and meet nobody
    rank = F.row_number().over(by_doc.orderBy("df", "shingle")) + F.col("size") - F.count("*").over(by_doc)
    ranked = own.withColumn("rank", rank).withColumn("short", F.col("rank") <= F.col("size") - F.col("need") + 1).filter("lo < hi")
    hub = F.coalesce("hub", F.lit(-1))
    side = lambda r, n: r.select((F.col("hub").isNull()).alias("own"), hub.alias("hub"), "shingle", F.col("doc_id").alias(n), F.col("root").alias(f"r{n}"), F.col("n").alias(f"n{n}"), F.col("size").alias(f"s{n}"), F.col("rank").alias(f"k{n}"))
    short, other = ranked.filter("short"), ranked.filter("not linked")
    on = ["own", "hub", "shingle"]
    share = (1 - threshold) / (1 + threshold)
    most = F.least(F.col("sa") - F.col("ka"), F.col("sb") - F.col("kb")) + 1
    enough = most >= (F.col("sa") + F.col("sb") - share * (F.col("na") + F.col("nb"))) / 2 - 1e-6
    alike = enough & (F.col("na") >= F.col("nb") * threshold) & (F.col("nb") >= F.col("na") * threshold)
    mixed = side(short.filter("linked"), "a").join(side(other, "b"), on).filter((F.col("ra") != F.col("rb")) & alike)
    loose = side(short.filter("not linked"), "a").join(side(short.filter("not linked"), "b"), on).filter((F.col("ra") < F.col("rb")) & alike)
    met = mixed.select("a", "b").unionByName(loose.select("a", "b"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def unique_ids(docs: DataFrame) -> bool:
    """Does every row have a doc_id of its own?"""
    return docs.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().filter("doc_id is null or count > 1").isEmpty()


def classes(docs: DataFrame, threshold: float = THRESHOLD, near: int = NEAR) -> DataFrame:
    """One row per row of docs: doc_id, class_id (least doc_id of its class), n_shingles, representative (of equal sets).

    ``near``: pairs whose signatures agree in fewer coordinates are not compared; 0 compares every pair that shares a band and is needed.
    """
    if unique_ids(docs):
        return _classes(docs, threshold, near)
    # rows without an id, or several of one, are told apart by a number of the row
    rows = stash(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("id"), "text"), "rows")
    by_row = _classes(rows.select(F.col("row").alias("doc_id"), "text"), threshold, near).withColumnRenamed("doc_id", "row")
    named = stash(by_row.join(rows.select("row", "id"), "row"), "named")
    least = lambda k, n: named.groupBy(k).agg(F.min("id").alias(n))
    return (
        named.join(least("class_id", "least_id"), "class_id").join(least("representative", "least_equal"), "representative")
        .select(F.col("id").alias("doc_id"), F.col("least_id").alias("class_id"), "n_shingles", F.col("least_equal").alias("representative"))
    )


def _classes(docs: DataFrame, threshold: float, near_by: int) -> DataFrame:
    """``classes`` of rows that each have a doc_id of their own."""
    s = stash(sketch(docs), "sketch")
    # rows with the same shingles: one representative; a null text stands for itself
    kind = ["f1", "f2", "n", "own"]
    same = stash(s.groupBy("f1", "f2", "n", F.when(F.col("n") < 0, F.col("row")).alias("own")).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "kinds")
    r = stash(s.filter("n > 0").join(same.filter("n > 0").select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "bands", "sig"), "representatives")
    keyed = r.select("doc_id", F.explode("bands").alias("band"))
    shared = stash(keyed.groupBy("band").agg(F.count("*").alias("k")).filter("k > 1"), "buckets")
    hot = spread.hot_keys(shared, ["band"], "k")
    parts = spread.cut(keyed, hot, ["band"], F.col("doc_id"))
    members = stash(parts.join(spread.repeated(shared.select("band"), hot, ["band"]), ["band", "cut"], "left_semi"), "members")
    candidates = members.select("doc_id").distinct()
    sigs = stash(r.join(candidates, "doc_id", "left_semi").select("doc_id", "sig"), "signatures")
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(candidates, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = stash(_sets(text), "shingles", **{"parquet.block.size": 16 << 20})

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        one = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
        return stash(_similar(one.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a"), threshold), name)

    def placed(root: DataFrame | None) -> DataFrame:
        """Members of buckets with their component so far."""
        if root is None:
            return members.withColumn("root", F.col("doc_id"))
        return members.join(root.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))

    def told(rows: DataFrame, buckets: DataFrame) -> DataFrame:
        """Members with what their bucket has one row of."""
        return rows.join(spread.repeated(buckets, hot, ["band"]), ["band", "cut"])

    links, root, tried = None, None, None
    for turn in range(ROUNDS):
        now = placed(root)
        hubs = now.groupBy("band").agg(F.min_by(F.struct("doc_id", "root"), F.xxhash64("doc_id", "band", F.lit(turn))).alias("hub"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        pairs = told(now, hubs.filter("lo < hi").select("band", "hub")).filter("root != hub.root").select(F.col("hub.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()
        best = _alike(pairs, sigs, near_by).groupBy("b").agg(F.max(F.struct("agree", "a")).alias("m")).select("m.a", "b")
        best = stash(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tried")
        found = checked(best, "links")
        tried = best if tried is None else tried.unionByName(best)
        last = found.count() * SLOW <= best.count()
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
        if links is not None:
            # the rounds need no more than that what is linked is mostly known to be
            root, old = stash(components(links) if last else components(links, rounds=2), "components"), root
            discard(old)
        if last:
            break
    if links is not None and not last:
        # the rounds ended with components in several parts, and the completion may find no link to form them anew
        root, old = stash(components(links), "components"), root
        discard(old)
    # what the rounds left: differences from the hub of each bucket, its member with the most company
    now = placed(root)
    left = stash(told(now, now.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("k")).filter("lo < hi").select("band", "k")), "mixed")
    company = left
    company = company.join(company.groupBy("doc_id").agg(F.sum("k").alias("company")), "doc_id")
    hubs = company.groupBy("band").agg(F.max(F.struct("company", "doc_id", "root")).alias("m")).select("band", F.col("m.doc_id").alias("hub"), F.col("m.root").alias("hub_root"))
    near = told(left, hubs).filter("doc_id != hub").select("hub", "hub_root", "doc_id", "root").distinct()
    wide = near.join(sets.select("doc_id", F.col("shingles").alias("sx")), "doc_id").join(sets.select(F.col("doc_id").alias("hub"), F.col("shingles").alias("sh")), "hub")
    apart = stash(_differences(wide, threshold), "differences")
    pairs = stash(_overlapping(apart, threshold), "pairs")
    discard(apart)
    direct = near.filter("root != hub_root").select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b"))
    more = checked(_alike(pairs.unionByName(direct).distinct().join(tried, ["a", "b"], "left_anti"), sigs, near_by), "links")
    if not more.isEmpty():
        links = more if links is None else links.unionByName(more)
        root, old = stash(components(links), "components"), root
        discard(old)
    discard(members, r, sigs, sets, left, pairs, hot, shared)
    named = same if root is None else same.join(root.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select(*kind, F.col("rep").alias("representative"), (F.col("rep") if root is None else F.coalesce("root", "rep")).alias("class_id"))
    out = s.select("doc_id", "row", F.col("n").alias("n_shingles"), "f1", "f2", "n", F.when(F.col("n") < 0, F.col("row")).alias("own"))
    return spread.join(out, named, spread.hot_keys(same, kind, "copies"), kind, F.col("row")).select("doc_id", "class_id", "n_shingles", "representative")
