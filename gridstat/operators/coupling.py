"""Identity-based effective sample size, paired pools and pairwise column coupling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridstat.functions.ordered import by_keys, with_totals
from gridstat.sources.scratch import stash


def packed(cells: DataFrame, by: list[str] = []) -> DataFrame:
    """(by, row_id, symbols): each row's symbols in column order, as a string."""
    ordered = F.array_sort(F.collect_list(F.struct("col_ix", "symbol")))
    return cells.groupBy(*by, "row_id").agg(F.array_join(F.transform(ordered, lambda x: x["symbol"]), "").alias("symbols"))


#: Rows of a tile: a task compares two tiles, of at most about this many rows each.
TILE = 4096
#: Bytes of comparisons that are held at once.
HELD = 1 << 24


def _by_segments(kinds: DataFrame, length: int, theta: float, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows keyed by their segments, and how many candidate pairs that makes."""
    parts = min(math.floor(length * (1 - theta) + 1e-9) + 1, length)
    edges = [round(i * length / parts) for i in range(parts + 1)]
    segments = F.array(*(F.substring("symbols", a + 1, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)))
    keyed = kinds.select(*by, "symbols", "copies", F.posexplode(segments).alias("seg", "part"))
    n = keyed.groupBy(*by, "seg", "part").agg(F.count("*").alias("n"))
    return keyed, n.agg(F.sum(F.col("n") * F.col("n")).alias("n"))


def _equal_places(a: str, b: str, length: int) -> Column:
    """In how many places two strings of one length are equal."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda e: e))


def _segment_neighbours(keyed: DataFrame, length: int, thetas: tuple[float, ...], by: list[str]) -> DataFrame:
    a, b = keyed.select(*by, "seg", "part", F.col("symbols").alias("sa")), keyed.select(*by, "seg", "part", F.col("symbols").alias("sb"), "copies")
    pairs = by_keys(a, b, [*by, "seg", "part"]).select(*by, "sa", "sb", "copies").distinct()
    same = pairs.withColumn("_same", _equal_places("sa", "sb", length) / F.lit(length)).withColumn("theta", F.explode(F.array(*(F.lit(t) for t in thetas))))
    return same.filter(F.col("_same") >= F.col("theta")).groupBy(*by, "theta", F.col("sa").alias("symbols")).agg(F.sum("copies").alias("neighbours"))


def _codes(text: list[str]) -> np.ndarray:
    return np.frombuffer("".join(text).encode("utf-32-le"), "<u4").reshape(len(text), -1)


def _indicators(codes: np.ndarray, symbols: np.ndarray, kind: type = np.float64) -> np.ndarray:
    """A column for each place and symbol."""
    return (codes[:, :, None] == symbols).reshape(len(codes), -1).astype(kind)


def _planes(codes: np.ndarray) -> np.ndarray:
    """Rows of small numbers as bit planes (rows, planes, words): bit c of plane p is bit p of a row's number in column c."""
    n, length = codes.shape
    depth = max(int(codes.max(initial=0)).bit_length(), 1)
    bits = np.zeros((n, depth, -(-length // 64) * 64), np.uint8)
    for p in range(depth):
        bits[:, p, :length] = (codes >> p) & 1
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64)


def equal_places(x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """In how many places each row of x equals each row of y, both as bit planes: places that differ do so in some plane."""
    apart = np.zeros((len(x), len(y)), np.int64)
    for w in range(x.shape[2]):
        differ = x[:, None, 0, w] ^ y[None, :, 0, w]
        for p in range(1, x.shape[1]):
            differ |= x[:, None, p, w] ^ y[None, :, p, w]
        apart += np.bitwise_count(differ)
    return length - apart


def _tile_neighbours(kinds: DataFrame, length: int, thetas: tuple[float, ...], by: list[str]) -> DataFrame:
    """All pairs by the upper triangle of pairs of tiles, each compared once for both.

    A group's rows are dealt into tiles by hash.  Each row is sent once to every tile of its group, so that what is shuffled
    grows as rows x rows / ``TILE``; a task holds two tiles as bit planes and ``HELD`` bytes of comparisons, whatever the group.
    """
    size = kinds.groupBy(*by).agg(F.ceil(F.count("*") / TILE).cast("int").alias("_tiles"))
    own = with_totals(kinds, size, by).withColumn("_own", F.pmod(F.xxhash64("symbols"), F.col("_tiles")).cast("int"))
    sent = own.select(*by, "symbols", "copies", "_own", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)).alias("_other"))
    keyed = sent.select(*by, F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi"), "_own", "symbols", "copies")

    def run(pair: pa.Table) -> pa.Table:
        lo, hi = pair.column("_lo")[0].as_py(), pair.column("_hi")[0].as_py()
        raw = _codes(pair.column("symbols").to_pylist())
        small = np.searchsorted(np.unique(raw), raw)
        planes = _planes(small)
        copies = pair.column("copies").to_numpy()
        where = pair.column("_own").to_numpy()
        first, second = np.flatnonzero(where == lo), np.flatnonzero(where == hi)
        n = np.zeros((len(thetas), len(where)), np.int64)
        # a tile that no row of the other meets has only itself, and comes as a pair of its own
        step = max(1, HELD // (32 * max(len(second), 1)))
        for at in range(0, len(first), step):
            some = first[at : at + step]
            share = equal_places(planes[some], planes[second], length) / length
            for t, theta in enumerate(thetas):
                close = share >= theta
                n[t, some] += close @ copies[second]
                if lo != hi:
                    n[t, second] += copies[some] @ close
        times = len(thetas)
        every = np.tile(np.arange(len(where)), times)
        keys = [pair.column(k).take(pa.array(every)) for k in by]
        return pa.table([*keys, pa.array(np.repeat(np.array(thetas, float), len(where))), pair.column("symbols").take(pa.array(every)), pa.array(n.ravel())], names=[*by, "theta", "symbols", "neighbours"])

    schema = T.StructType([kinds.schema[k] for k in by] + [T.StructField("theta", T.DoubleType()), T.StructField("symbols", T.StringType()), T.StructField("neighbours", T.LongType())])
    return keyed.groupBy(*by, "_lo", "_hi").applyInArrow(run, schema).groupBy(*by, "theta", "symbols").agg(F.sum("neighbours").alias("neighbours"))


def identity_weights(rows: DataFrame, length: int, theta: float | tuple[float, ...] = 0.8, by: list[str] = [], method: str = "auto") -> DataFrame:
    """(by, theta, row_id, neighbours, weight): 1 over the rows whose share of equal places is at least theta, itself included.

    Several thresholds share one comparison.  Equal rows are counted once with their
    number.  Rows that differ in at most m places agree in one of any m + 1 segments, so
    candidates can come of an equi-join on segments; where that makes as many as all
    pairs (few kinds of segments, as in narrow or conserved matrices), ``auto`` compares
    all pairs tile by tile instead; both count the same.
    """
    thetas = theta if isinstance(theta, tuple) else (theta,)
    kinds = stash(rows.groupBy(*by, "symbols").agg(F.count("*").alias("copies")), "kinds")
    keyed, candidates = _by_segments(kinds, length, min(thetas), by)
    if method == "auto":
        n = kinds.groupBy(*by).agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n")))
        method = "segments" if 4 * (candidates.first()[0] or 0) <= (n.first()[0] or 0) else "tiles"
    close = _segment_neighbours(keyed, length, thetas, by) if method == "segments" else _tile_neighbours(kinds, length, thetas, by)
    return by_keys(rows, close, [*by, "symbols"]).select(*by, "theta", "row_id", "neighbours", (1.0 / F.col("neighbours")).alias("weight"))


def mean_pairwise_identity(rows: DataFrame, length: int, by: list[str] = [], sample: int = 250) -> DataFrame:
    """(by, mean_identity, n_sampled) over the pairs of a bounded, deterministic sample of each group: the rows of least digest."""
    w = Window.partitionBy(*by).orderBy(F.md5(F.col("row_id").cast("string")), "row_id")
    s = rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= sample)
    a, b = s.select(*by, F.col("_rn").alias("_i"), F.col("symbols").alias("sa")), s.select(*by, F.col("_rn").alias("_j"), F.col("symbols").alias("sb"))
    pairs = by_keys(a, b, by).filter("_i < _j")
    same = _equal_places("sa", "sb", length)
    n = s.groupBy(*by).agg(F.count("*").alias("n_sampled"))
    g = pairs.groupBy(*by).agg(F.avg(same / F.lit(length)).alias("mean_identity"))
    return by_keys(g, n, by)


def effective_depth(weights: DataFrame, by: list[str] = []) -> DataFrame:
    return weights.groupBy(*by).agg(F.count("*").alias("n"), F.sum("weight").alias("n_eff"))


def depth_gate(n_eff: Column, l1: int, l2: int) -> tuple[Column, Column]:
    """n_eff as a multiple of the mean block length, and whether it exceeds it."""
    need = (l1 + l2) / 2.0
    return n_eff / need, n_eff > need


def paired_pool(left: DataFrame, right: DataFrame, key: str, pairing: DataFrame | None = None, by: list[str] = []) -> DataFrame:
    """(by, row_id, a, b): every left row with every right row of the same key; ``pairing`` (by, key, partner) permutes keys.

    left has (key, part, id), right likewise; keys without a partner row drop out.
    """
    a = left.select(key, F.col("part").alias("pa"), F.col("id").alias("a"))
    b = right.select(F.col(key).alias("_k"), F.col("part").alias("pb"), F.col("id").alias("b"))
    if pairing is None:
        j = a.join(b, F.col(key) == F.col("_k"))
    else:
        j = a.join(pairing, key).join(b, F.col("partner") == F.col("_k"))
    return j.select(*by, F.concat_ws("|", "a", "b").alias("row_id"), "a", "b")


#: Parts of a group's rows whose counts are made apart and then added up.
PARTS = 16


def alphabet_of(*packed_rows: DataFrame) -> str:
    """The symbols of packed rows, in order: as many as there are, however many rows."""
    seen = None
    for rows in packed_rows:
        own = rows.select(F.explode(F.array_distinct(F.split("symbols", ""))).alias("s")).distinct()
        seen = own if seen is None else seen.unionByName(own)
    return "".join(sorted(r.s for r in seen.distinct().collect()))


def counted(rows: DataFrame, by: list[str], count, kernel_columns: int, deal: str | None = None) -> DataFrame:
    """(by, counts): sums of the matrices that ``count(columns)`` makes of the batches of a group's rows, as bytes.

    ``rows`` has ``by`` and the columns that ``count`` takes.  A group's rows are dealt over at most ``PARTS`` tasks, by the
    number ``deal`` or else by what they hold, each of which gives out one matrix for it; they are added up with ``add_up``.
    """
    k = len(by)
    names = rows.columns[k : k + kernel_columns]
    schema = T.StructType([rows.schema[c] for c in by] + [T.StructField("counts", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        give = lambda key, m: pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(key, types, strict=True)), pa.array([m.tobytes()], pa.binary())], [*by, "counts"])
        for batch in batches:
            types = [batch.schema.field(c).type for c in range(k)]
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(k)), strict=True)) if k else [()] * batch.num_rows
            at = 0
            while at < len(keys):  # rows of a group follow one another
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                part = count(*(batch.column(k + i).slice(at, end - at) for i in range(len(names))))
                if now == keys[at]:
                    total += part
                else:
                    if now is not None:
                        yield give(now, total)
                    now, total = keys[at], part
                at = end
        if now is not None:
            yield give(now, total)

    dealt = rows.withColumn("_s", F.pmod(F.col(deal) if deal else F.xxhash64(*names), F.lit(PARTS))).repartition(*by, "_s").sortWithinPartitions(*by, "_s")
    return dealt.select(*by, *names).mapInArrow(run, schema)


def add_up(group: pa.Table) -> np.ndarray:
    """The sum of a group's matrices, flat."""
    total = None
    for x in group.column("counts"):
        m = np.frombuffer(x.as_buffer(), np.float64)
        total = m.copy() if total is None else total + m
    return total


def _information(n: np.ndarray, l1: int, l2: int, k: int) -> np.ndarray:
    """Plug-in mutual information of every pair of columns, from the matrix of joint counts (l1 * k, l2 * k)."""
    t = n.reshape(l1, k, l2, k)
    total = t.sum(axis=(1, 3))
    plog = lambda v: np.where(v > 0, v * np.log2(np.where(v > 0, v, 1.0)), 0.0)
    s = plog(t.sum(axis=3)).sum(axis=1) + plog(t.sum(axis=1)).sum(axis=2) - plog(t).sum(axis=(1, 3))
    safe = np.where(total > 0, total, 1.0)
    return np.where(total > 0, np.maximum(np.log2(safe) - s / safe, 0.0), 0.0)


#: Rows and columns of a matrix of counts: a tile has as many columns as that allows with all their symbols.
SIDE = 1024
#: Rows whose indicators are held at once.
ROWS = 1024


def interblock_mi(pool: DataFrame, left: DataFrame, right: DataFrame, by: list[str] = [], weight: str | None = None) -> DataFrame:
    """(by, i, j, mi): plug-in mutual information of every column of one block with every column of the other.

    ``left`` and ``right`` are packed rows (row_id, symbols), each of one length, which ``pool`` (by, a, b) pairs.  Both
    sides are cut into tiles of columns, and a task counts the pairs of columns of two tiles by one product of indicator
    matrices a batch: at most 8 MB of counts (``SIDE``), however wide the blocks; ``PARTS`` of them meet in one group.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    # rows are dealt by their ids, so that equal rows do not meet
    paired = pool.select(*by, "a", "b", w.alias("_w"), F.xxhash64("a", "b").alias("_d"))
    rows = paired.join(left.select(F.col("row_id").alias("a"), F.col("symbols").alias("_x")), "a").join(right.select(F.col("row_id").alias("b"), F.col("symbols").alias("_y")), "b")
    keyed = by or ["_all"]
    symbols = np.array([ord(c) for c in alphabet_of(left, right)], "<u4")
    l1, l2 = ((x.select(F.length("symbols")).head() or [0])[0] for x in (left, right))
    tile = max(1, SIDE // max(len(symbols), 1))

    def cut(name: str, length: int) -> Column:
        return F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.substring(name, t * tile + 1, tile).alias("s")) for t in range(max(1, -(-length // tile))))))

    keys = [*keyed, "_i", "_j"]
    rows = rows.withColumn("_all", F.lit(0)).select(*keyed, cut("_x", l1).alias("_p"), "_y", "_w", "_d").select("*", cut("_y", l2).alias("_q"))
    rows = rows.select(*keyed, F.col("_p.t").alias("_i"), F.col("_q.t").alias("_j"), F.col("_p.s").alias("_x"), F.col("_q.s").alias("_y"), "_w", "_d")

    def count(x: pa.Array, y: pa.Array, weights: pa.Array) -> np.ndarray:
        total = 0.0
        for at in range(0, len(x), ROWS):
            own = _indicators(_codes(x.slice(at, ROWS).to_pylist()), symbols) * weights.slice(at, ROWS).to_numpy(zero_copy_only=False)[:, None]
            total = total + own.T @ _indicators(_codes(y.slice(at, ROWS).to_pylist()), symbols)
        return total

    def finish(group: pa.Table) -> pa.Table:
        a, b = (group.column(c)[0].as_py() * tile for c in ("_i", "_j"))
        mi = _information(add_up(group), min(tile, l1 - a), min(tile, l2 - b), len(symbols))
        i, j = np.indices(mi.shape)
        same = [group.column(c).slice(0, 1).combine_chunks().take(pa.array(np.zeros(mi.size, np.int64))) for c in keyed]
        return pa.table([*same, pa.array((i + a).ravel().astype(np.int32)), pa.array((j + b).ravel().astype(np.int32)), pa.array(mi.ravel())], names=[*keyed, "i", "j", "mi"])

    schema = T.StructType([rows.schema[c] for c in keyed] + [T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()), T.StructField("mi", T.DoubleType())])
    return counted(rows, keys, count, 3, "_d").groupBy(*keys).applyInArrow(finish, schema).select(*by, "i", "j", "mi")


def average_product_correction(mi: DataFrame, by: list[str] = [], value: str = "mi") -> DataFrame:
    """``apc``: the value less row mean x column mean / grand mean, which are joined as small tables."""
    rows = mi.groupBy(*by, "i").agg(F.avg(value).alias("_ri"))
    cols = mi.groupBy(*by, "j").agg(F.avg(value).alias("_cj"))
    grand = mi.groupBy(*by).agg(F.avg(value).alias("_g"))
    j = by_keys(by_keys(by_keys(mi, rows, [*by, "i"]), cols, [*by, "j"]), grand, by)
    return j.withColumn("apc", F.when(F.col("_g") > 0, F.col(value) - F.col("_ri") * F.col("_cj") / F.col("_g")).otherwise(F.col(value))).drop("_ri", "_cj", "_g")
