"""Permutation and bootstrap nulls with an explicit replicate dimension.

A permutation is a join of two orders of the same rows: their own order and the
order of a keyed digest of (replicate, row).  Digests are md5 over text, so any
engine that has md5 repeats them.  Positions are found range by range, so no task
sees a whole replicate.

Where only a statistic of each replicate is wanted, no replicate of the rows is made:
kernels take the rows of a group once and give the statistics of all replicates.
Draws of columns have as many rows as a matrix has columns.  Rows of strata are cut
into chunks of bounded size, to which each replicate deals the flagged rows by the
multivariate hypergeometric distribution, so the whole is a permutation within the
stratum.  Labels permuted over all rows leave each column a table with given margins,
which is drawn from these, whatever the number of rows.  Draws of the kernels come of
``number``, arithmetic that any engine repeats, but for the last two.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridstat.functions.ordered import by_keys, row_numbers
from gridstat.sources.scratch import stash


def replicates(df: DataFrame, n: int) -> DataFrame:
    """Every row once for each replicate 0 to n - 1."""
    return df.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def draw(*parts: Column | str) -> Column:
    """The digest of the parts, joined by colons."""
    return F.md5(F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts)))


def permuted(df: DataFrame, id_col: str, label: str, n: int, within: list[str] = []) -> DataFrame:
    """(within, replicate, id, label): labels permuted, within strata if given; the id must be unique."""
    rows = df.select(*within, id_col, label)
    own = row_numbers(rows, id_col, [], within, "pos").select(*within, "pos", F.col(label))
    shuffled = row_numbers(replicates(rows.select(*within, id_col), n).withColumn("_h", draw("replicate", id_col)), "_h", [id_col], ["replicate", *within], "pos")
    return by_keys(shuffled.select(*within, "replicate", id_col, "pos"), own, [*within, "pos"]).drop("pos")


def subsets(pool: DataFrame, id_col: str, size: Column | int, n: int, keys: list[str] = []) -> DataFrame:
    """Draws of ``size`` pool rows without replacement: a replicate's rows of least digests.  ``size`` may be a column of pool."""
    r = row_numbers(replicates(pool, n).withColumn("_h", draw("replicate", *keys, id_col)), "_h", [id_col], ["replicate", *keys], "_pos")
    return r.filter(F.col("_pos") <= size).drop("_h", "_pos")


def bootstrap(rows: DataFrame, id_col: str, n: int, keys: list[str] = []) -> DataFrame:
    """Draws with replacement: as many as the key has rows, each by the digest of (replicate, keys, place)."""
    numbered = row_numbers(rows, id_col, [], keys, "_pos")
    size = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    places = numbered.select(*keys, F.col("_pos").alias("_place"))
    places = by_keys(places, size, keys)
    pick = (F.conv(F.substring(draw("replicate", *keys, "_place"), 1, 8), 16, 10).cast("long") % F.col("_n")) + 1
    drawn = replicates(places, n).withColumn("_pos", pick).select(*keys, "replicate", "_pos")
    return by_keys(drawn, numbered, [*keys, "_pos"]).drop("_pos")


PRIME = 2_147_483_647
#: Rows of a chunk, tasks that share a chunk's replicates, and numbers that a kernel makes at once.
CHUNK, SHARES, _AT_ONCE = 1 << 16, 4, 1 << 22
#: Draws whose numbers stay in a processor's cache.
_CACHED = 1 << 13


def numbers_of(item: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The function that gives ``number(replicate, item)`` of replicates, as unsigned integers of 32 bits.

    No division is made for a pair: as ``PRIME`` is 2 ** 31 - 1, what stands above 31 bits is added to what stands below.
    """
    part = lambda x, kind: (np.asarray(x, np.int64) % PRIME).astype(kind)
    prime, low, bits = np.uint32(PRIME), np.uint64(PRIME), np.uint64(31)
    first, second = part(item * 7_919 + 12_345, np.uint32), part(item + 1, np.uint64)

    def of(replicate: np.ndarray) -> np.ndarray:
        h = part(replicate * 1_000_003, np.uint32) + first
        # the less of both, as what would be below 0 is a large number
        x = np.minimum(h, h - prime).astype(np.uint64)
        x *= x
        x += second
        x = (x & low) + (x >> bits)
        x *= x  # of at most 2 ** 32 - 2
        x += part(replicate * 31 + 17, np.uint64)
        x = (x & low) + (x >> bits)
        h = ((x & low) + (x >> bits)).astype(np.uint32)
        return np.minimum(h, h - prime)

    return of


def number(replicate: np.ndarray, item: np.ndarray) -> np.ndarray:
    """A pseudo-random number below ``PRIME`` of (replicate, item): squares modulo a prime."""
    with np.errstate(over="ignore"):  # of numbers that are no arrays
        return numbers_of(item)(replicate).astype(np.int64)


def number_sql(replicate: str, item: str) -> str:
    """The same in SQL."""
    h = f"(({replicate} * 1000003 + {item} * 7919 + 12345) % {PRIME})"
    h = f"(({h} * {h} + {item} + 1) % {PRIME})"
    return f"(({h} * {h} + {replicate} * 31 + 17) % {PRIME})"


def _grouped(df: DataFrame, keys: list[str], fn, names: list[str]) -> DataFrame:
    """``fn(table) -> arrays`` of each group, under its keys."""
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField(n, T.IntegerType() if n == "replicate" else T.DoubleType()) for n in names])

    def run(group: pa.Table) -> pa.Table:
        cols = fn(group)
        n = len(cols[0])
        return pa.table([group.column(k).slice(0, 1).combine_chunks().take(pa.array(np.zeros(n, np.int64))) for k in keys] + [pa.array(c) for c in cols], names=[*keys, *names])

    return df.groupBy(*keys).applyInArrow(run, schema)


def subset_means(pool: DataFrame, id_col: str, value: str, size: str, n: int, keys: list[str]) -> DataFrame:
    """(keys, replicate, stat): the mean of ``value`` over ``size`` rows drawn without replacement, those of least numbers.

    A key's rows are values of columns: as many as a matrix has, never as it has rows.
    """

    def fn(t: pa.Table) -> list[np.ndarray]:
        ids, x = t.column(id_col).to_numpy().astype(np.int64), t.column(value).to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, x, k = ids[order], x[order], min(int(t.column(size)[0].as_py()), len(ids))
        out, step = np.empty(n), max(1, _AT_ONCE // len(ids))
        for a in range(0, n, step):
            r = np.arange(a, min(a + step, n), dtype=np.int64)[:, None]
            key = (number(r, ids[None, :]) << 31) | np.arange(len(ids))
            chosen = key <= np.partition(key, k - 1, axis=1)[:, k - 1 : k] if k else np.zeros(key.shape, bool)
            out[a : a + len(r)] = (chosen * x).sum(axis=1) / max(k, 1)
        return [np.arange(n, dtype=np.int32), out]

    return _grouped(pool.select(*keys, id_col, F.col(value).cast("double").alias(value), F.col(size).cast("long").alias(size)), keys, fn, ["replicate", "stat"])


#: Replicates of a key that one task draws.
REPLICATES = 250


def draws_by_value(counts: np.ndarray, own: int, replicate: np.ndarray) -> np.ndarray:
    """How often each replicate draws each distinct value of an arm (``own`` is 1 or 0) that has it ``counts`` times, as ``bootstrap_deltas`` says.

    What numbers have of a place is made once for all replicates.
    """
    ends, size = np.cumsum(counts), int(counts.sum())
    # the value at each place of the arm, where that is no large table
    at = np.repeat(np.arange(len(counts)), counts) if size <= _AT_ONCE else None
    out = np.zeros((len(replicate), len(counts)), np.int64)
    some = max(1, min(len(replicate), _CACHED // max(size, 1)))
    step = max(1, _CACHED // some)
    shift = np.arange(some)[:, None] * len(counts)
    for a in range(0, size, step):
        of = numbers_of(2 * np.arange(a + 1, min(a + step, size) + 1, dtype=np.int64)[None, :] + own)
        for k in range(0, len(replicate), some):
            now = replicate[k : k + some, None]
            pick = of(now)
            # a remainder by a quotient, which NumPy computes faster
            pick -= (pick // np.uint32(size)) * np.uint32(size) if size < PRIME else np.uint32(0)
            value_at = at.take(pick, mode="clip") if at is not None else np.searchsorted(ends, pick, "right")
            value_at += shift[: len(now)]
            out[k : k + some] += np.bincount(value_at.ravel(), minlength=len(now) * len(counts)).reshape(len(now), len(counts))
    return out


def bootstrap_deltas(df: DataFrame, value: str, arm: str, n: int, keys: list[str]) -> DataFrame:
    """(keys, replicate, cliffs_delta): Cliff's delta of each arm's values drawn with replacement, as many as the arm has.

    Rows are first counted by distinct value and arm.  The p-th draw of an arm of size s is the value at ``number(replicate,
    2 p + arm) % s`` of the arm in order; a replicate's draws are counted by value, and all its pairs follow from these counts
    and their running sums.  A key's replicates are dealt over tasks; each holds the key's distinct values, never its rows.
    Null values are left out; an empty arm gives nulls.
    """
    per = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(F.col(arm).cast("long")).alias("_a"), F.sum((~F.col(arm)).cast("long")).alias("_b"))
    dealt = per.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(-(-n // REPLICATES) - 1))))
    # few bytes make much work: groups are dealt over all cores, not by size
    dealt = dealt.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys, "_part")

    def fn(t: pa.Table) -> list[np.ndarray]:
        t = t.sort_by(value)
        a, b, first = t.column("_a").to_numpy(), t.column("_b").to_numpy(), int(t.column("_part")[0].as_py()) * REPLICATES
        r = np.arange(first, min(first + REPLICATES, n), dtype=np.int64)
        out = np.full(len(r), np.nan)
        if a.sum() and b.sum():
            step = max(1, _AT_ONCE // len(a))
            for k in range(0, len(r), step):
                x, y = (draws_by_value(counts, own, r[k : k + step]) for counts, own in ((a, 1), (b, 0)))
                out[k : k + step] = (x * (2 * (np.cumsum(y, axis=1) - y) + y)).sum(axis=1) / (a.sum() * b.sum()) - 1.0
        return [r.astype(np.int32), out]

    return _grouped(dealt, [*keys, "_part"], fn, ["replicate", "cliffs_delta"]).drop("_part").withColumn("cliffs_delta", F.nanvl("cliffs_delta", F.lit(None).cast("double")))


def bootstrap_means(rows: DataFrame, id_col: str, value: str, n: int, keys: list[str]) -> DataFrame:
    """(keys, replicate, stat): the mean of as many values as the key has, drawn with replacement; the k-th draw is the value at ``number`` modulo their number."""

    def fn(t: pa.Table) -> list[np.ndarray]:
        order = np.argsort(t.column(id_col).to_numpy(), kind="stable")
        x = t.column(value).to_numpy()[order]
        out, step = np.empty(n), max(1, _AT_ONCE // len(x))
        for a in range(0, n, step):
            r = np.arange(a, min(a + step, n), dtype=np.int64)[:, None]
            out[a : a + len(r)] = x[number(r, np.arange(1, len(x) + 1, dtype=np.int64)[None, :]) % len(x)].mean(axis=1)
        return [np.arange(n, dtype=np.int32), out]

    return _grouped(rows.select(*keys, id_col, F.col(value).cast("double").alias(value)), keys, fn, ["replicate", "stat"])


def least_sums(ids: np.ndarray, x: np.ndarray, k: np.ndarray, replicate: np.ndarray) -> np.ndarray:
    """For each replicate the sum of ``x`` over its ``k`` rows of least numbers; of equal numbers the row that stands first.

    Nothing is sorted: the k-th number is found by selection, and the rows up to it are added.
    """
    n, out = len(ids), np.zeros(len(replicate))
    parts = [numbers_of(ids[None, a : a + _CACHED]) for a in range(0, n, _CACHED)]
    # a product, where no value would make it other than a sum
    total = (lambda taken: taken.astype(np.float64) @ x) if np.isfinite(x).all() else (lambda taken: x[taken].sum())
    some = max(1, _CACHED // max(n, 1))
    for a in range(0, len(replicate) if n else 0, some):
        need, now = k[a : a + some], replicate[a : a + some, None]
        h = np.concatenate([of(now) for of in parts], axis=1)
        for i, (own, want) in enumerate(zip(h, need.tolist(), strict=True)):
            if 0 < want < n:
                last = np.partition(own, want - 1)[want - 1]
                taken = own <= last
                if (more := int(np.count_nonzero(taken)) - want) > 0:  # of rows with the last number those that stand last
                    taken[np.flatnonzero(own == last)[-more:]] = False
                out[a + i] = total(taken)
            elif want:
                out[a + i] = x.sum()
    return out


def stratified_sums(rows: DataFrame, stratum: str, id_col: str, value: str, flag: str, n: int, chunk: int = CHUNK, by: list[str] = []) -> DataFrame:
    """(by, replicate, flagged_sum): the sum of ``value`` over the flagged rows, flags permuted within strata.

    ``by`` are columns that are one in all rows of a stratum.  In a chunk the rows of least numbers are flagged.  A stratum of more than ``chunk`` rows has several chunks.
    A chunk's replicates are dealt over ``SHARES`` tasks, so that its rows are sent as often.  The strata's sizes are written
    first: they are few, which Spark can't guess from the rows, and it would broadcast the rows instead.
    """
    shares = -(-n // max(1, -(-n // SHARES)))
    each_share = -(-n // shares)
    size = stash(rows.groupBy(stratum, *by).agg(F.count("*").alias("_n"), F.sum(F.col(flag).cast("long")).alias("_k")), "strata")
    cut = by_keys(rows.select(stratum, id_col, F.col(value).cast("double").alias(value)), size.drop(*by), [stratum])
    cut = cut.withColumn("_chunk", F.pmod(F.xxhash64(id_col), F.ceil(F.col("_n") / chunk)).cast("int"))
    sizes = cut.groupBy(stratum, "_chunk", "_k").agg(F.count("*").alias("_m"))
    key_type = rows.schema[stratum]

    def deal(t: pa.Table) -> pa.Table:
        m, k = t.column("_m").to_numpy(), int(t.column("_k")[0].as_py())
        order = np.argsort(t.column("_chunk").to_numpy())
        rng = np.random.default_rng(zlib.crc32(str(t.column(stratum)[0].as_py()).encode()))
        dealt = rng.multivariate_hypergeometric(m[order], k, size=n, method="marginals") if len(m) > 1 else np.full((n, 1), k)
        at = np.empty(len(m), np.int64)
        at[order] = np.arange(len(m))
        pieces = [dealt[s * each_share : (s + 1) * each_share, i].astype(np.int32).tobytes() for i in at for s in range(shares)]
        own = pa.array(np.repeat(np.arange(len(m)), shares))
        return pa.table([t.column(stratum).take(own), t.column("_chunk").take(own), pa.array(np.tile(np.arange(shares, dtype=np.int32), len(m))), pa.array(pieces, pa.binary())], names=[*keys, "_dealt"])

    keys = [stratum, "_chunk", "_share"]
    dealt = sizes.groupBy(stratum).applyInArrow(deal, T.StructType([key_type, T.StructField("_chunk", T.IntegerType()), T.StructField("_share", T.IntegerType()), T.StructField("_dealt", T.BinaryType())]))

    def fn(t: pa.Table, d: pa.Table) -> pa.Table:
        if not (t.num_rows and d.num_rows):
            return pa.table({stratum: t.column(stratum).slice(0, 0) if t.num_rows else d.column(stratum).slice(0, 0), "replicate": pa.array([], pa.int32()), "_sum": pa.array([], pa.float64())})
        k = np.frombuffer(d.column("_dealt")[0].as_buffer(), np.int32)
        ids = t.column(id_col).to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")
        r = int(t.column("_share")[0].as_py()) * each_share + np.arange(len(k), dtype=np.int64)
        same = t.column(stratum).slice(0, 1).combine_chunks().take(pa.array(np.zeros(len(k), np.int64)))
        return pa.table({stratum: same, "replicate": pa.array(r.astype(np.int32)), "_sum": pa.array(least_sums(ids[order], t.column(value).to_numpy()[order], k, r))})

    schema = T.StructType([key_type, T.StructField("replicate", T.IntegerType()), T.StructField("_sum", T.DoubleType())])
    # few bytes make much work: both sides are dealt over all cores, not by size
    spread = lambda df: df.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys).groupBy(*keys)
    sent = cut.select(stratum, "_chunk", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("_share"), id_col, value)
    each = spread(sent).cogroup(spread(dealt)).applyInArrow(fn, schema)
    each = each.groupBy(stratum, "replicate").agg(F.sum("_sum").alias("_sum"))
    if by:
        each = by_keys(each, size.select(stratum, *by), [stratum])
    return each.groupBy(*by, "replicate").agg(F.sum("_sum").alias("flagged_sum"))


def permuted_information(joint: DataFrame, by: list[str], x: str, y: str, n: int) -> DataFrame:
    """(by, replicate, mi_bits): mutual information, with the Miller-Madow correction, of tables (by, x, y, w) whose y are permuted over all rows.

    Permuting leaves both margins as they are and makes every arrangement equally likely, so tables are drawn with these
    margins, symbol by symbol from what is left of each label: as exact as permuting rows, at a cost without their number.
    """

    def fn(t: pa.Table) -> list[np.ndarray]:
        xs, ys = (np.unique(np.array([str(v) for v in t.column(c).to_pylist()]), return_inverse=True)[1] for c in (x, y))
        w = np.rint(t.column("w").to_numpy()).astype(np.int64)
        per_x, per_y = np.bincount(xs, w).astype(np.int64), np.bincount(ys, w).astype(np.int64)
        rng = np.random.default_rng(zlib.crc32(repr([t.column(c)[0].as_py() for c in by]).encode()))
        total = int(w.sum())
        plog = lambda v: np.where(v > 0, v * np.log2(np.maximum(v, 1)), 0.0)
        left = np.repeat(per_y[None, :], n, axis=0)
        cells, occupied = np.zeros(n), np.zeros(n)
        for k in per_x:
            need, room = np.full(n, k), left.sum(axis=1)
            for g in range(len(per_y)):
                room = room - left[:, g]
                got = np.where(need > 0, rng.hypergeometric(left[:, g], room, need), 0) if g + 1 < len(per_y) else need
                left[:, g] -= got
                need = need - got
                cells += plog(got)
                occupied += got > 0
        h = lambda s: np.log2(total) - s / total
        fix = (len(per_x) + len(per_y) - occupied - 1) / (2.0 * max(total, 1) * np.log(2.0))
        return [np.arange(n, dtype=np.int32), np.maximum(h(plog(per_x).sum()) + h(plog(per_y).sum()) - h(cells) + fix, 0.0)]

    return _grouped(joint.select(*by, x, y, F.col("w").cast("double").alias("w")).filter("w > 0"), by, fn, ["replicate", "mi_bits"])


#: Chances of at most 0, 1, 2 ... of a Poisson number of mean 1.
POISSON = tuple(accumulate(math.exp(-1) / math.factorial(k) for k in range(11)))


#: Replicates whose counts a task holds at once.
SLICE = 250


def bootstrap_divergence(rows: DataFrame, by: list[str], n: int, background: DataFrame) -> DataFrame:
    """(by, replicate, col_ix, jsd): every column's gap-weighted divergence in row bootstraps, from packed rows (by, row_id, symbols, weight) of one length.

    Each row comes a Poisson number of times, which needs no other row; a task multiplies its rows' numbers with their
    indicators, so that it gives out replicates x columns x symbols sums for a group, and rows never come together.
    """
    from .coupling import _codes, _indicators, add_up, alphabet_of, counted
    from .matrix import GAP

    alphabet = alphabet_of(rows)
    symbols = np.array([ord(c) for c in alphabet], "<u4")
    share = {r.symbol: r.q for r in background.collect()}  # a row for each symbol
    q = np.array([share.get(c, 0.0) for c in alphabet])
    unseen = 1.0 - q.sum()
    length = (rows.select(F.length("symbols")).head() or [0])[0]
    slices = F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(SLICE))).alias("_first")
    keyed = [*by, "_first"]
    wide = rows.select(*by, slices, F.col("row_id").cast("long").alias("_id"), F.col("symbols").alias("_x"), F.col("weight").cast("double").alias("_w"))
    wide = wide.withColumn("_at", F.col("_first"))

    def count(ids: pa.Array, x: pa.Array, weight: pa.Array, first: pa.Array) -> np.ndarray:
        a = first[0].as_py()
        r = np.arange(a, min(a + SLICE, n), dtype=np.int64)[:, None]
        times = np.searchsorted(np.array(POISSON), number(r, ids.to_numpy(zero_copy_only=False)[None, :]) / PRIME, "right").astype(np.float64)
        return times @ (_indicators(_codes(x.to_pylist()), symbols) * weight.to_numpy(zero_copy_only=False)[:, None])

    def finish(group: pa.Table) -> pa.Table:
        a = int(group.column("_first")[0].as_py())
        w = add_up(group).reshape(min(SLICE, n - a), length, len(symbols))
        res = np.where(np.array([c != GAP for c in alphabet]), w, 0.0)
        total, full = w.sum(axis=2), res.sum(axis=2)
        p = res / np.maximum(full, 1e-12)[:, :, None]
        mid = (p + q) / 2
        kl = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1.0) / np.where(mid > 0, mid, 1.0)), 0.0).sum(axis=2)
        jsd = (0.5 * (kl(p) + kl(np.broadcast_to(q, p.shape)) + unseen)) * full / np.maximum(total, 1e-12)
        rep, col = np.indices(jsd.shape)
        keys = [group.column(c).slice(0, 1).combine_chunks().take(pa.array(np.zeros(jsd.size, np.int64))) for c in by]
        return pa.table([*keys, pa.array((rep + a).ravel().astype(np.int32)), pa.array(col.ravel().astype(np.int32)), pa.array(jsd.ravel())], names=[*by, "replicate", "col_ix", "jsd"])

    schema = T.StructType([rows.schema[c] for c in by] + [T.StructField("replicate", T.IntegerType()), T.StructField("col_ix", T.IntegerType()), T.StructField("jsd", T.DoubleType())])
    return counted(wide, keyed, count, 4).groupBy(*keyed).applyInArrow(finish, schema)


def tail(null: DataFrame, observed: DataFrame, by: list[str], stat: str, how: str, around: str | None = None) -> DataFrame:
    """(by, observed, null_mean, null_sd, z, p): an ensemble against the observed value.

    ``how`` is ``greater`` (one-sided) or ``two_sided``: about 0, about the null mean (``around`` = "null"), or about a column of ``observed``.
    p is (hits + 1) / (replicates + 1); deviations are those of a population.
    """
    moments = null.groupBy(*by).agg(F.avg(stat).alias("null_mean"), F.stddev_pop(stat).alias("null_sd"), F.max(stat).alias("null_max"), F.count("*").alias("_n"))
    extra = [around] if around and around != "null" else []
    base = observed.select(*by, F.col(stat).alias("observed"), *extra)
    base = by_keys(base, moments, by)
    joined = null.select(*by, F.col(stat).alias("_x"))
    joined = by_keys(joined, base, by)
    centre = F.col("null_mean") if around == "null" else F.col(around) if around else F.lit(0.0)
    # a hair of tolerance, as sums of the same numbers in another order may differ in the last bits
    eps = 1e-9
    hit = F.col("_x") >= F.col("observed") - eps if how == "greater" else F.abs(F.col("_x") - centre) >= F.abs(F.col("observed") - centre) - eps
    hits = joined.groupBy(*by, "observed", "null_mean", "null_sd", "null_max", "_n").agg(F.sum(hit.cast("long")).alias("_k"))
    z = F.when(F.col("null_sd") > 0, (F.col("observed") - F.col("null_mean")) / F.col("null_sd"))
    return hits.select(*by, "observed", "null_mean", "null_sd", "null_max", z.alias("z"), ((F.col("_k") + 1) / (F.col("_n") + 1)).alias("p"))
