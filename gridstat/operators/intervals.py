"""Joins of points and intervals, and of intervals with one another, without a row for each place of an interval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bins of level k are 2 ** (STEP * k) places wide.
STEP = 2
#: Levels up to bins of 2 ** 62 places: intervals may be as long as that.
LEVELS = 62 // STEP
#: At most so many intervals are sent to all tasks; more are shuffled.
FEW = 10_000


def _level(length: Column) -> Column:
    """The least level whose bins are at least as wide as ``length`` places."""
    return F.coalesce(*(F.when(length <= F.lit(1 << (STEP * k)), F.lit(k)) for k in range(LEVELS + 1)))


def _bin(place: Column, level: Column) -> Column:
    """Arithmetic shift: bins of negative places lie below 0."""
    return F.call_function("shiftright", place, level * F.lit(STEP))


def point_join(points: DataFrame, intervals: DataFrame, place: str, start: str, end: str, keys: list[str] = []) -> DataFrame:
    """Every point with every interval of equal keys that holds it, ends included: the columns of ``points``, then those of ``intervals`` that are no keys.

    An interval is filed in bins as wide as itself or wider, so in at most two of them; a point looks into one bin of each
    level that any interval has.  The join is one on equal (keys, level, bin), and the exact test follows.  The levels,
    with the number and the ends of the intervals of each, are read first: at most ``LEVELS`` + 1 rows, however many
    intervals; intervals of like length have one or two.  Up to ``FEW`` intervals are broadcast, so that points stay where they are.
    Null keys are equal.  Null places, null ends and intervals that end before they start meet nothing.
    """
    named = {c: f"_v_{c}" for c in intervals.columns}
    v = intervals.withColumnsRenamed(named)
    a, b = F.col(f"_v_{start}").cast("long"), F.col(f"_v_{end}").cast("long")
    filed = v.filter(a <= b).withColumn("_level", _level(b - a + 1)).filter("_level is not null")
    held = {r[0]: r[1:] for r in filed.groupBy("_level").agg(F.count("*"), F.min(a), F.max(b)).collect()}
    levels = sorted(held)
    ends = F.array_distinct(F.array(_bin(a, F.col("_level")), _bin(b, F.col("_level"))))
    filed = filed.withColumn("_bin", F.explode(ends))
    if sum(v[0] for v in held.values()) <= FEW:
        filed = F.broadcast(filed)
    at = F.col(place).cast("long")
    asked = F.array(*(F.struct(F.lit(k).alias("k"), _bin(at, F.lit(k)).alias("b")) for k in levels)) if levels else F.array(F.struct(F.lit(-1).alias("k"), F.lit(0).cast("long").alias("b")))
    # points beside all intervals are dropped at once, and nulls with them
    p = points.filter(at.between(min((v[1] for v in held.values()), default=0), max((v[2] for v in held.values()), default=-1))).withColumn("_asked", F.explode(asked))
    on = [F.col("_asked.k") == F.col("_level"), F.col("_asked.b") == F.col("_bin"), *(F.col(k).eqNullSafe(F.col(named[k])) for k in keys)]
    j = p.join(filed, reduce(lambda x, y: x & y, on)).filter(at.between(a, b))
    return j.select(*points.columns, *(F.col(named[c]).alias(c) for c in intervals.columns if c not in keys))


def overlap_join(left: DataFrame, right: DataFrame, left_ends: tuple[str, str], right_ends: tuple[str, str], keys: list[str] = []) -> DataFrame:
    """Every pair of intervals of equal keys that share a place, once: the columns of ``left``, then those of ``right`` that are no keys.

    Two intervals overlap where one starts inside the other: first the left ones that start in a right one, then the right
    ones that start later than the left one and inside it.  Both are joins of points and intervals.
    """
    ok = lambda df, ends: df.filter(F.col(ends[0]).cast("long") <= F.col(ends[1]).cast("long"))
    left, right = ok(left, left_ends), ok(right, right_ends)
    columns = [*left.columns, *(c for c in right.columns if c not in keys)]
    into_right = point_join(left, right, left_ends[0], *right_ends, keys).select(columns)
    into_left = point_join(right, left, right_ends[0], *left_ends, keys).filter(F.col(right_ends[0]).cast("long") > F.col(left_ends[0]).cast("long"))
    return into_right.unionByName(into_left.select(columns))
