"""Joins with intervals against all pairs."""

import random

import pytest

from gridstat.operators import intervals

RNG = random.Random(5)


def some(n, widest):
    out = []
    for i in range(n):
        a = RNG.randrange(-(10**9), 10**9) if i % 2 else RNG.randrange(-50, 50)
        out.append((RNG.choice([None, "x", "y"]), i, a, a + int(RNG.random() ** 6 * widest)))
    return out


@pytest.mark.parametrize("few", [0, 10_000])
def test_points_in_intervals_of_all_lengths(spark, monkeypatch, few):
    monkeypatch.setattr(intervals, "FEW", few)
    v = [*some(120, 2 * 10**9), (None, 900, None, 5), ("x", 901, 3, None), ("x", 902, 9, 2), ("y", 903, 7, 7), ("y", 904, -(2**61), 2**61 - 2)]
    p = [(RNG.choice([None, "x", "y"]), i, RNG.choice([a for _, _, a, _ in v if a is not None]) + RNG.randrange(3)) for i in range(150)] + [("x", 500, None)]
    got = intervals.point_join(spark.createDataFrame(p, "k string, id long, at long"), spark.createDataFrame(v, "k string, v long, a long, b long"), "at", "a", "b", ["k"])
    assert got.columns == ["k", "id", "at", "v", "a", "b"]
    rows = [(r.id, r.v) for r in got.collect()]
    want = [(i, j) for k, i, at in p for h, j, a, b in v if k == h and None not in (at, a, b) and a <= at <= b]
    assert sorted(rows) == sorted(want) and len(want) > 150


def test_an_interval_lies_in_two_bins_at_most(spark):
    """An interval of 1e9 places: no row for each of them, on either side."""
    v = spark.createDataFrame([(0, 10**9), (5, 6)], "a long, b long")
    p = spark.range(1000).selectExpr("id * 1000000 as at")
    out = intervals.point_join(p, v, "at", "a", "b")
    assert out.count() == 1000
    assert "sequence" not in out._jdf.queryExecution().toString()


def test_no_intervals_and_no_points(spark):
    v, p = spark.createDataFrame([], "a long, b long"), spark.createDataFrame([(1,)], "at long")
    assert intervals.point_join(p, v, "at", "a", "b").count() == 0
    assert intervals.point_join(p.limit(0), spark.createDataFrame([(1, 2)], "a long, b long"), "at", "a", "b").count() == 0


@pytest.mark.parametrize("widest", [40, 10**9])
def test_overlaps(spark, widest):
    x, y = some(80, widest) + [(None, 80, 3, 3)] * 2, some(90, widest) + [("x", 91, 5, 1)]
    got = intervals.overlap_join(spark.createDataFrame(x, "k string, i long, a long, b long"), spark.createDataFrame(y, "k string, j long, c long, d long"), ("a", "b"), ("c", "d"), ["k"])
    want = [(i, j) for k, i, a, b in x for h, j, c, d in y if k == h and a <= d and c <= b and c <= d]
    assert sorted((r.i, r.j) for r in got.collect()) == sorted(want)
