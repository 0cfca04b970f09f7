"""The distance join cuts crowded cells over tasks, keeps no pair, and gives rows in an order that files hold in few bytes."""

import math
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gridstat.operators import spatial
from gridstat.plans.registry import rounded

KIND = "g string, i long, x double, y double, z double"


def named(spark, points, g, i):
    return spark.createDataFrame(points, KIND).repartition(3).withColumnsRenamed({"g": g, "i": i})


@pytest.mark.parametrize("each,pairs,given", [(2048, 1 << 21, 1 << 16), (3, 7, 2)])
def test_crowded_cells_are_cut(spark, monkeypatch, each, pairs, given):
    """Pairs and distances are those of all pairs: one crowded place, null keys and coordinates, keys of several points, a pair at the cutoff."""
    for name, value in (("EACH", each), ("PAIRS", pairs), ("GIVEN", given)):
        monkeypatch.setattr(spatial, name, value)
    r = random.Random(4)
    free = lambda n: [(r.choice(["p", None]), n + i, *(r.uniform(-1, 1) for _ in "xyz")) for i in range(40)]
    crowd = lambda n: [("c", n + i, 0.1, 0.1, 0.1 + i * 1e-3) for i in range(20)]
    a = [*free(0), *crowd(100), (None, 500, None, 0.0, 0.0), ("e", 501, 5.0, 5.0, 5.0), ("e", 501, 5.2, 5.0, 5.0)]
    b = [*free(1000), *crowd(1100), ("n", None, 5.4, 5.0, 5.0), ("s", 1502, 5.5, 5.0, 5.0), (None, 1501, 0.0, 0.0, None)]
    length = lambda x, y, z: math.sqrt(x * x + y * y + z * z)
    for left in (a, [p for p in a if p[1] != 501]):  # keys of two points, and unique ones
        got = spatial.distance_join(named(spark, left, "ga", "a"), named(spark, b, "gb", "b"), 0.5, ["ga", "a"], ["gb", "b"])
        want = {}
        for p in left:
            for q in b:
                if None not in (*p[2:], *q[2:]) and (d := length(*(u - v for u, v in zip(p[2:], q[2:], strict=True)))) <= 0.5:
                    want[p[:2] + q[:2]] = min(d, want.get(p[:2] + q[:2], d))
        rows = got.select("ga", "a", "gb", "b", "distance").collect()
        assert {tuple(x)[:4]: x[4] for x in rows} == want and len(rows) == len(want) > 400


def test_near_values_lie_together(spark, tmp_path):
    """Distances that are given by bands take less than 7 bytes a row with their keys; no pair is sorted or shuffled after it is met."""
    p = spark.range(1200).select("id", *(F.rand(s).alias(c) for s, c in enumerate("xyz")))
    a, b = p.filter("id < 600").withColumnRenamed("id", "a"), p.filter("id >= 600").withColumnRenamed("id", "b")
    near = spatial.distance_join(a, b, 0.9, ["a"], ["b"])
    plan = near._jdf.queryExecution().sparkPlan().toString()
    assert plan.index("MapInArrow") < plan.index("Sort") and "Join" not in plan
    rounded(near, "distance", digits=5).write.parquet(str(tmp_path / "out"))
    n = spark.read.parquet(str(tmp_path / "out")).count()
    assert n > 200_000 and sum(f.stat().st_size for f in Path(tmp_path / "out").glob("*.parquet")) < 7 * n


def test_distances_are_rounded_as_others(spark):
    """Halves are rounded up by the product, as ``rounded`` and SQL do."""
    from unittest import mock

    from gridstat.plans import mapping

    values = [0.0, 5e-7, 1.5e-6, 2.5e-6, 0.49999999999999994e-6, 0.1199995, 0.0000015, 0.0345675, 0.12, *(random.Random(2).random() * 0.12 for _ in range(2000))]
    df = spark.createDataFrame([(v,) for v in values], "distance double")
    with mock.patch.object(mapping, "contacts", lambda *_: df):
        assert sorted(mapping.distance_join(spark, "").collect()) == sorted(rounded(df, "distance").collect())
