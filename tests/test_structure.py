"""Alignments against a plain recurrence; exposed area against all distances, and what a large chain's tasks hold."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstat.functions import alignment
from gridstat.operators import structure
from gridstat.sources.tables import read_substitution

RNG = np.random.default_rng(11)


def plain(xyz, radius, chain, points, probe):
    unit, r, out = structure.sphere(points), np.asarray(radius) + probe, []
    for i in range(len(xyz)):
        at = xyz[i] + unit * r[i]
        others = [j for j in range(len(xyz)) if j != i and chain[j] == chain[i]]
        free = (np.linalg.norm(at[:, None] - xyz[others][None], axis=2) >= r[others][None]).all(axis=1)
        out.append(4 * np.pi * r[i] ** 2 * free.mean())
    return np.array(out)


def atoms(spark, xyz, radius, chain):
    rows = [(c, i // 3, *map(float, p), float(r)) for i, (c, p, r) in enumerate(zip(chain, xyz, radius, strict=True))]
    return spark.createDataFrame(rows, "chain string, residue int, x double, y double, z double, radius double").repartition(3)


@pytest.mark.parametrize("spread", [3.0, 12.0, 60.0])
def test_exposed_area_equals_all_distances(spark, spread):
    n = 240
    xyz, radius = RNG.normal(0, spread, (n, 3)), RNG.choice([1.2, 1.7, 1.9], n)
    xyz[:20] = np.round(xyz[:20])
    chain = [None if i % 5 == 0 else "A" if i < 120 else "B" for i in range(n)]
    want = {}
    for i, area in enumerate(plain(xyz, radius, chain, 92, 1.4)):
        want[chain[i], i // 3] = want.get((chain[i], i // 3), 0.0) + area
    got = {(r.chain, r.residue): r.sasa for r in structure.exposed_area(atoms(spark, xyz, radius, chain), 92, 1.4).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_a_lone_atom_and_none(spark):
    one = atoms(spark, [(0.0, 0.0, 0.0)], [1.6], ["A"])
    assert structure.exposed_area(one, 50, 1.4).first().sasa == pytest.approx(4 * np.pi * 9)
    assert structure.exposed_area(one.limit(0)).count() == 0
    bad = one.withColumn("x", F.lit(None).cast("double"))
    assert structure.exposed_area(one.unionByName(bad), 50, 1.4).count() == 1


def test_one_long_chain_is_many_blocks(spark):
    """120,000 atoms of one chain on a lattice: every inner atom has the same area, and no task holds the chain."""
    side = 60
    df = spark.range(side * side * 34, numPartitions=4).select(F.lit("A").alias("chain"), F.col("id").cast("int").alias("residue"), *((F.floor(F.col("id") / side**k) % side * 2.0).alias(c) for k, c in enumerate("xyz")), F.lit(1.0).alias("radius"))
    out = structure.exposed_area(df, 30, 0.4).withColumn("n", F.col("residue") % side)
    inner = out.filter(F.col("n").between(1, side - 2) & (F.floor(F.col("residue") / side) % side).between(1, side - 2) & F.floor(F.col("residue") / side**2).between(1, 32))
    assert out.count() == side * side * 34
    assert inner.agg(F.count_distinct(F.round("sasa", 9))).first()[0] == 1


def best_score(a, b, scores, gap_open, gap_extend):
    """Cell by cell, each gap of each length tried."""
    best = np.zeros((len(a) + 1, len(b) + 1))
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        gap = lambda g: gap_open + (g - 1) * gap_extend
        best[i, j] = max([best[i - 1, j - 1] + scores[a[i - 1], b[j - 1]], *(best[i - g, j] + gap(g) for g in range(1, i + 1)), *(best[i, j - g] + gap(g) for g in range(1, j + 1))])
    return max(best[len(a)].max(), best[:, len(b)].max())


@pytest.mark.parametrize("cells", [1 << 26, 3000])
@pytest.mark.parametrize("gaps", [(-12.0, -1.0), (-3.0, -2.0), (-2.0, -2.0)])
def test_alignments_equal_a_plain_recurrence(monkeypatch, gaps, cells):
    monkeypatch.setattr(alignment, "CELLS", cells)
    letters = "ABCé"
    scores = {(x, y): float(v) for (x, y), v in zip(itertools.combinations_with_replacement(letters, 2), RNG.integers(-5, 7, 10), strict=True)}
    full = scores | {(y, x): v for (x, y), v in scores.items()}
    draw = lambda n: "".join(RNG.choice(list(letters), RNG.integers(0, n)))
    a, b = [draw(25) for _ in range(60)], [draw(30) for _ in range(60)]
    top, k, i, j = alignment.align_many(a, b, scores, *gaps)
    for p in range(60):
        assert top[p] == pytest.approx(best_score(a[p], b[p], full, *gaps))
        x, y = i[k == p], j[k == p]
        assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all()
        # what the places themselves are worth is the score
        worth = sum(full[a[p][s], b[p][t]] for s, t in zip(x, y, strict=True))
        for g in [*(np.diff(x) - 1), *(np.diff(y) - 1)]:
            worth += gaps[0] + (g - 1) * gaps[1] if g > 0 else 0
        # at an end one side's gap is free, not both
        for g, h in [(x[0], y[0]), (len(a[p]) - 1 - x[-1], len(b[p]) - 1 - y[-1])] if len(x) else []:
            worth += gaps[0] + (min(g, h) - 1) * gaps[1] if min(g, h) > 0 else 0
        assert worth == pytest.approx(top[p])


def test_substitution_file_and_guards(spark, tmp_path):
    (tmp_path / "table").write_text("# by rule\n   C  D  E  W\nC  9 -3 -4 -2\nD -3  6  2 -4\nE -4  2  5 -3\nW -2 -4 -3 11\n")
    scores = read_substitution(spark, str(tmp_path / "table"))
    assert len(scores) == 16 and scores["D", "E"] == scores["E", "D"] == 2
    d = spark.createDataFrame([("A", [7, 9], "DW", "CCEWD"), ("B", [], "", "C"), (None, [1], "W", "DW"), ("C", None, None, "D")], "chain string, numbers array<int>, observed string, canonical string")
    s = {r.chain: (r.score, r.n_mapped, r.n_equal) for r in structure.alignment_scores(d, scores).collect()}
    assert s == {"A": (13.0, 2, 1), "B": (0.0, 0, 0), None: (11.0, 1, 1), "C": (0.0, 0, 0)}
    assert [tuple(r) for r in structure.map_to_canonical(d.filter("chain is null or chain != 'A'"), scores).collect()] == [(None, 1, 2)]
    with pytest.raises(Exception, match="2 of 2 residues mapped, 1 equal"):
        structure.map_to_canonical(d, scores).collect()
    # the share must be above the limit
    half = spark.createDataFrame([("A", [7, 9], "DW", "CCEWD")], d.schema)
    with pytest.raises(Exception, match="mapped"):
        structure.map_to_canonical(half, scores, 0.5, 0.5).collect()
    assert structure.map_to_canonical(half, scores, 0.5, 0.49).count() == 2


def test_loops_are_found_again(spark):
    from gridstat.plans import structure as plans

    r = plans.structure.alignment_scores(plans.chains(spark, "/root/testdata/sf0.001"), plans.SCORES).toPandas()
    assert (r.n_mapped >= 40).all() and (r.n_equal >= 40).all()
