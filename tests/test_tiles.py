"""Pairs of columns and of rows, counted by tiles, at widths and depths of more than one tile."""



import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstat.operators import coupling, matrix

RNG = np.random.default_rng(3)
LETTERS = np.array(list("ACDEFGHIKLMNPQRSTVWY-"))


def packed(spark, codes, first=0):
    return spark.createDataFrame([(first + i, "".join(LETTERS[r])) for i, r in enumerate(codes)], "row_id long, symbols string")


def test_wide_blocks_by_tiles(spark):
    """319 x 235 columns of 21 symbols: one matrix of counts would be 264 MB; each tile's is at most 8 MB."""
    n, l1, l2 = 300, 319, 235
    x, y = RNG.integers(0, 21, (n, l1)), RNG.integers(0, 21, (n, l2))
    y[:, 7] = x[:, 300]
    pool = spark.createDataFrame([(i, i) for i in range(n)], "a long, b long")
    got = coupling.interblock_mi(pool, packed(spark, x), packed(spark, y)).toPandas()
    assert len(got) == l1 * l2 and not got.duplicated(["i", "j"]).any()
    mi = got.pivot(index="i", columns="j", values="mi").to_numpy()

    def plain(a, b):
        t = np.zeros((21, 21))
        np.add.at(t, (a, b), 1.0 / n)
        h = lambda p: -(p[p > 0] * np.log2(p[p > 0])).sum()
        return h(t.sum(1)) + h(t.sum(0)) - h(t)

    for i, j in [(0, 0), (47, 48), (48, 47), (300, 7), (318, 234), (96, 191)]:
        assert mi[i, j] == pytest.approx(plain(x[:, i], y[:, j]), abs=1e-9)
    assert np.unravel_index(mi.argmax(), mi.shape) == (300, 7)


def test_counts_of_a_tile_are_bounded(spark, monkeypatch):
    """No matrix that a task gives out is over 8 MB, and equal rows are dealt over tasks."""
    seen = []
    plain = coupling.counted
    monkeypatch.setattr(coupling, "counted", lambda *a: seen.append(plain(*a)) or seen[-1])
    x = np.tile(RNG.integers(0, 21, (1, 100)), (64, 1))
    pool = spark.createDataFrame([(i, i) for i in range(64)], "a long, b long")
    coupling.interblock_mi(pool, packed(spark, np.vstack([x, RNG.integers(0, 21, (1, 100))])), packed(spark, x)).count()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = seen[0].select("_i", "_j", F.length("counts").alias("n")).toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes.n.max() <= 8 * coupling.SIDE**2
    assert sizes.groupby(["_i", "_j"]).size().min() > 1


def test_planes_count_equal_places():
    for symbols, length in [(2, 1), (3, 64), (21, 65), (300, 130), (1, 5)]:
        x, y = RNG.integers(0, symbols, (17, length)), RNG.integers(0, symbols, (9, length))
        both = coupling._planes(np.vstack([x, y]))
        assert (coupling.equal_places(both[:17], both[17:], length) == (x[:, None] == y[None]).sum(axis=2)).all()


@pytest.mark.parametrize("tile", [40, 4096])
def test_tiles_equal_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(coupling, "TILE", tile)
    monkeypatch.setattr(coupling, "HELD", 32 * 40 * 3)
    codes = RNG.integers(0, 3, (260, 20))
    codes[100:180] = codes[0]
    groups = np.where(np.arange(260) % 4 == 0, None, "g")
    rows = [(groups[i], i, "".join(LETTERS[r])) for i, r in enumerate(codes)]
    df = spark.createDataFrame(rows, "g string, row_id long, symbols string")
    got = {(r.theta, r.row_id): r.neighbours for r in coupling.identity_weights(df, 20, (0.4, 0.6), ["g"], "tiles").collect()}
    same = (codes[:, None] == codes[None]).mean(axis=2)
    alike = np.array([[a == b for b in groups] for a in groups])
    assert len(got) == 2 * 260
    for t in (0.4, 0.6):
        want = ((same >= t) & alike).sum(axis=1)
        assert all(got[t, i] == want[i] for i in range(260))


def test_published_depth_of_rows_in_one_plan(spark):
    """2,912 rows of 319 columns in conserved families: every pair is compared, no row's list of others is gathered."""
    base = RNG.integers(0, 21, (8, 319))
    codes = np.repeat(base, 364, axis=0)
    codes = np.where(RNG.random(codes.shape) < 0.1, RNG.integers(0, 21, codes.shape), codes)
    df = packed(spark, codes)
    out = coupling.identity_weights(df, 319, 0.8, method="tiles")
    plan = out._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "CartesianProduct" not in plan
    got = np.array([r.neighbours for r in out.orderBy("row_id").collect()])
    want = np.zeros(len(codes), int)
    for i in range(len(codes)):
        want[i] = ((codes == codes[i]).sum(axis=1) / 319 >= 0.8).sum()
    assert (got == want).all()


def test_cells_are_counted_without_sorting(monkeypatch):
    """Numbers of a dense range are counted in a table, others are sorted, with the same result."""
    cell, weight = RNG.integers(0, 5_000, 20_000), RNG.random(20_000)
    want, plain = matrix.counted_cells(cell * 10_000, weight), matrix.counted_cells(cell * 10_000)
    monkeypatch.setattr(np, "unique", None)
    for got, other in ((matrix.counted_cells(cell, weight), want), (matrix.counted_cells(cell), plain)):
        assert (got[0] * 10_000 == other[0]).all() and (got[1] == other[1]).all()
