"""Replicate kernels, tails and pools against plain versions on small fixtures."""

import itertools
import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstat.functions import tails
from gridstat.operators import association, coupling, families, matrix, resample
from gridstat.plans import composites, registry
from gridstat.sources import tables

RNG = np.random.default_rng(3)


def numbers(reps, ids):
    return np.array([[resample.number(np.int64(r), np.int64(i)) for i in ids] for r in reps])


def test_subset_means(spark):
    rows = [(k, i, float(RNG.random()), 4 if k else 0) for k in (None, 1, 2) for i in RNG.permutation(30).tolist()]
    df = spark.createDataFrame(rows, "k int, id long, v double, size int")
    got = {(r.k, r.replicate): r.stat for r in resample.subset_means(df, "id", "v", "size", 50, ["k"]).collect()}
    assert len(got) == 150
    for k in (None, 1, 2):
        own = sorted((i, v) for kk, i, v, _ in rows if kk == k)
        size = 4 if k else 0
        for r, h in enumerate(numbers(range(50), [i for i, _ in own])):
            chosen = sorted(range(30), key=lambda j: (h[j], own[j][0]))[:size]
            assert got[k, r] == pytest.approx(np.mean([own[j][1] for j in chosen]) if size else 0.0)


def test_bootstrap_means(spark):
    x = RNG.random(25)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)], "k string, id long, v double").repartition(3)
    got = {r.replicate: r.stat for r in resample.bootstrap_means(df, "id", "v", 400, ["k"]).collect()}
    h = numbers(range(400), range(1, 26)) % 25
    assert all(got[r] == pytest.approx(x[h[r]].mean()) for r in range(400))
    assert np.mean(list(got.values())) == pytest.approx(x.mean(), abs=0.02) and np.std(list(got.values())) == pytest.approx(x.std() / 5, rel=0.15)


@pytest.mark.parametrize("chunk", [1 << 16, 40])
def test_stratified_sums(spark, chunk):
    """Means and deviations of permutations within strata; strata of several chunks are dealt as a whole."""
    rows = [(s, i + 1000 * n, float(RNG.normal(n, 1 + n)), bool(RNG.random() < 0.3)) for n, (s, size) in enumerate([("a", 30), (None, 300), ("c", 8)]) for i in range(size)]
    df = spark.createDataFrame(rows, "s string, id long, v double, f boolean").withColumn("half", F.coalesce("s", F.lit("b")))
    got = {r.replicate: r.flagged_sum for r in resample.stratified_sums(df, "s", "id", "v", "f", 3000, chunk).collect()}
    mean = var = 0.0
    for s in ("a", None, "c"):
        v = np.array([x for t, _, x, _ in rows if t == s])
        k, n = sum(f for t, _, _, f in rows if t == s), len(v)
        mean += k * v.mean()
        var += k * (n - k) / (n - 1) * v.var()
    x = np.array([got[r] for r in range(3000)])
    assert len(set(x.tolist())) > 2900 and abs(x.mean() - mean) < 4 * math.sqrt(var / 3000) and x.std() == pytest.approx(math.sqrt(var), rel=0.06)
    by = resample.stratified_sums(df, "s", "id", "v", "f", 20, chunk, ["half"]).groupBy("replicate").agg(F.sum("flagged_sum").alias("t"), F.count("*").alias("n")).collect()
    assert all(r.n == 3 and r.t == pytest.approx(got[r.replicate]) for r in by)


def test_numbers_of_items_are_those_of_the_arithmetic():
    """Numbers made without a division for a pair, at the edges of the prime too, are the stated ones, in a quarter of the bytes of two integers."""
    item, rep = np.array([0, 1, 2**31 - 3, 2**31 - 2, 2**31 - 1, 2**31, 10**12]), np.array([[0], [7], [9_999], [2**31 - 1]])
    h = (rep * 1_000_003 + item * 7_919 + 12_345) % resample.PRIME
    h = (h * h + (item + 1) % resample.PRIME) % resample.PRIME
    got = resample.numbers_of(item)(rep)
    assert got.dtype == np.uint32 and (got == (h * h + rep * 31 + 17) % resample.PRIME).all()


def test_least_sums_take_what_a_sort_takes():
    """Equal numbers (of equal ids), no rows, all rows and a value that is no number included."""
    ids = np.sort(RNG.integers(0, 300, 500))
    reps, k = np.arange(40), RNG.integers(0, 501, 40)
    k[:2] = 0, 500
    for x in (RNG.random(500), np.where(np.arange(500) == 7, np.nan, 1.0)):
        want = [x[np.argsort(resample.number(np.int64(r), ids), kind="stable")[:n]].sum() for r, n in zip(reps, k, strict=True)]
        assert resample.least_sums(ids, x, k, reps) == pytest.approx(want, nan_ok=True)
    assert resample.least_sums(ids[:0], x[:0], k[:3] * 0, reps[:3]).tolist() == [0.0] * 3


def test_stratified_sums_are_dealt_over_all_cores(spark):
    """A chunk's replicates are shared by tasks, and Spark does not bring these together as their bytes are few; fewer replicates than shares are whole."""
    df = spark.range(60).selectExpr("'a' AS s", "id", "cast(id AS double) AS v", "id % 3 = 0 AS f")
    out = resample.stratified_sums(df, "s", "id", "v", "f", 1001)
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().sparkPlan().toString() or "repartition" in out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(r.replicate for r in out.select("replicate").collect()) == list(range(1001))
    assert [resample.stratified_sums(df, "s", "id", "v", "f", n).count() for n in (1, 2, 3, 5)] == [1, 2, 3, 5]


def test_permuted_information(spark):
    """Draws of tables against rows that are permuted: the same distribution of the statistic."""
    x, y = RNG.integers(0, 4, 60), np.array([0] * 30 + [1] * 20 + [2] * 10)

    def information(a, b):
        t = np.zeros((4, 3))
        np.add.at(t, (a, b), 1)
        h = lambda w: -sum(p * math.log2(p) for p in (w / 60).ravel() if p > 0)
        fix = (sum(t.sum(axis=1) > 0) + sum(t.sum(axis=0) > 0) - (t > 0).sum() - 1) / (2 * 60 * math.log(2))
        return max(h(t.sum(axis=1)) + h(t.sum(axis=0)) - h(t) + fix, 0.0)

    joint = matrix.symbol_counts(spark.createDataFrame([(i, 0, "ABC-"[a], str(b)) for i, (a, b) in enumerate(zip(x.tolist(), y.tolist(), strict=True))], "row_id long, col_ix int, symbol string, grp string"), ["grp"])
    assert matrix.mutual_information(joint, ["col_ix"]).first().mi_bits == pytest.approx(information(x, y))
    got = np.array([r.mi_bits for r in resample.permuted_information(joint, ["col_ix"], "symbol", "grp", 10_000).collect()])
    want = np.array([information(x, RNG.permutation(y)) for _ in range(4000)])
    assert len(got) == 10_000 and got.mean() == pytest.approx(want.mean(), rel=0.06) and got.std() == pytest.approx(want.std(), rel=0.08)
    assert np.quantile(got, [0.9, 0.99]) == pytest.approx(np.quantile(want, [0.9, 0.99]), rel=0.12)


def test_bootstrap_divergence(spark):
    rows = [(g, i, "".join(RNG.choice(list("AB-"), 6)), float(RNG.random() + 0.5)) for g in ("x", None) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, row_id long, symbols string, weight double").repartition(4)
    q = {"A": 0.3, "B": 0.6, "Z": 0.1}
    got = {(r.g, r.replicate, r.col_ix): r.jsd for r in resample.bootstrap_divergence(df, ["g"], 300, spark.createDataFrame(list(q.items()), "symbol string, q double")).collect()}
    assert len(got) == 2 * 300 * 6
    u = numbers(range(300), range(40)) / resample.PRIME
    times = np.searchsorted(np.array(resample.POISSON), u, "right")
    assert times.mean() == pytest.approx(1.0, abs=0.03) and times.var() == pytest.approx(1.0, abs=0.06)
    for g in ("x", None):
        own = [r for r in rows if r[0] == g]
        for r in (0, 7, 299):
            for c in range(6):
                w = {s: sum(times[r, i] * wt for _, i, t, wt in own if t[c] == s) for s in "AB-"}
                full = w["A"] + w["B"]
                p = {s: (w.get(s, 0.0) / full if s in "AB" else 0.0) for s in q}
                kl = lambda a, m: sum(a[s] * math.log2(a[s] / m[s]) for s in q if a[s] > 0)
                mid = {s: (p[s] + q[s]) / 2 for s in q}
                assert got[g, r, c] == pytest.approx(0.5 * (kl(p, mid) + kl(q, mid)) * full / (full + w["-"]), abs=1e-9)


def test_pairs_of_columns(spark):
    n, rows = 50, {}
    for side, length in (("l", 3), ("r", 4)):
        rows[side] = ["".join(RNG.choice(list("AB-"), length)) for _ in range(n)]
    frames = [spark.createDataFrame(list(enumerate(rows[s])), "row_id long, symbols string") for s in "lr"]
    pool = [(k, int(a), int(b)) for k in (None, 1) for a, b in RNG.integers(0, n, (70, 2))]
    got = {(r.k, r.i, r.j): r.mi for r in coupling.interblock_mi(spark.createDataFrame(pool, "k int, a long, b long").repartition(3), *frames, ["k"]).collect()}
    assert len(got) == 2 * 3 * 4
    for (k, i, j), mi in got.items():
        pairs = [(rows["l"][a][i], rows["r"][b][j]) for kk, a, b in pool if kk == k]
        h = lambda xs: -sum(xs.count(x) / len(xs) * math.log2(xs.count(x) / len(xs)) for x in set(xs))
        assert mi == pytest.approx(h([x for x, _ in pairs]) + h([y for _, y in pairs]) - h(pairs), abs=1e-9)


@pytest.mark.parametrize("method", ["segments", "tiles"])
def test_several_thresholds_share_a_comparison(spark, method):
    rows = [(i % 2 or None, i, "".join(RNG.choice(list("AB"), 12))) for i in range(80)]
    df = spark.createDataFrame(rows, "g int, row_id long, symbols string")
    got = {(r.theta, r.row_id): r.neighbours for r in coupling.identity_weights(df, 12, (0.5, 0.75, 0.9), ["g"], method).collect()}
    for t in (0.5, 0.75, 0.9):
        for g, i, s in rows:
            assert got[t, i] == sum(h == g and sum(a == b for a, b in zip(s, x, strict=True)) / 12 >= t for h, _, x in rows)


def test_tails_in_plans(spark):
    d = spark.createDataFrame([(1.959964, 3.841459, 1, 2.228139, 10, 0.5, 8, 8, 2, 10, 4, 5)], "z double, x double, xd int, t double, td int, d double, n int, m int, k int, total int, marked int, drawn int")
    r = d.select(
        association.normal_p("z").alias("a"), association.chi2_p("x", "xd").alias("b"), association.t_p("t", F.col("td").cast("double")).alias("c"), association.kolmogorov_p("d", "n", "m").alias("e"), association.hypergeom_p("k", "total", "marked", "drawn").alias("f")
    ).first()
    assert (r.a, r.b, r.c) == pytest.approx((0.05, 0.05, 0.05), abs=1e-6)
    assert r.f == pytest.approx(sum(math.comb(4, i) * math.comb(6, 5 - i) for i in range(2, 5)) / math.comb(10, 5))
    far = [max(abs(sum(i < k for i in c) - (k - sum(i < k for i in c))) for k in range(17)) for c in itertools.combinations(range(16), 8)]
    assert r.e == pytest.approx(sum(x >= 4 for x in far) / len(far))
    assert tails.chi2_isf(1e-12, 6) == pytest.approx(68.1047, abs=1e-3)


def test_correlation_and_pooling_p(spark):
    """A rank correlation's p against permutations, and a pooled effect's by hand."""
    x = RNG.normal(size=60)
    y = 0.35 * x + RNG.normal(size=60)
    s = association.spearman(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double"), "x", "y")
    r = s.withColumn("p", association.correlation_p(F.col("rho"), F.col("n"))).first()
    rank = lambda v: np.argsort(np.argsort(v))
    null = np.array([np.corrcoef(rank(x), rank(RNG.permutation(y)))[0, 1] for _ in range(4000)])
    assert r.rho == pytest.approx(np.corrcoef(rank(x), rank(y))[0, 1]) and abs(r.p - (np.abs(null) >= abs(r.rho)).mean()) < 0.02
    t = spark.createDataFrame([(0.5, 0.1, 0.9), (0.1, -0.2, 0.4)], "e double, lo double, hi double")
    f = association.fixed_effect(t, "e", "lo", "hi").withColumn("p", association.normal_p("z")).first()
    w = [1 / ((h - lo) / (2 * 1.959964)) ** 2 for lo, h in ((0.1, 0.9), (-0.2, 0.4))]
    assert f.pooled == pytest.approx((0.5 * w[0] + 0.1 * w[1]) / sum(w)) and f.p == pytest.approx(math.erfc(f.pooled * math.sqrt(sum(w)) / math.sqrt(2)))


def test_forced_references_and_fallback(spark):
    src = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    got = families.assemble(spark.createDataFrame([(1, "old"), (9, "x")], "id long, v string"), spark.createDataFrame([(1,), (3,), (3,)], "id long"), src, "id").collect()
    assert sorted(map(tuple, got)) == [(1, "a", True), (3, "c", True), (9, "x", False)]
    with pytest.raises(Exception, match="no record of the reference 7"):
        families.assemble(src, spark.createDataFrame([(7,)], "id long"), src, "id").collect()
    pool = spark.createDataFrame([("k", 1), ("k", 2), (None, 3)], "g string, v int")
    universe = pool.unionByName(spark.createDataFrame([("k", 4), (None, 5), ("z", 6)], "g string, v int"))
    needs = spark.createDataFrame([("k", 2), (None, 2), ("z", 1)], "g string, need int")
    rows = families.with_fallback(pool, universe, needs, ["g"], "need").collect()
    assert sorted((str(r.g), r.v, r.fell_back, r.n_pool) for r in rows) == [("None", 3, True, 2), ("None", 5, True, 2), ("k", 1, False, 2), ("k", 2, False, 2), ("z", 6, True, 1)]
    assert families.large_enough(universe, ["g"], 2, F.col("v") > 2).count() == 2


def test_pages_follow_links():
    told = {"a": ([1, 2], "b"), "b": ([3], "c"), "c": ([], "a")}
    assert [x for rows in tables.pages(lambda at: told[at], "a") for x in rows] == [1, 2, 3]


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_matched_control(spark, sf):
    data = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{data}/part.parquet'")
    con.sql(f"CREATE VIEW binned AS {registry.ORACLES['tertile_strata']}")
    rows = con.sql("SELECT p_type, stratum, p_size <= 10, CAST(p_retailprice AS DOUBLE) FROM binned JOIN part USING (p_partkey)").fetchall()
    arms = defaultdict(lambda: ([], []))
    for _, stratum, flag, _ in rows:
        arms[stratum][flag].append(1)
    by_type = defaultdict(list)
    for kind, stratum, flag, v in rows:
        if all(arms[stratum]):
            by_type[kind].append((stratum, flag, v))
    want = {}
    for kind, members in by_type.items():
        stratum, flag, v = np.array([m[0] for m in members]), np.array([m[1] for m in members]), np.array([m[2] for m in members])
        if min(flag.sum(), (~flag).sum()) >= composites.LEAST_ARM:
            want[kind] = stratum, flag, v
    got = {r.p_type: r for r in registry.QUERIES["matched_control"](spark, data).collect()}
    assert got.keys() == want.keys()  # the smallest table has no type with enough rows in both arms
    assert bool(got) == (sf != "0.001")
    rng = np.random.default_rng(3)
    for kind, (stratum, flag, v) in want.items():
        r, a, b = got[kind], v[flag], v[~flag]
        assert r.cliffs_delta == pytest.approx(np.sign(a[:, None] - b).mean(), abs=1e-6)
        at = np.concatenate([a, b])[:, None]
        assert r.ks == pytest.approx(np.abs((a <= at).mean(1) - (b <= at).mean(1)).max(), abs=1e-6)
        assert r.n_strata == len(set(stratum))
        assert (r.mean_flagged, r.mean_control) == pytest.approx((a.mean(), b.mean()), abs=1e-5)
        assert r.difference == pytest.approx(a.mean() - b.mean(), abs=1e-5)
        null = []
        for _ in range(2000):
            drawn = flag.copy()
            for one in set(stratum):
                drawn[stratum == one] = rng.permutation(drawn[stratum == one])
            null.append(v[drawn].mean() - v[~drawn].mean())
        null = np.array(null)
        p = (1 + (np.abs(null) >= abs(a.mean() - b.mean()) - 1e-9).sum()) / 2001
        assert r.permutation_p == pytest.approx(p, abs=0.06)
        assert r.delta_ci_low <= r.cliffs_delta <= r.delta_ci_high
    ps = sorted(r.permutation_p for r in got.values())
    for r in got.values():
        assert r.q_bh == pytest.approx(min(1, *(p * len(ps) / (i + 1) for i, p in enumerate(ps) if p >= r.permutation_p)), abs=5e-6)  # of p-values rounded to 6 places, times 6 tests at most


def test_numbers_are_remainders():
    """Numbers made without divisions are those of the formula that SQL states."""
    r, i = np.arange(0, 10_000, 37, dtype=np.int64)[:, None], np.concatenate([np.arange(-3, 500), 2**31 + np.arange(-3, 3), 7 * 10**11 + np.arange(50), np.full(1, -(10**12))])[None, :]
    h = (r * 1_000_003 + i * 7_919 + 12_345) % resample.PRIME
    h = (h * h + i + 1) % resample.PRIME
    assert (resample.number(r, i) == (h * h + r * 31 + 17) % resample.PRIME).all()


def test_draws_of_few_keys_are_spread(spark):
    """The draws of one key are made by several tasks, whatever they weigh in bytes."""
    df = spark.range(400).select(F.lit("k").alias("k"), (F.col("id") % 50).cast("double").alias("v"), (F.col("id") % 3 == 0).alias("arm"))
    out = resample.bootstrap_deltas(df, "v", "arm", 2_000, ["k"]).withColumn("task", F.spark_partition_id())
    rows = out.collect()
    assert len(rows) == 2_000 and len({r.task for r in rows}) > 1


def test_places_are_numbered_once(monkeypatch):
    """What a draw's number has of its place is made once for all replicates, and draws are those of the formula, in one piece or several."""
    made, real = [], resample.numbers_of
    monkeypatch.setattr(resample, "numbers_of", lambda item: made.append(item.size) or real(item))
    r = np.arange(30, 70, dtype=np.int64)
    for counts in ([3, 0, 4], [9_000, 1, 11_000], [1], []):
        counts, made[:] = np.array(counts, np.int64), []
        for own in (0, 1):
            got = resample.draws_by_value(counts, own, r)
            size = int(counts.sum())
            pick = (resample.number(r[:, None], 2 * np.arange(1, size + 1, dtype=np.int64)[None, :] + own)) % max(size, 1)
            want = [np.bincount(np.searchsorted(np.cumsum(counts), p, "right"), minlength=len(counts)) for p in pick]
            assert (got == np.array(want).reshape(got.shape)).all()
            made.remove(size)  # of ``number``
        assert sum(made) == 2 * counts.sum()
