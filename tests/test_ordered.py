"""Orders over several partitions, exact tails, and bootstraps by counts, against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstat.functions import lattice
from gridstat.functions.ordered import accumulated, average_rank, ranks, row_numbers, running
from gridstat.operators import association, mapping, ranking, resample
from gridstat.operators import matrix as m
from gridstat.plans import registry


def frame(spark, n, seed=1):
    r = random.Random(seed)
    rows = [(i, r.choice(["a", "b", None, "c"]), r.choice([None, 1.5, 2.5, 2.5, -3.0]), r.randint(0, 9)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, k string, v double, w long").repartition(5)


def by_value(row):
    return (row[2] is not None, row[2] or 0.0, row[0])


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_running_sums_of_ties_over_partitions(spark, keys):
    """Three values, many ties and null keys: positions and sums go on from partition to partition."""
    rows, df = frame(spark, 4000)
    got = {r["id"]: (r["rn"], r["before"]) for r in running(row_numbers(df, "v", ["id"], keys), "v", ["id"], "w", keys).collect()}
    want, seen = {}, {}
    for row in sorted(rows, key=by_value):
        k = row[1] if keys else 0
        n, s = seen.get(k, (0, 0))
        want[row[0]] = (n + 1, s)
        seen[k] = (n + 1, s + row[3])
    assert got == want


def test_one_value_is_dealt_over_tasks(spark):
    """Rows of one value go to several partitions by their tie-break, and no plan holds a list of ranges."""
    df = spark.range(20_000).select("id", F.lit(1).alias("v"))
    with_parts = accumulated(df.withColumn("one", F.lit(1)), [], [F.asc("v"), F.asc("id")], {"n": "one"})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = df.repartitionByRange("v", "id").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert parts == 4 and with_parts.agg(F.max("n"), F.sum(F.col("n") - F.col("id"))).first() == (20_000, 20_000)


def test_least_from_the_end(spark):
    """Running minima in descending order, on doubles, and an empty table."""
    rows, df = frame(spark, 900, 2)
    df = df.filter("v is not null").withColumn("x", (F.col("id") * 7919 % 1000).cast("double"))
    out = accumulated(df, ["k"], [F.desc("v"), F.asc("id")], least={"low": "x"})
    low = {}
    for i, k, v, _ in sorted((r for r in rows if r[2] is not None), key=lambda r: (-r[2], r[0])):
        low[i] = low[k, "now"] = min(i * 7919 % 1000, low.get((k, "now"), math.inf))
    assert {r["id"]: r["low"] for r in out.collect()} == {k: v for k, v in low.items() if not isinstance(k, tuple)}
    assert accumulated(df.filter("id < 0"), ["k"], [F.desc("v")], least={"low": "x"}).collect() == []


def test_ranks(spark):
    rows, df = frame(spark, 500, 3)
    less = {(r["k"], r["v"]): (r["ties"], r["less"]) for r in ranks(df, "v", ["k"]).collect()}
    for k, v in {(r[1], r[2]) for r in rows}:
        own = [by_value((0, 0, r[2]))[:2] for r in rows if r[1] == k]
        assert less[k, v] == (own.count(by_value((0, 0, v))[:2]), sum(x < by_value((0, 0, v))[:2] for x in own))
    one = {r["id"]: r["avg_rank"] for r in average_rank(df, "v", ["k"]).collect()}
    assert all(one[i] == less[k, v][1] + (less[k, v][0] + 1) / 2 for i, k, v, _ in rows)


def test_false_discovery_by_group(spark):
    r = random.Random(4)
    rows = [(i, r.choice([None, "g", "h"]), r.choice([None, r.random() ** 3, 0.01, 0.2])) for i in range(300)]
    got = {x["id"]: x["q_bh"] for x in ranking.benjamini_hochberg(spark.createDataFrame(rows, "id long, g string, p double"), "p", ["g"]).collect()}
    for g in (None, "g", "h"):
        own = sorted((p, i) for i, k, p in rows if k == g and p is not None)
        q = 1.0
        for rank in range(len(own), 0, -1):
            q = min(q, own[rank - 1][0] * len(own) / rank)
            assert got[own[rank - 1][1]] == pytest.approx(q, abs=1e-12) or own[rank - 1][0] == (own[rank][0] if rank < len(own) else None)
    assert all(got[i] is None for i, _, p in rows if p is None)


@pytest.mark.parametrize(("n", "k"), [(4, 5), (6, 6), (1, 8), (7, 3)])
def test_exact_tails_by_all_paths(n, k):
    far, area = [], []
    for up in itertools.combinations(range(n + k), n):
        i = j = d = a = 0
        for s in range(n + k):
            i, j, a = (i + 1, j, a + j) if s in up else (i, j + 1, a)
            d = max(d, abs(i * k - j * n))
        far.append(d)
        area.append(a)
    for h in set(far):
        assert lattice.ks_tail(h / (n * k), n, k) == pytest.approx(sum(x >= h for x in far) / len(far), abs=1e-14)
    assert lattice.u_counts(n, k) == [area.count(u) for u in range(n * k + 1)]
    for u in set(area):
        top = max(u, n * k - u)
        assert lattice.u_tail(u, n, k, 0.0, False) == pytest.approx(min(1.0, 2 * sum(x >= top for x in area) / len(area)))


def test_published_kolmogorov_smirnov():
    """P-values published for samples of these sizes, and the distances (times n m) that have them."""
    published = [(31, 53, 330, 0.34945156855705983), (31, 64, 417, 0.2675280772806417), (42, 209, 1513, 0.22235250449153715), (51, 195, 1268, 0.48113975930169767)]
    for n, k, h, p in published:
        assert lattice.ks_tail(h / (n * k), n, k) == pytest.approx(p, abs=1e-12)
    assert lattice.ks_tail(1.0, 400, 300) == pytest.approx(2 / math.comb(700, 300), rel=1e-9)  # a tail far below 1e-16
    assert math.isnan(lattice.ks_tail(0.5, 0, 3)) and lattice.ks_tail(0.0, 3, 4) == 1.0
    assert 0 < lattice.ks_tail(0.02, 20_000, 9_000) < 0.05  # beyond the count, by the limit


def test_tests_of_arms(spark):
    """Exact p in plans; tied or large samples take the normal approximation; an empty arm has none."""
    rows = [("small", v, v in (1.0, 2.0, 7.0)) for v in map(float, range(1, 9))] + [("tied", v, v < 3) for v in (1.0, 2.0, 2.0, 3.0, 4.0)] + [("empty", 1.0, True)]
    x = spark.createDataFrame(rows, "g string, v double, arm boolean")
    t = association.mann_whitney(x, "v", "arm", ["g"], ties=True).withColumn("p", association.mann_whitney_p("u", "n_a", "n_b", "z", "tie"))
    got = {r["g"]: (r["p"], r["z"]) for r in t.collect()}
    u = sum(a > b for a in (1, 2, 7) for b in (3, 4, 5, 6, 8))
    exact = [sum(a > b for a in c for b in range(1, 9) if b not in c) for c in itertools.combinations(range(1, 9), 3)]
    assert got["small"][0] == pytest.approx(min(1, 2 * sum(e >= max(u, 15 - u) for e in exact) / len(exact)))
    assert got["tied"][0] == pytest.approx(math.erfc(abs(got["tied"][1]) / math.sqrt(2)))
    assert got["empty"][0] is None or math.isnan(got["empty"][0])


def test_bootstrap_of_delta_by_counts(spark):
    """Replicates equal to those drawn value by value, over several tasks; null values are left out, an empty arm gives nulls."""
    r = random.Random(6)
    rows = [(g, r.choice([1.0, 2.0, 2.0, 5.0, r.random()]), r.random() < 0.4) for g in ("a", None) for _ in range(70)] + [("a", None, True), ("one", 3.0, True)]
    n = 2 * resample.REPLICATES + 7
    got = {(x["g"], x["replicate"]): x["cliffs_delta"] for x in resample.bootstrap_deltas(spark.createDataFrame(rows, "g string, v double, arm boolean"), "v", "arm", n, ["g"]).collect()}
    assert {k[1] for k in got} == set(range(n)) and got["one", 3] is None
    for g in ("a", None):
        arms = [np.array(sorted(v for k, v, arm in rows if k == g and v is not None and arm is own)) for own in (False, True)]
        for rep in (0, 249, 250, n - 1):
            b, a = (x[resample.number(np.int64(rep), 2 * np.arange(1, len(x) + 1, dtype=np.int64) + own) % len(x)] for own, x in enumerate(arms))
            assert got[g, rep] == pytest.approx(np.sign(a[:, None] - b).mean(), abs=1e-12)


def test_null_keys_of_maps_and_strata(spark):
    first = spark.createDataFrame([(None, 1, 4), (None, 2, None), (7, 1, 5)], "row_id long, from int, to int")
    second = spark.createDataFrame([(None, 4, 9), (None, None, 3), (7, 5, 8)], "row_id long, from int, to int")
    assert sorted(map(str, mapping.compose(first, second).collect())) == sorted(["Row(row_id=None, from=1, to=9)", "Row(row_id=7, from=1, to=8)"])
    strata = spark.createDataFrame([(None, True), (None, False), ("s", True)], "s string, flag boolean")
    assert ranking.usable_strata(strata, "s", "flag").count() == 2
    cmap = spark.createDataFrame([(None, 0, "A", 1), (None, 2, "C", 2), (1, 0, "G", 1)], "row_id long, col_ix int, symbol string, residue int")
    features = spark.createDataFrame([(None, "f", 1, 3)], "row_id long, feature string, start int, end int")
    projected = mapping.project(features, cmap)
    assert sorted((r["row_id"], r["col_ix"]) for r in projected.collect()) == [(None, 0), (None, 2)]
    assert [(r["residues_in_alignment"], r["column_max"]) for r in mapping.coverage(features, projected, cmap).collect()] == [(2, 2)]
    canonical = spark.createDataFrame([(None, 1, "A"), (None, 2, "T"), (None, 3, "K"), (1, 1, "G")], "row_id long, residue int, letter string")
    assert sorted((r["row_id"], r["residue"], r["letter"]) for r in mapping.map_violations(cmap, canonical).collect()) == [(None, 2, "T"), (None, 3, "K")]
    assert [r["row_id"] for r in mapping.missing(cmap, features, ["row_id"]).collect()] == [1]


def test_counts_of_whole_sequences(spark, monkeypatch):
    """Counts from buffers equal those of cells, over slices, with odd characters and null keys."""
    monkeypatch.setattr(m, "_CELLS", 16)
    rows = [("a", 1, "ABca"), ("a", None, None), (None, 1, "x-\U0001F4A9é z\n"), ("a", 1, ""), (None, 1, "Q" * 50), ("a", 1, "ABzz"), ("b", 2, "]^\\-A")]
    df = spark.createDataFrame(rows, "g string, h int, s string").coalesce(1)
    for alphabet in (None, m.RESIDUES):
        want = m.symbol_counts(m.cells_of(df, "s", ["g", "h"], alphabet), ["g", "h"])
        assert sorted(map(str, m.sequence_counts(df, "s", ["g", "h"], alphabet).collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("held", [1 << 24, 1])
def test_counts_of_pieces_and_first_rows(spark, monkeypatch, held):
    """Rows of several pieces, characters of several bytes at their edges, tables that do not all fit, null keys, ids and equal rows: entries, sums and first rows are those of cells."""
    for name, value in (("TILE", 8), ("_CELLS", 16), ("_HELD", held)):
        monkeypatch.setattr(m, name, value)
    r = random.Random(9)
    rows = [(r.choice([None, *range(-3, 60)]), r.choice(["a", "b", None]), "".join(r.choice("ABz-é\U0001F4A9") for _ in range(r.choice([0, 1, 7, 8, 9, 16, 17, 50]))), float(r.choice([0, 1, 2.5]))) for _ in range(90)]
    df = spark.createDataFrame([*rows, rows[0], (70, "a", None, 1.0)], "row_id long, g string, s string, x double").repartition(3)
    shown = lambda x: sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in row)) for row in x.collect())
    for alphabet in (None, "AC-"):
        cells = m.cells_of(df, "s", ["row_id", "g", "x"], alphabet)
        want = cells.groupBy("g", "col_ix", "symbol").agg(F.sum("x").alias("w"), F.min("row_id").alias("seen"))
        assert shown(m.sequence_counts(df, "s", ["g"], alphabet, "x", "row_id")) == shown(want)
        assert shown(m.consensus_of(m.sequence_counts(df, "s", ["g"], alphabet, seen="row_id"), ["g"])) == shown(m.consensus_symbol(cells, ["g"]))


def test_consensus_makes_no_cells(spark):
    """The most frequent symbols of documents come from tables of counts, without a row for each character; what few rows reach is brought together by place."""
    for q in ("consensus_with_gap", "value_shift_panel"):
        out = registry.QUERIES[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode" not in out
    plan = m.sequence_counts(spark.createDataFrame([("a", "AB")], "g string, s string"), "s", ["g"])._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" in plan and "regexp_replace" not in plan


def test_weights_and_maps_of_whole_sequences(spark, monkeypatch):
    """Weights, weighted counts and maps from pieces and buffers equal those of cells; places are dealt over tasks, null keys are groups."""
    for name, value in (("PIECE", 8), ("EACH", 3), ("_CELLS", 16)):
        monkeypatch.setattr(m, name, value)
    r = random.Random(8)
    rows = [(i, r.choice(["a", None]), "".join(r.choice("ABab-é") for _ in range(r.choice([0, 1, 8, 9, 30])))) for i in range(60)] + [(60, "lone", "AB"), (61, "a", None), (62, "gaps", "--")]
    df = spark.createDataFrame(rows, "row_id long, g string, s string").repartition(3)
    cells = m.cells_of(df, "s", ["row_id", "g"], None)
    shown = lambda x: sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in row)) for row in x.collect())
    for by in (["g"], []):
        weights = m.sequence_weights(df, "s", m.sequence_counts(df, "s", by), by)
        assert shown(weights) == shown(m.henikoff_weights(cells, by))
    weights = spark.createDataFrame([(i, float(i % 7)) for i in range(63)], "row_id long, weight double")
    assert shown(m.sequence_counts(df.join(weights, "row_id"), "s", ["g"], weight="weight")) == shown(m.symbol_counts(cells.join(weights, "row_id"), ["g"], "weight"))
    assert shown(m.sequence_map(df, "s", ["row_id"])) == shown(mapping.coordinate_map(cells))
