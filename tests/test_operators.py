"""Hand fixtures and laws of the statistics that tie, gap and null cases decide."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gridstat.functions import tails
from gridstat.functions.ordered import average_rank, row_numbers
from gridstat.operators import association, coupling, mapping, ranking, resample, spatial
from gridstat.operators import matrix as m
from gridstat.sources import fasta, tables


def grid(spark, rows):
    data = [(i, g, j, s) for i, (g, text) in enumerate(rows) for j, s in enumerate(text)]
    return spark.createDataFrame(data, "row_id long, grp string, col_ix int, symbol string")


def test_invariant_matrix_has_unit_weights(spark):
    w = m.henikoff_weights(grid(spark, [("a", "AAA")] * 4)).collect()
    assert [r.weight for r in w] == [1.0] * 4


def test_henikoff_weights_sum_to_rows(spark):
    w = m.henikoff_weights(grid(spark, [("a", "ACD"), ("a", "ACE"), ("a", "GCD"), ("b", "A-D")]))
    assert w.agg(F.sum("weight")).first()[0] == pytest.approx(4)
    k = m.kish(w).first()
    assert 1 <= k.kish_neff <= k.n


def test_gap_column(spark):
    c = m.symbol_counts(grid(spark, [("a", "A-"), ("a", "C-")]))
    r = {x.col_ix: x for x in m.column_constraint(c, m.residue_background(spark)).collect()}
    assert (r[1].entropy_bits, r[1].conservation_norm, r[1].jsd, r[1].gap_fraction) == (0.0, 1.0, 0.0, 1.0)
    assert 0 <= r[0].jsd <= 1 and r[0].entropy_bits == pytest.approx(1.0)
    assert {x.col_ix: x.consensus for x in m.consensus_residue(c).collect()} == {0: "A", 1: "A"}


def test_jsd_equals_dense_form(spark):
    rows = [("a", "".join(random.Random(i).choice(m.RESIDUES + "-") for _ in range(6))) for i in range(40)]
    got = {r.col_ix: r.jsd for r in m.column_constraint(m.symbol_counts(grid(spark, rows)), m.residue_background(spark)).collect()}
    total = sum(m.BACKGROUND)
    for j in range(6):
        col = [t[j] for _, t in rows]
        res = [c for c in col if c != "-"]
        jsd = 0.0
        for s, b in zip(m.RESIDUES, m.BACKGROUND, strict=True):
            p, q = res.count(s) / len(res), b / total
            mid = (p + q) / 2
            jsd += 0.5 * ((p * math.log2(p / mid) if p else 0) + q * math.log2(q / mid))
        assert got[j] == pytest.approx(jsd * len(res) / len(col))


def test_mutual_information_of_separated_groups(spark):
    rows = [("a", "AC")] * 40 + [("b", "DC")] * 40
    mi = {r.col_ix: r.mi_bits for r in m.mutual_information(m.symbol_counts(grid(spark, rows), ["grp"]), ["col_ix"]).collect()}
    assert mi[0] == pytest.approx(1 + (1 + 1 - 3 + 2 - 0) * 0 + (2 + 2 - 2 - 1) / (2 * 80 * math.log(2)))
    assert mi[1] == pytest.approx(0)


def test_consensus_with_gaps_takes_the_first_seen(spark):
    r = m.consensus_symbol(grid(spark, [("a", "G"), ("a", "A"), ("a", "A"), ("a", "G")])).first()
    assert (r.consensus, r.consensus_share) == ("G", 0.5)


def test_ragged_matrix_is_refused(spark):
    rows = spark.createDataFrame([("AA",), ("AAA",)], "s string")
    with pytest.raises(Exception, match="ragged"):
        m.assert_rectangular(rows, "s").collect()


@pytest.mark.parametrize("n,sizes", [(5, [2, 1, 2]), (7, [2, 2, 3]), (8, [3, 2, 3])])
def test_tertile_sizes(spark, n, sizes):
    d = spark.createDataFrame([(i, 1.0) for i in range(n)], "k long, v double")
    got = dict(ranking.quantile_bins(d, "v", "k").groupBy("bin").count().collect())
    assert [got[i] for i in range(3)] == sizes


def test_ranks_with_ties_and_nulls(spark):
    d = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 1.0), (4, 5.0)], "k long, v double")
    assert {r.k: r.avg_rank for r in average_rank(d, "v").collect()} == {3: 1.0, 1: 2.5, 2: 2.5, 4: 4.0}
    s = spark.createDataFrame([(x,) for x in ["src10", "src2", "a", "src1", "é"]], "s string")
    assert [r.s for r in row_numbers(s, "s", []).orderBy("rn").collect()] == sorted(["src10", "src2", "a", "src1", "é"], key=str.encode)


def test_benjamini_hochberg(spark):
    ps = [0.01, 0.04, 0.03, 0.005, 0.5, None, 0.03]
    d = spark.createDataFrame(list(enumerate(ps)), "k int, p double")
    got = {r.k: r.q_bh for r in ranking.benjamini_hochberg(d, "p").collect()}
    known = sorted((p, i) for i, p in enumerate(ps) if p is not None)
    best, want = 1.0, {5: None}
    for rank in range(len(known), 0, -1):
        best = min(best, known[rank - 1][0] * len(known) / rank)
        want[known[rank - 1][1]] = best
    assert {k: pytest.approx(v) if v is not None else None for k, v in want.items()} == got


def test_single_hit_has_no_margin_and_passes(spark):
    h = spark.createDataFrame([("q", "r1", 9.0), ("q", "r1", 8.0), ("p", "r1", 3.0), ("p", "r2", 3.0)], "query string, ref string, score double")
    r = {x["query"]: x for x in ranking.best_and_runner_up(h, "query", "ref", "score").collect()}
    assert r["q"].margin is None and r["q"].runner_up_ref is None and (r["p"].best_ref, r["p"].margin) == ("r1", 1.0)
    reason = ranking.acceptance(F.lit("r1"), F.lit(0.9), F.lit(0.9), F.lit(None).cast("double"), ["r1"])
    assert spark.range(1).select(reason.alias("x")).first().x == "ok"


def test_second_filter_in_both_modes(spark):
    rows = [(1, 0.9, 0.9, None), (2, 0.9, 0.9, 1.2), (3, 0.54996, 0.9, 1.2), (4, 0.9, 0.9, 1.0996), (5, 0.1, 0.9, 1.2)]
    d = spark.createDataFrame(rows, "k int, coverage double, identity double, margin double")
    assert {r.k for r in ranking.refiltered(d).collect()} == {1, 2}
    assert {r.k for r in ranking.refiltered(d, "reference").collect()} == {2, 3, 4}
    with pytest.raises(ValueError):
        ranking.refiltered(d, "other")


def test_rounded_scores(spark):
    c = m.symbol_counts(grid(spark, [("a", "ACD"), ("a", "AGE"), ("a", "AC-")]))
    plain, four = ({r.col_ix: r.jsd for r in m.column_constraint(c, m.residue_background(spark), decimals=d).collect()} for d in (None, 4))
    assert four == {k: round(v, 4) for k, v in plain.items()} != plain


def test_cliffs_delta_is_antisymmetric(spark):
    d = spark.createDataFrame([(float(v % 5), v % 3 == 0) for v in range(40)], "v double, arm boolean")
    a = association.cliffs_delta(d, "v", "arm").first().cliffs_delta
    b = association.cliffs_delta(d.withColumn("arm", ~F.col("arm")), "v", "arm").first().cliffs_delta
    assert a == pytest.approx(-b)
    x, y = [v % 5 for v in range(40) if v % 3 == 0], [v % 5 for v in range(40) if v % 3]
    assert a == pytest.approx(sum((i > j) - (i < j) for i in x for j in y) / len(x) / len(y))


def test_tails():
    assert tails.normal_two_sided(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert tails.chi2_sf(tails.chi2_quantile(0.9, 7), 7) == pytest.approx(0.1)
    assert tails.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.hypergeom_sf(10, 235, 30, 30) == pytest.approx(0.00136, abs=5e-6)


def test_meta_analysis_of_published_effects(spark):
    """Pooled from four effects whose standard errors are given; checked by hand."""
    rows = [("a", 0.1, -0.1, 0.3), ("a", 0.2, 0.0, 0.4), ("b", 0.0, -0.4, 0.4)]
    r = {x.model: x for x in association.fixed_effect(spark.createDataFrame(rows, "s string, e double, lo double, hi double"), "e", "lo", "hi", "s").collect()}
    w = [(2 * 1.959964 / (h - lo)) ** 2 for _, _, lo, h in rows]
    pooled = sum(a * b[1] for a, b in zip(w, rows, strict=True)) / sum(w)
    assert r["all"].pooled == pytest.approx(pooled) and r["only_b"].pooled == pytest.approx(0.0) and r["only_a"].cochran_q is None
    assert r["all"].cochran_q == pytest.approx(sum(a * (b[1] - pooled) ** 2 for a, b in zip(w, rows, strict=True)))


def test_permutations_keep_labels(spark):
    d = spark.createDataFrame([(i, "xyz"[i % 3], i % 2) for i in range(30)], "id long, label string, s int")
    p = resample.permuted(d, "id", "label", 3)
    assert p.count() == 90 and {tuple(r) for r in p.groupBy("replicate", "label").count().collect()} == {(k, c, 10) for k in range(3) for c in "xyz"}
    within = resample.permuted(d, "id", "label", 2, ["s"]).join(d.select("id", F.col("s").alias("t")), "id")
    assert within.filter("s != t").isEmpty() and within.count() == 60


def test_bootstrap_draws_as_many_rows(spark):
    d = spark.createDataFrame([(i, "a" if i < 7 else "b") for i in range(12)], "id long, g string")
    assert {tuple(r) for r in resample.bootstrap(d, "id", 4, ["g"]).groupBy("g", "replicate").count().collect()} == {(g, k, n) for g, n in (("a", 7), ("b", 5)) for k in range(4)}


@pytest.mark.parametrize("method", ["segments", "tiles", "auto"])
@pytest.mark.parametrize("theta", [0.5, 0.8, 1.0])
def test_identity_weights_equal_all_pairs(spark, theta, method):
    rnd = random.Random(5)
    rows = ["".join(rnd.choice("AB") for _ in range(10)) for _ in range(60)]
    rows += rows[:5]
    d = spark.createDataFrame(list(enumerate(rows)), "row_id long, symbols string")
    got = {r.row_id: r.neighbours for r in coupling.identity_weights(d, 10, theta, method=method).collect()}
    assert got == {i: sum(sum(x == y for x, y in zip(a, b, strict=True)) / 10 >= theta for b in rows) for i, a in enumerate(rows)}


def test_coordinate_map_round_trip(spark):
    c = mapping.coordinate_map(grid(spark, [("a", "A-CD"), ("a", "--GG")]))
    letters = c.select("row_id", "residue", F.col("symbol").alias("letter"))
    assert mapping.map_violations(c, letters).isEmpty()
    assert not mapping.map_violations(c, letters.filter("residue > 1")).isEmpty()
    assert [r.col_ix for r in c.filter("row_id = 0").orderBy("residue").collect()] == [0, 2, 3]


def test_distance_join_equals_all_pairs(spark):
    rnd = random.Random(3)
    pts = [(i, rnd.random() * 4 - 2, rnd.random(), rnd.random()) for i in range(80)]
    a, b = spark.createDataFrame(pts[:40], "i long, x double, y double, z double"), spark.createDataFrame(pts[40:], "j long, x double, y double, z double")
    got = {(r.i, r.j) for r in spatial.distance_join(a, b, 0.4, ["i"], ["j"]).collect()}
    assert got == {(p[0], q[0]) for p in pts[:40] for q in pts[40:] if math.dist(p[1:], q[1:]) <= 0.4}


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">A|1\nACD\nEF\n>REF|X|P1\n\nGG-\n>A|1\nKK\n")
    r = {x.header: x for x in fasta.header_fields(fasta.read_fasta(spark, str(tmp_path / "a.fasta"))).collect()}
    assert r["A|1"].seq == "KK" and r["REF|X|P1"].seq == "GG-" and (r["REF|X|P1"].kind, r["REF|X|P1"].accession) == ("REF", "P1")
    assert [x.seq for x in fasta.parse_fasta(spark.createDataFrame([(">h\nAA\nB \n>k\nC",)], "t string"), "t").orderBy("ord").collect()] == ["AAB", "C"]


def test_nested_maps_and_percent_hits(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"fam": {"columns": 3,\n "references": {"R": {"canonical_to_column": {"1": 0, "2": 2}, "column_to_canonical": {"0": 1, "2": 2}}}}}')
    assert {tuple(r) for r in tables.coordinate_maps(spark, str(tmp_path / "m.json")).collect()} == {("fam", "R", 1, 0), ("fam", "R", 2, 2)}
    (tmp_path / "h.tsv").write_text("q\tt|1\t85.0\t10\t20\t20\t0.5\t0.5\t33.0\t1e-9\nr\tt|1\t1.2\t10\t20\t20\t0.5\t0.5\t30.0\t1e-9\n")
    assert [r.pident for r in tables.read_hits(spark, str(tmp_path / "h.tsv")).orderBy("query").collect()] == [0.85, 0.012]


def test_empty_inputs(spark):
    empty = grid(spark, [("a", "A")]).filter("false")
    assert m.henikoff_weights(empty).isEmpty() and m.column_constraint(m.symbol_counts(empty), m.residue_background(spark)).isEmpty()
    assert ranking.benjamini_hochberg(spark.createDataFrame([], "k int, p double"), "p").isEmpty()
