"""Each check on a table that it passes and on one that it stops."""

import os

import pytest

from gridstat.operators import checks as ck
from gridstat.sources.scratch import shared_dir

COLUMNS = "grp string, anchored boolean, features array<string>"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(2)


def trips(spark, forward, backward, canonical):
    return ck.round_trips(frame(spark, forward, "k string, residue int, col_ix int, symbol string"), frame(spark, backward, "k string, col_ix int, residue int"), frame(spark, canonical, "k string, residue int, letter string"), ["k"])


MAP = [("x", 1, 0, "A"), ("x", 2, 3, "C"), (None, 1, 5, "D")]
BACK = [(k, c, r) for k, r, c, _ in MAP]
CANON = [(k, r, s) for k, r, _, s in MAP]


def cases(spark):
    want = frame(spark, [("a",), (None,), ("a",)], "k string")
    for what in ("a forced reference", "the anchor", "a feature", "a scope", "a canonical sequence", "a sequence of the panel"):
        yield ck.presence(want, frame(spark, [("a",), (None,)], "k string"), ["k"]), ck.presence(want, frame(spark, [("a",)], "k string"), ["k"]), ck.all_present(what), f"{what} is missing: 1 of 2"
    for what in ("matrix", "external"):
        g = f"{what} string, symbols string"
        yield ck.extents(frame(spark, [("x", "AC"), ("x", "A-"), (None, "A")], g), [what]), ck.extents(frame(spark, [("x", "AC"), ("x", None), (None, "A")], g), [what]), ck.RECTANGULAR, "differ in length: 1 of 2"
    w = "g string, weight double"
    good = ck.weight_sums(frame(spark, [("x", 0.0), ("x", 2.0)], w), ["g"])
    yield good, ck.weight_sums(frame(spark, [("x", float("nan")), ("x", 2.0)], w), ["g"]), ck.WEIGHED, "not finite: 1 of 1"
    yield good, ck.weight_sums(frame(spark, [("x", 0.0), ("y", 1.0)], w), ["g"]), ck.WEIGHED, "sum to nothing: 1 of 2"
    yield good, good.limit(0), ck.WEIGHED, "sum to nothing: 0 of 0"
    fine = trips(spark, MAP, BACK, CANON)
    yield fine, trips(spark, MAP[:2], BACK, CANON), ck.ROUND_TRIP, "not mapped once: 1 of 3"
    yield fine, trips(spark, [*MAP, ("x", 9, 7, "E")], [*BACK, ("x", 7, 9)], CANON), ck.ROUND_TRIP, "not mapped once: 1 of 4"
    yield fine, trips(spark, MAP, BACK, [*CANON[:2], (None, 1, "E")]), ck.ROUND_TRIP, "another letter: 1 of 3"
    yield fine, trips(spark, MAP, [*BACK[:2], (None, 5, 2)], CANON), ck.ROUND_TRIP, "another residue: 1 of 3"
    p = "piece string, positions array<int>"
    yield frame(spark, [("AC", [4, 5]), ("", [])], p), frame(spark, [("AC", [4, 5]), ("A", [])], p), ck.PIECES, "differ in length: 1 of 2"
    count = lambda rows: ck.provenance_counts(frame(spark, rows, COLUMNS), ["grp"], ["S"], ["J"])
    most = [("s", True, ["S"])] * 9
    yield count([*most, ("s", True, None), ("s", False, [])]), count([*most[:4], ("s", True, ["T"])]), ck.PROVENANCE, "outside the required features: 1 of 1"
    yield count(most), count([*most, ("s", False, ["J"])]), ck.PROVENANCE, "another family: 1 of 1"
    a = "n_observed int, n_mapped int, n_equal int"
    yield frame(spark, [(100, 91, 90), (0, 0, 0)], a), frame(spark, [(100, 90, 90)], a), ck.ALIGNED, "few residues are mapped: 1 of 1"
    yield frame(spark, [(100, 100, 96)], a), frame(spark, [(100, 100, 95)], a), ck.ALIGNED, "residues are equal: 1 of 1"
    d = "declared string, observed string"
    yield frame(spark, [("A", "A"), ("C", None)], d), frame(spark, [("A", "A"), ("C", "-")], d), ck.DECLARED, "than declared: 1 of 2"


def test_each(spark):
    for good, bad, checks, message in cases(spark):
        assert ck.checked(good, checks).count() == good.count()
        with pytest.raises(ValueError, match=message):
            ck.checked(bad, checks)


def test_share_and_nulls(spark):
    df = spark.range(10)
    low = ck.Check("low", "id < 8", share=0.25)
    assert ck.audit(df, [low])[1] == {"low": (10, 2)} and ck.checked(df, [low]).count() == 10
    with pytest.raises(ValueError, match="low: 2 of 10"):
        ck.checked(df, [ck.Check("low", "id < 8", share=0.2)])
    nulls = spark.createDataFrame([(None,), (1,)], "v int")
    assert ck.audit(nulls, [ck.Check("one", "v = 1")])[1] == {"one": (2, 1)}
    assert ck.checked(nulls.limit(0), [ck.Check("one", "v = 1")]).count() == 0


def test_no_table_is_left(spark):
    here = os.path.join(shared_dir(spark).removeprefix("file://"), "gridstat")
    with pytest.raises(ValueError, match="none"):
        ck.checked(spark.range(3), [ck.Check("none", "id < 0")], "refused")
    assert not [p for p, _, _ in os.walk(here) if p.endswith("refused")]
