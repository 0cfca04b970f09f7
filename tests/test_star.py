"""Alignment around an anchor: what must hold of any, and small ones by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstat.functions.alignment import align_many
from gridstat.functions.ordered import by_keys
from gridstat.operators import mapping, star

RNG = np.random.default_rng(5)


def made(spark, rows, anchors):
    return (
        spark.createDataFrame(rows, "grp string, row_id long, seq string").repartition(3),
        spark.createDataFrame(anchors, "grp string, anchor string"),
    )


def test_by_hand(spark):
    rows, anchors = made(spark, [("x", 1, "ACDEFG"), ("x", 2, "ACDWWEFG"), ("x", 3, "ACDWEFGKK"), ("x", 4, "DEFG"), ("x", 5, None), (None, 6, "MMACD"), (None, 7, "ACD"), ("y", 8, "A")], [("x", "ACDEFG"), (None, "ACD"), ("z", "A")])
    scores = {(a, b): 20.0 if a == b else -4.0 for a in "ACDEFGWKM" for b in "ACDEFGWKM"}
    got = {(r.grp, r.row_id): r.symbols for r in star.star_alignment(rows, anchors, ["grp"], scores).collect()}
    assert got == {
        ("x", 1): "ACD--EFG--", ("x", 2): "ACDWWEFG--", ("x", 3): "ACDW-EFGKK", ("x", 4): "--D--EFG--", ("x", 5): "----------",
        (None, 6): "MMACD", (None, 7): "--ACD",
    }


def test_random(spark):
    """Rows are whole, groups rectangular, anchors in place, and every row faces the anchor as its own best alignment does."""
    anchors = {g: "".join(RNG.choice(list("ACDEFG"), 40)) for g in ("a", "b")}
    rows = []
    for n in range(60):
        g = "ab"[n % 2]
        s = list(anchors[g])
        for _ in range(n % 5 if n > 1 else 0):
            p = int(RNG.integers(len(s)))
            s[p : p + int(RNG.integers(3))] = RNG.choice(list("ACDEFG"), int(RNG.integers(4)))
        rows.append((g, n, "".join(s)))
    out = {r.row_id: r for r in star.star_alignment(*made(spark, rows, list(anchors.items())), ["grp"]).collect()}
    assert len(out) == len(rows)
    for g, n, seq in rows:
        mine, first = out[n].symbols, out["ab".index(g)].symbols
        assert mine.replace("-", "") == seq and len(mine) == len(first)
        assert first.replace("-", "") == anchors[g]
        _, _, i, j = align_many([seq], [anchors[g]])
        own, at = np.cumsum([c != "-" for c in mine]) - 1, np.cumsum([c != "-" for c in first]) - 1
        assert [(own[c], at[c]) for c in range(len(mine)) if mine[c] != "-" and first[c] != "-"] == list(zip(i, j, strict=True))


def test_edges(spark):
    rows, anchors = made(spark, [("x", 1, "WWWW"), ("x", 2, "")], [("x", "ACD")])
    got = {r.row_id: r.symbols for r in star.star_alignment(rows, anchors, ["grp"]).collect()}
    assert got == {1: "---WWWW", 2: "-------"}
    assert star.star_alignment(rows.limit(0), anchors, ["grp"]).count() == 0
    with pytest.raises(Exception, match="several anchors"):
        star.star_alignment(rows, anchors.union(anchors), ["grp"]).collect()


def test_columns_and_violations(spark):
    aligned = spark.createDataFrame([("x", 1, "AC--DE")], "grp string, row_id long, symbols string")
    positions = spark.createDataFrame([("x", 1, r, p) for p, r in enumerate((11, 12, 15, 16), 1)], "grp string, row_id long, from int, to int")
    keys = ["grp", "row_id"]
    mapped = star.canonical_columns(positions, aligned, keys)
    assert sorted((r["from"], r["to"]) for r in mapped.collect()) == [(11, 0), (12, 1), (15, 4), (16, 5)]
    letters = spark.createDataFrame([("x", 1, r, c) for r, c in ((11, "A"), (12, "C"), (15, "W"), (17, "E"))], "grp string, row_id long, residue int, letter string")
    wrong = star.column_violations(mapped, aligned, letters, keys)
    assert sorted(r.residue for r in wrong.collect()) == [15, 16, 17]
    assert star.column_violations(mapped, aligned, letters.filter(F.col("residue") < 15), keys).count() == 2


def test_columns_make_no_cells(spark):
    """Maps of a row are composed and compared in it: no row is made for a cell, and the entries are those of tables of cells, nulls included."""
    keys = ["grp", "row_id"]
    aligned = spark.createDataFrame([("x", 1, "A-C-"), (None, 2, "--"), ("y", None, None), ("z", 4, "")], "grp string, row_id long, symbols string")
    positions = spark.createDataFrame([("x", 1, 5, 2), ("x", 1, 6, 1), ("x", 1, 6, 2), ("x", 1, None, 1), ("x", 1, 8, 3), (None, 2, 1, 1), ("q", 9, 1, 1)], "grp string, row_id long, from int, to int")
    mapped = star.canonical_columns(positions, aligned, keys)
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(mapped.collect()) == order([("x", 1, 5, 2), ("x", 1, 6, 0), ("x", 1, 6, 2), ("x", 1, None, 0)])
    columns = spark.createDataFrame([*map(tuple, mapped.collect()), ("x", 1, 9, 7), (None, 2, 1, 1), ("y", None, 2, 0), ("w", 0, 3, None)], "grp string, row_id long, from int, to int")
    letters = spark.createDataFrame([("x", 1, 5, "C"), ("x", 1, 6, "A"), ("x", 1, 6, "C"), ("x", 1, None, "A"), (None, 2, 1, "-"), ("y", None, 2, None), ("v", 1, 1, None), ("v", 1, 2, "D")], "grp string, row_id long, residue int, letter string")
    cells = aligned.select(*keys, F.posexplode(F.split("symbols", "")).alias("to", "symbol")).filter("symbol != ''")
    held = by_keys(columns, cells, [*keys, "to"], "left").select(*keys, F.col("from").alias("residue"), F.coalesce("symbol", F.lit("-")).alias("symbol"))
    want = mapping.map_violations(held, letters, keys)
    got = star.column_violations(columns, aligned, letters, keys)
    assert got.columns == want.columns and order(got.collect()) == order(want.collect()) and want.count() == 6
    assert star.column_violations(columns.limit(0), aligned, letters.limit(0), keys).isEmpty()
    for df in (mapped, got):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "posexplode" not in plan and "Window" not in plan
