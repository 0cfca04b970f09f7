"""Tables that grow with the cells are never broadcast, however small Spark guesses them to be."""

from pyspark.sql import functions as F

from gridstat.operators import checks, mapping, resample, spatial, star
from gridstat.plans import composites
from gridstat.plans import mapping as plans
from gridstat.sources.scratch import stash


def plan(df):
    """The plan as Spark lays it out before it knows any size."""
    return df._jdf.queryExecution().sparkPlan().toString()


def grid(spark, rows=400, columns=30):
    """Cells (grp, row_id, col_ix, symbol) without gaps: a file of a few kilobytes."""
    c = spark.range(rows).select((F.col("id") % 3).cast("string").alias("grp"), F.col("id").alias("row_id"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("col_ix"))
    return stash(c.withColumn("symbol", F.lit("A")), "cells")


def test_round_trips_are_sorted(spark):
    cmap = stash(mapping.coordinate_map(grid(spark), ["grp", "row_id"]), "residues")
    out = checks.round_trips(cmap, cmap, cmap.withColumnRenamed("symbol", "letter"), ["grp", "row_id"])
    assert "Broadcast" not in plan(out) and out.filter("back = residue and symbol = letter").count() == 12_000


def test_window_leaves_cells_in_place(spark):
    cmap = stash(mapping.coordinate_map(grid(spark), ["grp", "row_id"]), "residues")
    pieces = mapping.window_extract(cmap, cmap.join(F.broadcast(spark.range(3).withColumnRenamed("id", "row_id")), "row_id"), F.lit(True), 5, 20, ["grp"])
    # the window's columns may be broadcast: they are the right side
    assert "BuildLeft" not in plan(pieces) and "Aggregate" not in plan(pieces).split("Join", 1)[1]
    assert pieces.count() == 400 and pieces.first().piece == "A" * 16


def test_maps_are_sorted(spark):
    cells = grid(spark)
    rows = stash(cells.groupBy("grp", "row_id").agg(F.array_join(F.collect_list("symbol"), "").alias("symbols")), "rows")
    positions = cells.select("grp", "row_id", (F.col("col_ix") + 100).alias("from"), (F.col("col_ix") + 1).alias("to"))
    mapped = star.canonical_columns(positions, rows, ["grp", "row_id"])
    assert "Broadcast" not in plan(mapped) and mapped.filter("from = to + 100").count() == 12_000
    wrong = star.column_violations(stash(mapped, "mapped"), rows, positions.select("grp", "row_id", F.col("from").alias("residue"), F.lit("A").alias("letter")), ["grp", "row_id"])
    assert "Broadcast" not in plan(wrong) and wrong.count() == 0


def test_composition_stays_in_place(spark):
    """Packed maps give what tables of them give: repeated sources, nulls, empty maps and equal rows included; the query shuffles no map."""
    kind = "struct<from: array<int>, to: array<int>>"
    rows = [("x", ([1, 2, 3, 4], [7, None, 9, 7]), ([7, 7, None, 9], [70, 71, 1, None])), (None, ([1], [-5]), ([-5], [2**31 - 1])), ("x", ([8], [7]), ([], [])), ("e", ([], []), ([1], [1])), ("n", None, ([1], [1])), ("n", ([1], [1]), None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"row_id int, k string, first {kind}, second {kind}").repartition(2)
    table = lambda c: df.select("row_id", "k", F.inline(F.arrays_zip(f"{c}.from", f"{c}.to")))
    keys = ["row_id", "k"]
    key = lambda r: [(v is not None, v or 0) if not isinstance(v, str) else (True, v) for v in r]
    got = sorted(map(tuple, mapping.compose_packed(df, "first", "second", keys).collect()), key=key)
    assert got == sorted(map(tuple, mapping.compose(table("first"), table("second"), keys).collect()), key=key) and len(got) == 6
    out = plans.map_composition(spark, "/root/testdata/sf0.001")
    assert "hashpartitioning" not in plan(out) and "Join" not in plan(out)


def test_null_groups_make_no_cells(spark):
    """Documents are counted and weighed as they are, without a row for each character."""
    for q in (composites.null_group_scores, composites.null_group_weights):
        assert "posexplode" not in plan(q(spark, "/root/testdata/sf0.001"))


def test_contacts_are_summed_where_they_are_found(spark):
    """Unique points' contacts are not brought together again; points that share keys give their least distance."""
    p = spark.range(300).select((F.col("id") % 2).alias("l"), F.col("id").alias("i"), *(F.rand(s).alias(c) for s, c in enumerate("xyz")))
    p = stash(p, "points")
    a, b = p.withColumnsRenamed({"l": "la", "i": "a"}), p.withColumnsRenamed({"l": "lb", "i": "b"})
    near = spatial.distance_join(a, b, 0.2, ["la", "a"], ["lb", "b"])
    assert "Aggregate" not in plan(near) and "Broadcast" not in plan(near)
    twice = spatial.distance_join(a.unionByName(a.withColumn("x", F.col("x") + 0.01)), b, 0.2, ["la", "a"], ["lb", "b"])
    assert twice.groupBy("la", "a", "lb", "b").count().filter("count > 1").isEmpty() and twice.count() >= near.count()
    names = ["min_distance", "mean_distance", "max_distance"]
    rows = lambda df: sorted(df.select("la", "a", "n_partners", *(F.round(c, 9) for c in names)).collect())
    want = spatial.interface(spatial.retained_copies(near, ["la", "lb"], 3, 0.9), ["la", "a"], ["lb", "b"])
    got = spatial.retained_interface(near, ["la", "a"], ["lb", "b"], ["la", "lb"], 3, 0.9)
    assert rows(got) == rows(want) and len(rows(got)) > 100


def test_window_numbers_no_cells(spark):
    """Residues are numbered in their rows: no window over the cells of all documents."""
    assert "Window" not in plan(plans.window_extraction(spark, "/root/testdata/sf0.001"))


def test_rows_of_strata_stay_in_place(spark):
    """The few strata may be broadcast, never their rows."""
    kind = F.when(F.col("id") % 3 > 0, (F.col("id") % 3).cast("string"))
    rows = stash(spark.range(3000).select(F.concat_ws("|", kind, F.lit("0")).alias("stratum"), kind.alias("kind"), "id", (F.col("id") * 1.0).alias("v"), (F.col("id") % 2 == 0).alias("flag")), "rows")
    out = resample.stratified_sums(rows, "stratum", "id", "v", "flag", 8, 100, ["kind"])
    assert "BuildRight" in plan(out) and "BuildLeft" not in plan(out)
    assert sorted((str(r.kind), r["count"]) for r in out.groupBy("kind").count().collect()) == [("1", 8), ("2", 8), ("None", 8)]
