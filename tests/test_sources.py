"""Streams, chain kernels and the less usual sources."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridstat.operators import matrix as m
from gridstat.operators import structure
from gridstat.sources import tables
from gridstat.streaming import counts


def test_stream_counts_equal_batch(spark, tmp_path):
    rows = [(i, "ab"[i % 2], "AC-GT"[i % 5] * 3) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, grp string, seq string")
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = counts.stream_symbol_counts(stream, "seq", ["grp"], 3).writeStream.outputMode("complete").format("memory").queryName("symbols").start()
    try:
        q.processAllAvailable()
        got = {tuple(r) for r in spark.table("symbols").select("grp", "col_ix", "symbol", "w").collect()}
    finally:
        q.stop()
    batch = m.symbol_counts(m.cells_of(df, "seq", ["grp"], None, 0, 3), ["grp"]).select("grp", "col_ix", "symbol", "w")
    assert got == {tuple(r) for r in batch.collect()}
    twice = counts.merge_counts(batch, batch, ["grp"])
    assert {tuple(r) for r in twice.select("grp", "col_ix", "symbol", F.col("w") / 2).collect()} == got


def test_windows_over_events(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    e.repartition(1).write.parquet(str(tmp_path / "e"))
    s = counts.windowed_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), "ts", ["event_type"], "400 days", "1 day")
    q = s.writeStream.outputMode("update").format("memory").queryName("days").start()
    try:
        q.processAllAvailable()
        assert spark.table("days").agg(F.sum("n")).first()[0] == e.count()
    finally:
        q.stop()


@pytest.mark.parametrize("a,b,want", [("ACDE", "ACDE", [0, 1, 2, 3]), ("CDE", "AACDEFF", [2, 3, 4]), ("AACDE", "CDE", [0, 1, 2]), ("", "A", [])])
def test_alignment_with_free_ends(a, b, want):
    assert [j for _, j in structure.align(a, b)] == want


def test_alignment_over_a_gap():
    canonical = "MKTAYIAKQRQISFVKSHFSRQLEERLGLIEVQ"
    observed = canonical[2:12] + canonical[20:]
    pairs = structure.align(observed, canonical)
    assert [canonical[j] for _, j in pairs] == [observed[i] for i, _ in pairs] and len(pairs) == len(observed)
    pairs = structure.align(canonical, observed)
    assert all(canonical[i] == observed[j] for i, j in pairs) and len(pairs) == len(observed)


def test_canonical_numbers(spark):
    d = spark.createDataFrame([("A", [11, 12, 13], "CDE", "AACDEFF")], "chain string, numbers array<int>, observed string, canonical string")
    assert [tuple(r) for r in structure.map_to_canonical(d).collect()] == [("A", 11, 3), ("A", 12, 4), ("A", 13, 5)]
    bad = d.withColumn("observed", F.lit("CXW"))
    with pytest.raises(Exception, match="mapped"):
        structure.map_to_canonical(bad).collect()


def test_exposed_area(spark):
    atoms = [("A", 1, 0.0, 0.0, 0.0, 1.6), ("A", 2, 100.0, 0.0, 0.0, 1.6), ("B", 1, 0.0, 0.0, 0.0, 1.6), ("B", 2, 1.0, 0.0, 0.0, 1.6)]
    r = {(x.chain, x.residue): x.sasa for x in structure.exposed_area(spark.createDataFrame(atoms, "chain string, residue int, x double, y double, z double, radius double")).collect()}
    assert r["A", 1] == r["A", 2] == pytest.approx(4 * np.pi * 9) and 0.5 < r["B", 1] / r["A", 1] < 0.8


def test_ragged_pages(spark, tmp_path):
    (tmp_path / "p1.tsv").write_text("Entry\tGene\tLength\nP1\tg\t12\nP2\n\n")
    (tmp_path / "p2.tsv").write_text("Entry\tGene\tLength\nP3\t\tx\n")
    raw = tables.read_ragged(spark, str(tmp_path), ["Entry", "Gene", "Length"]).withColumnRenamed("Length", "length").withColumn("reviewed", F.lit("Reviewed (x)"))
    assert {(r.Entry, r.Gene, r.length, r.reviewed) for r in tables.entries(raw).collect()} == {("P1", "g", 12, 1), ("P2", "", 0, 1), ("P3", "", 0, 1)}


def test_atoms_of_the_first_model(spark, tmp_path):
    names = ["group_PDB", "id", "type_symbol", "label_atom_id", "label_comp_id", "auth_asym_id", "auth_seq_id", "Cartn_x", "Cartn_y", "Cartn_z", "pdbx_PDB_model_num"]
    rows = ["ATOM 1 C CA ALA A 5 1.0 2.0 3.0 1", "ATOM 2 C CA ALA A 5 9.0 9.0 9.0 2", "HETATM 3 O O HOH B 7 0.5 0 0 1"]
    (tmp_path / "x.cif").write_text("data_X\nloop_\n" + "\n".join(f"_atom_site.{n}" for n in names) + "\n" + "\n".join(rows) + "\n#\n")
    got = {(r.chain, r.residue, r.code, r.x) for r in tables.read_atoms(spark, str(tmp_path)).collect()}
    assert got == {("A", 5, "ALA", 1.0), ("B", 7, "HOH", 0.5)}


def test_nested_features_fan_out_and_lookup(spark):
    e = spark.createDataFrame([("P1", [("SH2 domain", 3, 9), ("Kinase", 10, 20), ("Other", 1, 2)])], "accession string, features array<struct<description:string,start:int,end:int>>")
    assert {(r.feature, r.start, r.end) for r in tables.feature_ranges(e, {"Kinase": "JH1"}).collect()} == {("SH2", 3, 9), ("JH1", 10, 20)}
    q = tables.fan_out(spark, ["t1", "t2", "t3", "t4"], {"symbol": list("abcde"), "signature": ["x", "y"]})
    assert q.count() == 28
    have, lack = tables.lookup(spark.createDataFrame([("a",), ("a",), ("z",)], "k string"), spark.createDataFrame([("a", 1)], "k string, v int"), "k")
    assert have.count() == 1 and [r.k for r in lack.collect()] == ["z"]


def test_retries():
    seen = []

    class Gone(Exception):
        code = 404

    def flaky():
        seen.append(1)
        if len(seen) < 3:
            raise OSError
        return "ok"

    pauses = []
    assert tables.retried(flaky, sleep=pauses.append) == "ok" and pauses == [2.0, 4.0]

    def gone():
        raise Gone

    with pytest.raises(Gone):
        tables.retried(gone, sleep=pauses.append)
    assert pauses == [2.0, 4.0]
