"""Empty texts: SQL makes one gap of no column of each, null texts make nothing."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from gridstat.operators import matrix as m
from gridstat.plans import registry

#: The queries over all documents' cells, by what they share.
SCORES = ["jsd_profile", "entropy_conservation", "module_constraint", "pivot_scope_delta", "consensus_no_gap", "value_shift_panel", "null_group_scores", "job1_profiles"]
WEIGHTS = ["henikoff_weights", "gap_fraction_weighted", "kish_effective_size", "null_group_weights", "provenance_audit"]
CELLS = ["consensus_with_gap", "gap_fraction_raw", "scope_grouping_sets", "fasta_round_trip"]
#: These join by column, which leaves out what has none.
BY_COLUMN = ["mi_specificity", "group_contrast", "module_gap_decomposition", "pearson_concordance"]


def shown(rows):
    plain = lambda v: None if v is None or v != v else round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted(str(tuple(plain(v) for v in r)) for r in rows)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents of four languages, three of them empty and one null."""
    r = random.Random(5)
    rows = [(i, "".join(r.choice("ABCabc -é") for _ in range(r.choice([3, 45, 60]))), r.choice(["de", "en", "es", "fr"]), f"s{i % 3}") for i in range(40)]
    rows += [(100, "", "en", "s0"), (101, "", "en", "s1"), (102, "", "fr", "s0"), (103, None, "de", "s0")]
    path = str(tmp_path_factory.mktemp("empty"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("name", [*SCORES, *WEIGHTS, *CELLS, *BY_COLUMN])
def test_empty_texts_are_as_in_sql(spark, folder, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    rel = con.sql(registry.ORACLES[name])
    got = registry.QUERIES[name](spark, folder)
    assert shown(got.select(*rel.columns).collect()) == shown(rel.fetchall())


@pytest.mark.parametrize("held", [1 << 24, 1])
def test_empty_sequences_in_operators(spark, monkeypatch, held):
    """Counts, weights and first rows of empty sequences are those of cells, also where tables do not all fit or rows share an id; unless asked for they have none."""
    for name, value in (("TILE", 8), ("_HELD", held), ("PIECE", 8)):
        monkeypatch.setattr(m, name, value)
    rows = [(1, "a", "", 2.0), (2, "a", "ABé", 1.0), (3, None, "", 0.5), (4, None, None, 1.0), (5, "b", "-" * 20, 1.0), (-6, "a", "", 4.0), (7, "lone", "", 1.0), (2, "a", "", 1.0)]
    df = spark.createDataFrame(rows, "row_id long, g string, s string, x double").repartition(2)
    cells = m.cells_of(df, "s", ["row_id", "g", "x"], None, empty=True)
    assert sorted(cells.filter("col_ix is null").select("row_id", "symbol").collect()) == [(-6, "-"), (1, "-"), (2, "-"), (3, "-"), (7, "-")]
    want = cells.groupBy("g", "col_ix", "symbol").agg(F.sum("x").alias("w"), F.min("row_id").alias("seen"))
    got = m.sequence_counts(df, "s", ["g"], None, "x", "row_id", empty=True)
    assert shown(got.collect()) == shown(want.collect())
    assert shown(m.sequence_counts(df, "s", ["g"], empty=True).collect()) == shown(m.symbol_counts(cells, ["g"]).collect())
    for by in (["g"], []):
        weights = m.sequence_weights(df, "s", m.sequence_counts(df, "s", by), by, empty=True)
        assert shown(weights.collect()) == shown(m.henikoff_weights(cells, by).collect())
    assert m.sequence_counts(df, "s", ["g"]).filter("col_ix is null").isEmpty() and m.cells_of(df, "s", ["g"], None).filter("col_ix is null").isEmpty()
