"""The corpus pipeline against plain versions of its stages, and every registered query on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F
from test_ops import classes_by_force, contamination_by_force

import corpus_pipeline
from gridstat.llm import near_dup, pii, quality, queries

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    bench = [tuple(r) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "near_dedup", "decontamination", "pii", "packing"]
    now, rows = docs, [(r.doc_id, r.text) for r in docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, DATA)
        assert now.columns == docs.columns
        if name == "quality_rules":
            rows = [x for x in rows if x[0] in kept]
        elif name == "near_dedup":
            roots = classes_by_force(rows)
            rows = [x for x in rows if roots[x[0]] == x[0]]
        elif name == "decontamination":
            bad = contamination_by_force(rows, bench)
            rows = [x for x in rows if not bad[x[0]][4]]
        else:
            f = pii.Feistel(queries.KEY)
            rows = [(d, pii.pseudonyms(t, f)[0]) for d, t in rows]
        assert sorted((r.doc_id, r.text) for r in now.collect()) == sorted(rows)
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).select("doc_id").distinct().collect()} == {d for d, _ in rows}


def test_repeated_and_null_ids(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    twice = docs.filter("doc_id < 30").unionByName(docs.filter("doc_id < 30"))
    once = corpus_pipeline.near_duplicates(spark, twice, DATA)
    assert once.count() == once.select("doc_id").distinct().count() and once.columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("doc_id < 0"), DATA).isEmpty()


def test_rows_are_judged_on_their_own(spark):
    """Rows without an id are removed like others, and a row does not go for another text of its id."""
    plain = spark.read.parquet(f"{DATA}/documents.parquet")
    usual = [r.text for r in quality.judge(plain).filter("kept").join(plain.select("doc_id", "text"), "doc_id").orderBy("doc_id").limit(3).collect()]
    leak = next(r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").collect() if len(r.text.split()) >= 13)

    def after(stage, pairs):
        rows = plain.limit(1).drop("doc_id", "text").crossJoin(spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "place int, doc_id long, text string"))
        return sorted(r.place for r in stage(spark, rows, DATA).select("place").collect())

    a, b, c = usual
    near = a.split()
    near = " ".join([*near[:-1], "changed"])
    assert after(corpus_pipeline.near_duplicates, [(None, a), (None, a), (7, b), (7, c), (5, near), (None, None), (None, None), (9, None), (9, None)]) in ([2, 3, 4, 5, 6, 7], [2, 3, 4, 5, 6, 8])
    assert after(corpus_pipeline.decontamination, [(None, leak), (None, a), (7, leak), (7, b)]) == [1, 3]
    assert after(corpus_pipeline.quality_rules, [(None, ""), (None, a), (7, ""), (7, b)]) == [1, 3]
    rows = spark.createDataFrame([(None, a), (5, near), (7, b), (7, c), (8, c), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.class_id) for r in near_dup.classes(rows).collect()), key=str)
    assert got == [(5, 5), (7, 7), (7, 7), (8, 7), (None, 5), (None, None)]


@pytest.mark.parametrize("repeated", [False, True])
def test_clashing_columns(spark, repeated):
    """Columns named as the stages' own are carried as they are."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id < 40")
    docs = docs.unionByName(docs) if repeated else docs
    odd = docs.withColumns({"_row": F.concat(F.lit("r"), "doc_id"), "gone": F.lit("g"), "class_id": F.col("doc_id") + 1, "kept": F.lit("k")})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got, plain = stage(spark, odd, DATA), stage(spark, docs, DATA)
        assert got.columns == odd.columns, name
        assert got.count() == plain.count() == got.filter("_row = concat('r', doc_id) AND gone = 'g' AND class_id = doc_id + 1 AND kept = 'k'").count(), name


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    rel = con.sql(queries.ORACLES[name])
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    want = sorted(str([dict(zip(rel.columns, r, strict=True))[c] for c in cols]) for r in rel.fetchall())
    assert sorted(str([r[c] for c in cols]) for r in df.collect()) == want
