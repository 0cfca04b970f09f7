"""The corpus pipeline: stages on ``documents``, each written as Parquet and reread as the next one's input.

Filtering stages remove rows: the rows to remove are written as a small table
and taken out by an anti-join, which Spark broadcasts only where the table's
measured size allows it.  A row is named by its doc_id; where rows lack one or
share one, the stage numbers its rows in a written table and goes by that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstat.llm import decontaminate, near_dup, packing, pii, quality
from gridstat.llm.queries import KEY, tokenizer
from gridstat.sources.scratch import new_path, stash
from gridstat.sources.workers import reach


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have, whatever its case."""
    have = {c.lower() for c in docs.columns}
    while name in have:
        name += "_"
    return name


def _without(docs: DataFrame, judged: Callable[[DataFrame], DataFrame], name: str, copies: bool = False) -> DataFrame:
    """docs without the rows whose doc_id ``judged`` gives; it sees a doc_id of its own in every row.

    With ``copies`` it gives the class_id of every row, and one row of each class stays: that of the least doc_id.
    """
    row = _free(docs, "_row")
    if near_dup.unique_ids(docs):
        rows = docs.withColumn(row, F.col("doc_id").cast("long"))
        out = judged(docs)
        out = out.filter("doc_id != class_id") if copies else out
    else:
        rows = stash(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
        out = judged(rows.withColumn("doc_id", F.col(row)).drop(row))
        if copies:
            # null texts are each their own class, but those of one doc_id are one
            own = rows.select(F.col(row).alias("_row"), F.col("doc_id").cast("long").alias("_id"), F.col("text").isNull().alias("_null"))
            lone = F.col("_null") & F.col("_id").isNotNull()
            named = out.join(own, out["doc_id"] == own["_row"]).select("_id", "_row", F.when(lone, F.col("_id")).alias("_lone"), F.when(~lone, F.col("class_id")).alias("_class"))
            named = stash(named, "classes")
            first = named.groupBy("_lone", "_class").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("m")).select("m._row")
            out = named.join(first, "_row", "left_anti").select(F.col("_row").alias("doc_id"))
    gone = stash(out.select(F.col("doc_id").cast("long").alias("gone")).distinct(), name)
    return rows.join(gone, rows[row] == gone["gone"], "left_anti").select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the outlier rule keep."""
    reach(spark)
    return _without(docs, lambda rows: quality.judge(rows).filter("not kept"), "rejected")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the least doc_id."""
    reach(spark)
    return _without(docs, near_dup.classes, "copies", copies=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark's passages."""
    reach(spark)
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, lambda rows: decontaminate.contamination(rows, benchmark).filter("contaminated"), "contaminated")


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal numbers and dates permuted."""
    reach(spark)
    return pii.pseudonymize(docs, KEY, found=None)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document in training sequences."""
    reach(spark)
    return packing.pack(docs, tokenizer())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_duplicates),
    ("decontamination", decontamination),
    ("pii", pseudonyms),
    ("packing", packed),
]
#: Several stages are iterative or hash-based, which SQL does not express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = new_path(spark, name)
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
