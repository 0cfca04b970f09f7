"""The driver's tables read as categorical matrices, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstat.operators import matrix as m
from gridstat.sources.scratch import stash

LETTERS = 52
#: Column intervals of the matrix; two of them overlap.
MODULES = [("body", 8, 29), ("head", 0, 9), ("tail", 30, 39)]
#: Columns of the aligned matrix, and its symbols beside the gap.
DIMENSIONS, BINS = 64, 8


def dealt(df: DataFrame) -> DataFrame:
    """A table of fewer files than there are cores is dealt out, as one row group is one task; a larger one is read as it is split."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every character of every document in a column of its own: ASCII letters as they are, all else a gap.  Rows end where their text does; an empty one is a gap of no column, as in ``cells_sql``."""
    return m.cells_of(rows(spark, sf_dir), "text", ["row_id", "grp", "entity"], None, empty=True)


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as rows (row_id, grp, entity, text) of a matrix."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dealt(docs.select(F.col("doc_id").alias("row_id"), F.col("lang").alias("grp"), F.col("source").alias("entity"), "text"))


def counts(spark: SparkSession, sf_dir: str, empty: bool = True) -> DataFrame:
    """Symbol counts of the documents by group and column, written once for all that follows from them; without ``empty``, of columns that are not null."""
    return stash(m.sequence_counts(rows(spark, sf_dir), "text", ["grp"], empty=empty), "counts")


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a rectangular matrix (row_id, grp, col_ix, symbol): every dimension of every vector in one of 8 classes, a gap near 0."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("grp"), F.posexplode("embedding").alias("col_ix", "x"))
    return v.select("row_id", "grp", "col_ix", symbol_of(F.col("x").cast("double")).alias("symbol"))


def symbol_of(x):
    place = F.least(F.greatest(F.floor(x * 20.0) + BINS // 2, F.lit(0)), F.lit(BINS - 1)).cast("int")
    return F.when(F.abs(x) < 0.005, m.GAP).otherwise(F.substring(F.lit("ABCDEFGH"), place + 1, F.lit(1)))


def aligned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aligned matrix as packed rows (row_id, grp, symbols)."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    symbols = F.array_join(F.transform("embedding", lambda x: symbol_of(x.cast("double"))), "")
    return v.select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("grp"), symbols.alias("symbols"))


ALIGNED_SQL = """cells AS (SELECT vec_id AS row_id, CAST(label AS VARCHAR) AS grp, CAST(i AS INTEGER) AS col_ix,
      CASE WHEN abs(x) < 0.005e0 THEN '-' ELSE substr('ABCDEFGH', CAST(least(greatest(floor(x * 20e0) + 4, 0), 7) AS INTEGER) + 1, 1) END AS symbol
      FROM (SELECT vec_id, label, unnest(range(len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings))"""


def aligned_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraint scores of the aligned matrix by group, against the symbols of all cells."""
    return scored(stash(m.symbol_counts(aligned(spark, sf_dir), ["grp"]), "counts"), ["grp"])


def weighed(spark: SparkSession, sf_dir: str, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The documents as rows, and their position-based weights within ``by``."""
    r = rows(spark, sf_dir)
    return r, m.sequence_weights(r, "text", stash(m.sequence_counts(r, "text", by), "counts"), by, empty=True)


def scores(spark: SparkSession, sf_dir: str, by: list[str]) -> DataFrame:
    """Constraint scores against the letters of all cells."""
    return scored(counts(spark, sf_dir), by)


def scored(counted: DataFrame, by: list[str]) -> DataFrame:
    """``scores`` of counts that are there."""
    background = m.pooled_background(counted)
    if not by:
        counted = counted.groupBy("col_ix", "symbol").agg(F.sum("w").alias("w"))
    return m.column_constraint(counted, background, by, LETTERS)


def cells_sql(name: str = "cells") -> str:
    return f"""{name} AS (SELECT row_id, grp, entity, CAST(i AS INTEGER) AS col_ix, CASE WHEN regexp_full_match(ch, '[A-Za-z]') THEN ch ELSE '-' END AS symbol
      FROM (SELECT doc_id AS row_id, lang AS grp, source AS entity, unnest(range(length(text))) AS i, unnest(string_split(text, '')) AS ch FROM documents))"""


BACKGROUND_SQL = "bg AS (SELECT symbol, count(*) * 1e0 / sum(count(*)) OVER () AS q FROM cells WHERE symbol <> '-' GROUP BY symbol)"


def scores_sql(by_group: bool, source: str | None = None) -> str:
    """CTEs up to ``scores`` (grp, col_ix, entropy_bits, conservation_norm, jsd, jsd_residues, gap_fraction)."""
    g = "grp" if by_group else "'all' AS grp"
    return f"""{source or cells_sql()}, {BACKGROUND_SQL},
    cnt AS (SELECT {g}, col_ix, symbol, count(*) * 1e0 AS w FROM cells GROUP BY ALL),
    tot AS (SELECT grp, col_ix, sum(w) AS t, sum(CASE WHEN symbol = '-' THEN w ELSE 0e0 END) AS g FROM cnt GROUP BY ALL),
    frq AS (SELECT c.grp, c.col_ix, c.symbol, c.w / (t - g) AS p FROM cnt c JOIN tot ON c.grp IS NOT DISTINCT FROM tot.grp AND c.col_ix = tot.col_ix WHERE symbol <> '-'),
    raw AS (SELECT tot.grp, tot.col_ix, max(g / t) AS gap_fraction, coalesce(-sum(p * log2(p)), 0e0) AS entropy_bits,
      0.5e0 * (coalesce(sum(p * log2(p / (0.5e0 * (p + q))) + q * log2(q / (0.5e0 * (p + q)))), 0e0) + 1e0 - coalesce(sum(q), 0e0)) AS jsd_residues
      FROM tot LEFT JOIN frq ON frq.grp IS NOT DISTINCT FROM tot.grp AND frq.col_ix = tot.col_ix LEFT JOIN bg USING (symbol) GROUP BY tot.grp, tot.col_ix),
    scores AS (SELECT *, 1e0 - entropy_bits / log2(52e0) AS conservation_norm, jsd_residues * (1e0 - gap_fraction) AS jsd FROM raw)"""


MODULES_SQL = "modules AS (SELECT * FROM (VALUES ('body', 8, 29), ('head', 0, 9), ('tail', 30, 39)) AS t(module, a, b))"
#: Tables of fixed size, whose files are hashed.
PANEL_FILES = ("nation", "region")
