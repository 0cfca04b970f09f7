"""Round trips through the engine's file formats; SQL has no counterpart for reading back what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridstat.operators import matrix as m
from gridstat.sources import fasta, tables
from gridstat.sources.scratch import new_path

from .inputs import PANEL_FILES, cells_sql, rows
from .registry import query, table


@query(f"WITH {cells_sql()}, r AS (SELECT grp, row_id, string_agg(symbol, '' ORDER BY col_ix) AS seq FROM cells GROUP BY ALL) SELECT grp || '|' || row_id AS header, grp, CAST(row_id AS VARCHAR) AS entity, seq FROM r")
def fasta_round_trip(spark, sf_dir):
    """The matrix written as FASTA with short lines and read back, headers split."""
    r = rows(spark, sf_dir).filter("text is not null").select(F.concat_ws("|", "grp", "row_id").alias("header"), F.when(F.col("text") == "", m.GAP).otherwise(m.symbols_of(F.col("text"), None)).alias("seq"))
    path = new_path(spark, "matrix.fasta")
    fasta.write_fasta(r, path, 16)
    return fasta.header_fields(fasta.read_fasta(spark, path)).select("header", "grp", "entity", "seq")


@query()
def manifest_sha256(spark, sf_dir):
    """Size and truncated digest of the dimension tables' files."""
    out = None
    for name in PANEL_FILES:
        one = tables.manifest(spark, f"{sf_dir}/{name}.parquet").select(F.lit(name).alias("name"), "size", "sha256_16")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(spark, sf_dir):
    path = new_path(spark, "nation.csv")
    tables.write_csv(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return tables.read_csv(spark, path, "n_nationkey int, n_name string, n_regionkey int")


@query("SELECT r_regionkey, r_name FROM region")
def json_round_trip(spark, sf_dir):
    path = new_path(spark, "region.json")
    tables.write_json(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), path)
    return tables.read_json(spark, path, "r_regionkey int, r_name string", lines=True)
