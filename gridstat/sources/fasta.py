"""FASTA as a splittable text source and sink, and delimited and JSON tables of the pipeline.

Records are the pieces between line ends that a ``>`` follows, so a file of any
size is read in splits; multi-line sequences are joined inside a record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEP = "\n>"


def read_fasta(spark: SparkSession, path: str, last_wins: bool = True) -> DataFrame:
    """(header, seq, ord).  ``ord`` grows in file order; of records with one header the last is kept unless told otherwise."""
    raw = spark.read.option("lineSep", SEP).text(path).withColumn("ord", F.monotonically_increasing_id())
    t = raw.select("ord", F.regexp_replace("value", r"^>", "").alias("_t")).filter(F.length(F.trim("_t")) > 0)
    header = F.regexp_replace(F.substring_index("_t", "\n", 1), r"\r$", "")
    body = F.when(F.instr("_t", "\n") > 0, F.expr("substring(_t, instr(_t, '\\n') + 1)")).otherwise("")
    rows = t.select(header.alias("header"), F.regexp_replace(body, r"\s+", "").alias("seq"), "ord")
    if not last_wins:
        return rows
    return rows.groupBy("header").agg(F.max(F.struct("ord", "seq")).alias("m")).select("header", F.col("m.seq").alias("seq"), F.col("m.ord").alias("ord"))


def parse_fasta(df: DataFrame, column: str) -> DataFrame:
    """Records of FASTA text held in a column."""
    parts = F.filter(F.split(F.regexp_replace(F.col(column), r"^\s*>", ""), r"\n>"), lambda x: F.trim(x) != "")
    t = df.select(F.posexplode(parts).alias("ord", "_t"))
    return t.select(F.trim(F.substring_index("_t", "\n", 1)).alias("header"), F.regexp_replace(F.regexp_replace("_t", r"^[^\n]*", ""), r"\s+", "").alias("seq"), "ord")


def write_fasta(rows: DataFrame, path: str, width: int = 60) -> None:
    """Write (header, seq) with lines of ``width`` symbols."""
    lines = F.regexp_replace(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), r"\n$", "")
    rows.select(F.concat(F.lit(">"), F.col("header"), F.lit("\n"), lines).alias("value")).write.text(path)


def header_fields(df: DataFrame, header: str = "header") -> DataFrame:
    """kind (REF, STRUCT or SEQ), grp, entity and accession of pipe-separated headers."""
    p = F.split(F.col(header), r"\|")
    marked = p[0].isin("REF", "STRUCT")
    at = lambda i: F.when(F.size(p) > i, p[i])
    return df.withColumns({"kind": F.when(marked, p[0]).otherwise("SEQ"), "grp": F.when(marked, at(1)).otherwise(p[0]), "entity": F.when(~marked, at(1)), "accession": at(2)})
