"""Constraint profiles of every column and group, kept up to date as sequences arrive.

    python -m jobs.profiles --input IN --output OUT --checkpoint CHECKPOINT

A file stream takes the Parquet files of IN, a folder or a pattern, that no earlier run
took.  A column's statistics are functions of its symbol counts, and these add up, so
each batch is counted once and written to OUT/counts/stream=S/batch=N; a batch that is
run again after a failure writes the same folder again.  S names the checkpoint's stream:
with a new checkpoint all files are counted anew, and the counts of the old are not read.
Profiles follow from the sums of the stream's counts and replace OUT/profiles, one
folder for each group, in place.  A run that finds nothing new rewrites them as they were.
"""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstat.operators import matrix as m

from .command import config_of, main

log = logging.getLogger("jobs.profiles")
COUNTS = "grp string, col_ix int, symbol string, w double"
PROFILES = "n_rows long, col_ix int, entropy_bits double, conservation_norm double, jsd double, jsd_residues double, gap_fraction double, grp string"


def counted(rows: DataFrame, config: dict[str, Any]) -> DataFrame:
    """(grp, col_ix, symbol, w): how often each group has each symbol in each column; the column -1 counts its rows, and no column (null) its empty ones where ``empty_rows`` is set."""
    named = rows.select(F.col(config["group"]).cast("string").alias("grp"), F.col(config["sequence"]).alias("sequence"))
    symbols = m.sequence_counts(named, "sequence", ["grp"], empty=config["empty_rows"])
    return symbols.unionByName(named.groupBy("grp").agg(F.count("*").cast("double").alias("w")).withColumns({"col_ix": F.lit(-1), "symbol": F.lit("rows")}))


def profiled(counts: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Profiles from counts of any number of batches."""
    total = counts.groupBy("grp", "col_ix", "symbol").agg(F.sum("w").alias("w"))
    cells, rows = total.filter("col_ix is null or col_ix >= 0"), total.filter("col_ix < 0").select(F.col("grp").alias("_grp"), F.col("w").cast("long").alias("n_rows"))
    scores = m.column_constraint(cells, m.pooled_background(cells), ["grp"], config["alphabet_size"])
    return scores.join(rows, F.col("grp").eqNullSafe(F.col("_grp"))).select(*(x.split()[0] for x in PROFILES.split(", ")))


def run(spark: SparkSession, input: str, output: str, checkpoint: str, config: dict[str, Any] | None = None) -> DataFrame:
    """Count the new files of a folder of Parquet sequences and bring the constraint profiles up to date; returns them."""
    config = config or config_of("profiles")
    schema = spark.read.parquet(input).schema

    def keep(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        path = f"{output}/counts/stream={stream}/batch={number}"
        counted(batch, config).write.mode("overwrite").parquet(path)
        log.info("read %d rows in batch %d", batch.sparkSession.read.schema(COUNTS).parquet(path).filter("col_ix < 0").agg(F.sum("w")).first()[0], number)

    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(input)
    query = source.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(keep).start()
    query.awaitTermination()
    log.info("read what is new of %s, as stream %s", input, query.id)
    counts = spark.read.schema(COUNTS).parquet(f"{output}/counts/stream={query.id}")
    # where a partition is replaced as a whole, readers see the old or the new one
    profiled(counts, config).repartition("grp").sortWithinPartitions("grp", "col_ix").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("grp").parquet(f"{output}/profiles")
    out = spark.read.schema(PROFILES).parquet(f"{output}/profiles")
    log.info("wrote %d columns of %d groups to %s/profiles", out.count(), out.select("grp").distinct().count(), output)
    return out


if __name__ == "__main__":
    main("profiles", {"input": "folder of Parquet files of sequences", "output": "folder of counts and profiles", "checkpoint": "folder of the stream's checkpoint"}, run)
