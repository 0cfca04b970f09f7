"""Records assigned to families by their search hits, one representative for each family and entity.

    python -m jobs.assignment --hits HITS --records RECORDS --output OUT

HITS has a row for each hit of a record (query) on a reference with a score; RECORDS
one for each record.  OUT/calls gets a row for each record that has a hit, in one folder
for each verdict: its best reference and score, the runner-up, their ratio, coverage and
identity, and whether it represents its entity in its family.  OUT/summary gets counts by
family and verdict as JSON.  Both are replaced as a whole, so that a run can be repeated.
Columns and thresholds are those of the config; coverage and identity are SQL expressions
over the records' columns.
"""

from __future__ import annotations

import logging
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstat.operators import ranking

from .command import config_of, main

log = logging.getLogger("jobs.assignment")
CALLS = "query long, entity string, best_ref string, best_score double, runner_up_ref string, runner_up_score double, margin double, coverage double, identity double, representative boolean, verdict string"


def called(hits: DataFrame, records: DataFrame, config: dict[str, Any]) -> DataFrame:
    """The calls of all records with hits; a null margin (no runner-up) passes, a hit of no record is rejected by its null coverage."""
    best = ranking.best_and_runner_up(hits.select(F.col(config["query"]).alias("query"), F.col(config["reference"]).alias("ref"), F.col(config["score"]).cast("double").alias("score")), "query", "ref", "score")
    of = records.select(
        F.col(config["record"]).alias("query"), F.col(config["entity"]).cast("string").alias("entity"), F.col(config["name"]).alias("name"),
        F.expr(config["coverage"]).cast("double").alias("coverage"), F.expr(config["identity"]).cast("double").alias("identity"),
    )
    limits = {k: config[k] for k in ("min_coverage", "min_identity", "min_margin")}
    known = F.when(F.col("coverage").isNull() | F.col("identity").isNull(), "no_record")
    verdict = F.coalesce(known, ranking.acceptance(F.col("best_ref"), F.col("coverage"), F.col("identity"), F.col("margin"), config["targets"], **limits))
    return best.join(of, "query", "left").withColumn("verdict", verdict)


def run(spark: SparkSession, hits: str, records: str, output: str, config: dict[str, Any] | None = None) -> DataFrame:
    """Assign the records of a table to families by a table of hits; returns the calls."""
    config = config or config_of("assignment")
    hit, record = spark.read.parquet(hits), spark.read.parquet(records)
    calls = called(hit, record, config)
    # the first of each family and entity by a combinable maximum; the least record wins ties
    order = F.struct("coverage", "name", (-F.col("query")).alias("least"))
    first = calls.filter("verdict = 'ok'").groupBy("best_ref", "entity").agg(F.max(order).alias("m")).select("best_ref", F.col("entity").alias("_entity"), (-F.col("m.least")).alias("query"), F.lit(True).alias("representative"))
    out = calls.join(first.drop("_entity"), ["query", "best_ref"], "left").withColumn("representative", F.coalesce("representative", F.lit(False)))
    out.select(*(F.col(x.split()[0]).cast(x.split()[1]) for x in CALLS.split(", "))).write.mode("overwrite").partitionBy("verdict").parquet(f"{output}/calls")
    written = spark.read.schema(CALLS).parquet(f"{output}/calls")
    summary = written.groupBy("best_ref", "verdict").agg(F.count("*").alias("calls"), F.count_if("representative").alias("representatives"))
    summary.coalesce(1).sort("best_ref", "verdict").write.mode("overwrite").json(f"{output}/summary")
    log.info("read %d hits of %s and %d records of %s", hit.count(), hits, record.count(), records)
    for r in spark.read.json(f"{output}/summary").groupBy("verdict").agg(F.sum("calls").alias("n")).sort("verdict").collect():  # a row for each verdict
        log.info("wrote %d calls with verdict %s to %s/calls", r["n"], r["verdict"], output)
    return written


if __name__ == "__main__":
    main("assignment", {"hits": "Parquet table of hits", "records": "Parquet table of records", "output": "folder of calls and summary"}, run)
