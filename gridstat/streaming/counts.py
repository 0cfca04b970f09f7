"""Symbol counts kept up to date over a stream of rows: the column statistics' counts are sums, so batches add up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstat.operators import matrix as m


def windowed_counts(events: DataFrame, time: str, keys: list[str], late: str = "10 minutes", size: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Rows and distinct-free sums by event-time window and keys; rows later than ``late`` are dropped by the watermark."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(w.alias("window"), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def stream_symbol_counts(rows: DataFrame, sequence: str, keep: list[str], length: int) -> DataFrame:
    """(keep, col_ix, symbol, w) of a stream of sequences, for ``complete`` or ``update`` mode.

    State is bounded by groups x columns x symbols, whatever the number of rows.
    """
    return m.symbol_counts(m.cells_of(rows, sequence, keep, None, 0, length), keep)


def merge_counts(old: DataFrame, batch: DataFrame, by: list[str]) -> DataFrame:
    """Counts of a stored table and of one batch together, for use in ``foreachBatch``."""
    return old.unionByName(batch).groupBy(*by, "col_ix", "symbol").agg(F.sum("w").alias("w"))
