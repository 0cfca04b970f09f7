"""Best hits, margins, acceptance cascades, one-per-key choices, tertile strata and false-discovery control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridstat.functions.ordered import accumulated, by_keys, ranks, row_numbers, with_totals


def best_per_key(df: DataFrame, keys: list[str], order: list[Column], carry: list[str]) -> DataFrame:
    """One row per key: ``carry`` of the first row in ``order`` (end it with a unique column)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(*keys, *carry)


def best_and_runner_up(hits: DataFrame, query: str, ref: str, score: str, carry: list[str] = []) -> DataFrame:
    """Per query: best hit, best hit to another reference, and their ratio (null without a runner-up of positive score).

    Hits are first reduced to the best of each (query, ref) by a combinable aggregate; ref breaks ties.
    """
    per_ref = hits.groupBy(query, ref).agg(F.max(F.struct(F.col(score).alias("score"), *carry)).alias("m"))
    ordered = Window.partitionBy(query).orderBy(F.desc("m.score"), F.asc(ref))
    two = per_ref.withColumn("_rn", F.row_number().over(ordered)).filter("_rn <= 2")
    pick = lambda n, c: F.max(F.when(F.col("_rn") == n, c))
    out = two.groupBy(query).agg(
        pick(1, F.col(ref)).alias("best_ref"), pick(1, F.col("m.score")).alias("best_score"), *(pick(1, F.col(f"m.{c}")).alias(c) for c in carry),
        pick(2, F.col(ref)).alias("runner_up_ref"), pick(2, F.col("m.score")).alias("runner_up_score"),
    )
    return out.withColumn("margin", F.when(F.col("runner_up_score") > 0, F.col("best_score") / F.col("runner_up_score")))


def acceptance(ref: Column, coverage: Column, identity: Column, margin: Column, targets: list[str], min_coverage: float = 0.55, min_identity: float = 0.35, min_margin: float = 1.10) -> Column:
    """Why a call is rejected, the first reason that holds, or ``ok``.  A null margin has no runner-up and passes."""
    return (
        F.when(~F.coalesce(ref.isin(*targets), F.lit(False)), "non_target")
        .when(coverage < min_coverage, "low_coverage")
        .when(identity < min_identity, "low_identity")
        .when(margin < min_margin, "ambiguous")
        .otherwise("ok")
    )


def refiltered(calls: DataFrame, mode: str = "corrected", min_coverage: float = 0.55, min_identity: float = 0.35, min_margin: float = 1.10) -> DataFrame:
    """Calls (coverage, identity, margin) that pass the thresholds a second time.

    ``corrected``: on the values as they are, a null margin passes as it does at acceptance.
    ``reference``: on stored values, 4, 4 and 3 decimals, with a missing margin stored as -1 and so rejected.
    """
    if mode == "corrected":
        return calls.filter((F.col("coverage") >= min_coverage) & (F.col("identity") >= min_identity) & (F.col("margin").isNull() | (F.col("margin") >= min_margin)))
    if mode != "reference":
        raise ValueError(mode)
    stored = calls.withColumns({"_c": F.round("coverage", 4), "_i": F.round("identity", 4), "_m": F.coalesce(F.round("margin", 3), F.lit(-1.0))})
    return stored.filter((F.col("_c") >= min_coverage) & (F.col("_i") >= min_identity) & (F.col("_m") >= min_margin)).drop("_c", "_i", "_m")


def normalised_fraction(df: DataFrame, column: str, limit: float = 1.5) -> DataFrame:
    """Percentages to fractions, if the column's greatest value shows that it holds percentages."""
    top = df.agg(F.max(column).alias("_top"))  # one row
    return df.crossJoin(F.broadcast(top)).withColumn(column, F.when(F.col("_top") > limit, F.col(column) / 100.0).otherwise(F.col(column))).drop("_top")


def quantile_bins(df: DataFrame, value: str, key: str, by: list[str] = [], bins: int = 3, name: str = "bin") -> DataFrame:
    """Equal-count bins of first-come ranks with linearly interpolated edges (sizes 2-1-2, 2-2-3, 3-2-3 for n of 5, 7, 8)."""
    r = row_numbers(df, value, [key], by, "_rn")
    r = with_totals(r, df.groupBy(*by).agg(F.count("*").alias("_n")), by)
    place = F.floor(F.lit(bins) * (F.col("_rn") - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    return r.withColumn(name, F.least(F.lit(bins - 1), place).cast("int")).drop("_rn", "_n")


def usable_strata(df: DataFrame, stratum: str, flag: str) -> DataFrame:
    """Rows of strata in which the flag is neither always nor never true; rows of a null stratum are one stratum."""
    g = df.groupBy(stratum).agg(F.sum(F.col(flag).cast("long")).alias("_k"), F.count("*").alias("_n")).filter("_k > 0 and _k < _n").select(stratum)
    return by_keys(df, g, [stratum])


def benjamini_hochberg(df: DataFrame, p: str, by: list[str] = [], name: str = "q_bh") -> DataFrame:
    """Adjusted p-values; rows with a null p keep a null.  Equal p-values get equal q-values.

    The step-up minimum over larger p is a running one over distinct values from the greatest on.
    """
    r = ranks(df.filter(F.col(p).isNotNull()), p, by)
    r = with_totals(r, r.groupBy(*by).agg(F.sum("ties").alias("_n")), by)
    raw = r.select(*by, p, (F.col(p) * F.col("_n") / (F.col("less") + F.col("ties"))).alias("_raw"))
    q = accumulated(raw, by, [F.desc(p)], least={name: "_raw"}).select(*by, p, F.least(F.lit(1.0), name).alias(name))
    return by_keys(df, q, [*by, p], "left")
