"""Two-sample tests, correlations, intervals of proportions and meta-analysis."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridstat.functions import lattice, tails
from gridstat.functions.ordered import average_rank, by_keys, ranks, running, with_totals
from gridstat.sources.scratch import stash

Z95 = 1.959964


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    """Two-sided tail of the standard normal distribution."""
    return z.map(lambda x: tails.normal_two_sided(x), na_action="ignore").astype("float64")


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or b < 1 else tails.chi2_sf(a, b) for a, b in zip(x, df, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else tails.t_two_sided(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def kolmogorov_p(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
    """P(D >= d) by counting paths (``lattice.ks_tail``)."""
    return pd.Series([None if pd.isna(a) else lattice.ks_tail(a, int(b), int(c)) for a, b, c in zip(d, n, m, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def mann_whitney_p(u: pd.Series, n: pd.Series, m: pd.Series, z: pd.Series, tie: pd.Series) -> pd.Series:
    """Two-sided p of U: exact for a sample of at most 8 without ties, else normal (``lattice.u_tail``)."""
    rows = zip(u, n, m, z, tie, strict=True)
    return pd.Series([None if pd.isna(a) else lattice.u_tail(a, int(b), int(c), d, e > 0) for a, b, c, d, e in rows], dtype="float64")


@F.pandas_udf(T.DoubleType())
def hypergeom_p(k: pd.Series, total: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
    return pd.Series([tails.hypergeom_sf(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(k, total, marked, drawn, strict=True)], dtype="float64")


def rank_sums(df: DataFrame, value: str, arm: str, by: list[str] = []) -> DataFrame:
    """(by, n_a, n_b, u, tie): Mann-Whitney U of the arm that is true against the other, and sum of t^3 - t over ties."""
    per = df.groupBy(*by, value).agg(F.sum(F.col(arm).cast("long")).alias("a"), F.sum((~F.col(arm)).cast("long")).alias("b"))
    r = ranks(df, value, by)
    joined = by_keys(per, r, [*by, value])
    g = joined.groupBy(*by).agg(
        F.sum(F.col("a") * (F.col("less") + (F.col("ties") + 1) / 2)).alias("ra"), F.sum("a").alias("n_a"), F.sum("b").alias("n_b"),
        F.sum(F.col("ties").cast("double") * F.col("ties") * F.col("ties") - F.col("ties")).alias("tie"),
    )
    return g.select(*by, "n_a", "n_b", (F.col("ra") - F.col("n_a") * (F.col("n_a") + 1) / 2.0).alias("u"), "tie")


def cliffs_delta(df: DataFrame, value: str, arm: str, by: list[str] = []) -> DataFrame:
    """P(a > b) - P(a < b), null when an arm is empty."""
    s = rank_sums(df, value, arm, by)
    return s.select(*by, "n_a", "n_b", F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), 2.0 * F.col("u") / (F.col("n_a") * F.col("n_b")) - 1.0).alias("cliffs_delta"))


def mann_whitney(df: DataFrame, value: str, arm: str, by: list[str] = [], ties: bool = False) -> DataFrame:
    """U and its normal score, with tie and continuity corrections; with ``ties`` also the sum of t^3 - t over tied values."""
    s = rank_sums(df, value, arm, by)
    n = F.col("n_a") + F.col("n_b")
    mid = F.col("n_a") * F.col("n_b") / 2.0
    sd = F.sqrt(F.col("n_a") * F.col("n_b") / 12.0 * ((n + 1) - F.coalesce(F.try_divide("tie", n * (n - 1.0)), F.lit(0.0))))
    z = F.when(sd > 0, F.greatest(F.abs(F.col("u") - mid) - 0.5, F.lit(0.0)) / sd * F.signum(F.col("u") - mid))
    return s.select(*by, "n_a", "n_b", "u", z.alias("z"), *(["tie"] if ties else []))


def ks_statistic(df: DataFrame, value: str, arm: str, by: list[str] = []) -> DataFrame:
    """Greatest distance between the two empirical distributions, from one running pair of counts over distinct values; null when an arm is empty."""
    per = df.groupBy(*by, value).agg(F.sum(F.col(arm).cast("long")).alias("t0"), F.sum((~F.col(arm)).cast("long")).alias("t1"))
    run = running(per, value, [], ["t0", "t1"], by, ["c0", "c1"])
    run = with_totals(run, per.groupBy(*by).agg(F.sum("t0").alias("n_a"), F.sum("t1").alias("n_b")), by)
    gap = F.abs(F.try_divide(F.col("c0") + F.col("t0"), "n_a") - F.try_divide(F.col("c1") + F.col("t1"), "n_b"))
    return run.groupBy(*by, "n_a", "n_b").agg(F.max(gap).alias("ks"))


def pearson(df: DataFrame, x: str, y: str, by: list[str] = []) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))


def spearman(df: DataFrame, x: str, y: str, by: list[str] = []) -> DataFrame:
    """Correlation of average ranks."""
    r = average_rank(stash(average_rank(df, x, by, "_rx"), "ranks"), y, by, "_ry")
    return r.groupBy(*by).agg(F.count("*").alias("n"), F.corr("_rx", "_ry").alias("rho"))


def correlation_p(r: Column, n: Column) -> Column:
    """Two-sided p of a correlation by Student's t."""
    df = (n - 2).cast("double")
    return t_p(r * F.sqrt(df / (1 - r * r)), df)


def wilson(successes: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson's interval of a proportion."""
    p = successes / n
    centre = (p + z * z / (2.0 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4.0 * n * n)) / (1 + z * z / n)
    return centre - half, centre + half


def fixed_effect(tests: DataFrame, effect: str, low: str, high: str, subgroup: str | None = None) -> DataFrame:
    """Inverse-variance pooling of all tests and of each subgroup; standard errors come from 95 % intervals."""
    se = (F.col(high) - F.col(low)) / (2 * Z95)
    d = tests.withColumn("_se", se).filter("_se > 0").withColumns({"_w": 1.0 / (F.col("_se") * F.col("_se")), "_e": F.col(effect).cast("double")})
    d = d.withColumn("_m", F.lit("all")) if subgroup is None else d.withColumn("_m", F.explode(F.array(F.lit("all"), F.concat(F.lit("only_"), F.col(subgroup)))))
    g = d.groupBy("_m").agg(F.count("*").alias("n_tests"), F.sum("_w").alias("sw"), F.sum(F.col("_w") * F.col("_e")).alias("swe"), F.sum(F.col("_w") * F.col("_e") * F.col("_e")).alias("swee"))
    pooled, se = F.col("swe") / F.col("sw"), F.sqrt(1.0 / F.col("sw"))
    q = F.greatest(F.col("swee") - F.col("swe") * F.col("swe") / F.col("sw"), F.lit(0.0))
    every = F.col("_m") == "all"
    i2 = F.when(q > 0, F.greatest(F.lit(0.0), (q - (F.col("n_tests") - 1)) / q)).otherwise(0.0)
    return g.select(
        F.col("_m").alias("model"), "n_tests", pooled.alias("pooled"), (pooled - Z95 * se).alias("ci_low"), (pooled + Z95 * se).alias("ci_high"), (pooled / se).alias("z"),
        F.when(every, q).alias("cochran_q"), F.when(every, i2).alias("i_squared"),
    )


def top_overlap(scores: DataFrame, axis: str, item: str, score: str, top: int) -> DataFrame:
    """For each pair of axes, how many of their ``top`` items are the same, and how many by chance."""
    from pyspark.sql import Window

    w = Window.partitionBy(axis).orderBy(F.desc_nulls_last(score), item)
    best = scores.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top).select(axis, item)
    total = scores.groupBy(axis).agg(F.count_distinct(item).alias("n_columns"))
    a, b = total.withColumnRenamed(axis, "axis_a"), total.select(F.col(axis).alias("axis_b"))
    pairs = a.join(b, F.col("axis_a") < F.col("axis_b"))  # a row for each pair of axes
    both = best.withColumnRenamed(axis, "axis_a").join(best.withColumnRenamed(axis, "axis_b"), item).filter("axis_a < axis_b").groupBy("axis_a", "axis_b").agg(F.count("*").alias("overlap"))
    out = pairs.join(both, ["axis_a", "axis_b"], "left").fillna(0, ["overlap"])
    return out.select("axis_a", "axis_b", "n_columns", "overlap", (F.lit(float(top * top)) / F.col("n_columns")).alias("expected"))
