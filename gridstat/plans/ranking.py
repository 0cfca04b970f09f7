"""Best hits, margins, choices per key, ranks, strata and false-discovery control on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridstat.functions.ordered import average_rank, fraction_below
from gridstat.operators import ranking as r

from .registry import query, rounded, table

TARGETS = ["1-URGENT", "2-HIGH", "3-MEDIUM"]

HITS_SQL = """hits AS (SELECT o_custkey AS query, o_orderpriority AS ref, max(o_totalprice) AS score FROM orders GROUP BY ALL),
  ord AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ref) AS rn FROM hits),
  best AS (SELECT a.query, a.ref AS best_ref, a.score AS best_score, b.ref AS runner_up_ref, b.score AS runner_up_score, CASE WHEN b.score > 0 THEN a.score / b.score END AS margin
    FROM ord a LEFT JOIN ord b ON a.query = b.query AND b.rn = 2 WHERE a.rn = 1)"""
CALLS_SQL = f"""{HITS_SQL}, calls AS (SELECT best.*, c_acctbal / 10000 AS coverage, (c_custkey % 100) / 100e0 AS identity,
    CASE WHEN best_ref NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 'non_target' WHEN c_acctbal / 10000 < 0.55e0 THEN 'low_coverage' WHEN (c_custkey % 100) / 100e0 < 0.35e0 THEN 'low_identity' WHEN margin < 1.10e0 THEN 'ambiguous' ELSE 'ok' END AS reason
    FROM best LEFT JOIN customer ON query = c_custkey)"""


def hits(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("query"), F.col("o_orderpriority").alias("ref"), F.col("o_totalprice").alias("score"))
    return r.best_and_runner_up(o, "query", "ref", "score")


def calls(spark, sf_dir):
    meta = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query"), (F.col("c_acctbal") / 10000).alias("coverage"), ((F.col("c_custkey") % 100) / 100.0).alias("identity"))
    j = hits(spark, sf_dir).join(meta, "query", "left")
    return j.withColumn("reason", r.acceptance(F.col("best_ref"), F.col("coverage"), F.col("identity"), F.col("margin"), TARGETS))


@query(f"WITH {HITS_SQL} SELECT query, best_ref, best_score, runner_up_ref, runner_up_score, round(margin, 6) AS margin FROM best")
def best_hit_margin(spark, sf_dir):
    return rounded(hits(spark, sf_dir), "margin")


@query(f"WITH {CALLS_SQL} SELECT query, best_ref, round(coverage, 6) AS coverage, identity, round(margin, 6) AS margin, reason = 'ok' AS accepted, reason FROM calls")
def accept_reject_cascade(spark, sf_dir):
    c = calls(spark, sf_dir)
    return rounded(c.select("query", "best_ref", "coverage", "identity", "margin", (F.col("reason") == "ok").alias("accepted"), "reason"), "coverage", "margin")


@query(f"WITH {CALLS_SQL} SELECT reason, count(*) AS n FROM calls GROUP BY reason")
def rejection_histogram(spark, sf_dir):
    return calls(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""WITH {CALLS_SQL} SELECT best_ref, c_nationkey AS nation, query FROM (SELECT *, row_number() OVER (PARTITION BY best_ref, c_nationkey ORDER BY coverage DESC, c_name DESC, query) AS rn FROM calls JOIN customer ON query = c_custkey WHERE reason = 'ok') WHERE rn = 1""")
def one_per_entity(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query"), F.col("c_nationkey").alias("nation"), "c_name")
    j = calls(spark, sf_dir).filter("reason = 'ok'").join(c, "query")
    return r.best_per_key(j, ["best_ref", "nation"], [F.desc("coverage"), F.desc("c_name"), F.asc("query")], ["query"])


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def dedup_first(spark, sf_dir):
    """The first event of each user and type, by a combinable aggregate."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("m")).select("user_id", "event_type", F.col("m.event_id").alias("event_id"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_k_specific(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc_nulls_last("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS top_mean, max(o_totalprice) AS top_max, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 100 GROUP BY ALL")
def mean_top_k(spark, sf_dir):
    """Mean and maximum of each priority's 100 greatest orders; the limit is the statistic's own."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    top = table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice", "o_orderkey").withColumn("rn", F.row_number().over(w)).filter("rn <= 100")
    g = top.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("top_mean"), F.max("o_totalprice").alias("top_max"), F.count("*").alias("n"))
    return rounded(g, "top_mean", digits=4)


@query("SELECT p_partkey, round((rank() OVER (ORDER BY p_retailprice) - 1) * 1e0 / count(*) OVER (), 6) AS fraction_below FROM part")
def percentile_rank(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return rounded(fraction_below(p, "p_retailprice").select("p_partkey", "fraction_below"), "fraction_below")


@query("SELECT p_partkey, p_type, rank() OVER (PARTITION BY p_type ORDER BY p_size) + (count(*) OVER (PARTITION BY p_type, p_size) - 1) / 2e0 AS avg_rank FROM part")
def tie_average_rank(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    return average_rank(p, "p_size", ["p_type"]).select("p_partkey", "p_type", "avg_rank")


STRATA_SQL = """numbered AS (SELECT p_partkey, p_type, p_retailprice, p_size <= 10 AS flag, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS ra, row_number() OVER (ORDER BY p_size, p_partkey) AS rb, count(*) OVER () AS n FROM part),
  strata AS (SELECT p_partkey, p_retailprice, flag, least(2, (3 * (ra - 1)) // greatest(n - 1, 1)) AS price_bin, least(2, (3 * (rb - 1)) // greatest(n - 1, 1)) AS size_bin, p_type FROM numbered),
  named AS (SELECT *, concat_ws('|', p_type, price_bin, size_bin) AS stratum FROM strata)"""


def strata(spark, sf_dir):
    """Parts in strata of type x price tertile x size tertile, with a flag to compare."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_retailprice", "p_size")
    b = r.quantile_bins(r.quantile_bins(p, "p_retailprice", "p_partkey", name="price_bin"), "p_size", "p_partkey", name="size_bin")
    return b.withColumns({"stratum": F.concat_ws("|", "p_type", "price_bin", "size_bin"), "flag": F.col("p_size") <= 10})


@query(f"WITH {STRATA_SQL} SELECT p_partkey, CAST(price_bin AS INTEGER) AS price_bin, CAST(size_bin AS INTEGER) AS size_bin, stratum FROM named")
def tertile_strata(spark, sf_dir):
    return strata(spark, sf_dir).select("p_partkey", "price_bin", "size_bin", "stratum")


@query(f"WITH {STRATA_SQL} SELECT stratum, count(*) AS n, count(*) FILTER (flag) AS n_flagged FROM named GROUP BY stratum HAVING count(*) FILTER (flag) BETWEEN 1 AND count(*) - 1")
def usable_strata(spark, sf_dir):
    u = r.usable_strata(strata(spark, sf_dir), "stratum", "flag")
    return u.groupBy("stratum").agg(F.count("*").alias("n"), F.sum(F.col("flag").cast("long")).alias("n_flagged"))


P_SQL = "pv AS (SELECT p_partkey, p_type, CASE WHEN p_size % 10 = 0 THEN NULL ELSE ((p_partkey * 7919) % 1999 + 1) / 2000e0 * ((p_partkey * 31) % 97 + 1) / 97e0 END AS p FROM part)"


def pvalues(spark, sf_dir):
    """A p-value for each part, some null."""
    k = F.col("p_partkey")
    p = ((k * 7919) % 1999 + 1) / F.lit(2000.0) * ((k * 31) % 97 + 1) / F.lit(97.0)
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", F.when(F.col("p_size") % 10 == 0, None).otherwise(p).alias("p"))


def bh_sql(by: str) -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"""r AS (SELECT *, row_number() OVER ({part} ORDER BY p, p_partkey) AS rn, count(*) OVER ({part}) AS n FROM pv WHERE p IS NOT NULL),
    q AS (SELECT *, least(1e0, min(p * n / rn) OVER ({part} ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)"""


@query(f"WITH {P_SQL}, {bh_sql('')} SELECT p_partkey, round(q, 8) AS q_bh FROM q")
def bh_global(spark, sf_dir):
    p = pvalues(spark, sf_dir).filter("p is not null")
    return rounded(r.benjamini_hochberg(p, "p").select("p_partkey", "q_bh"), "q_bh", digits=8)


@query(f"WITH {P_SQL}, {bh_sql('p_type')} SELECT p_partkey, p_type, round(q, 8) AS q_bh, q < 0.05e0 AS significant FROM q")
def bh_within_variant(spark, sf_dir):
    p = pvalues(spark, sf_dir).filter("p is not null")
    q = r.benjamini_hochberg(p, "p", ["p_type"])
    return rounded(q.select("p_partkey", "p_type", "q_bh", (F.col("q_bh") < 0.05).alias("significant")), "q_bh", digits=8)


@query(f"WITH {P_SQL}, {bh_sql('')} SELECT pv.p_partkey, round(pv.p, 8) AS p, round(q, 8) AS q_bh FROM pv LEFT JOIN q USING (p_partkey)")
def bh_null_safe(spark, sf_dir):
    return rounded(r.benjamini_hochberg(pvalues(spark, sf_dir), "p").select("p_partkey", "p", "q_bh"), "p", "q_bh", digits=8)
