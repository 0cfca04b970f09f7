"""Two-sample tests, correlations, intervals and pooling on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridstat.functions import lattice
from gridstat.operators import association as a
from gridstat.sources.scratch import stash

from .inputs import scores, scores_sql
from .registry import query, rounded, table

#: Price of small against other parts, by type.
PARTS_SQL = "d AS (SELECT p_type, p_retailprice AS v, p_size <= 10 AS arm FROM part)"
U_SQL = f"""{PARTS_SQL}, r AS (SELECT *, rank() OVER (PARTITION BY p_type ORDER BY v) + (count(*) OVER (PARTITION BY p_type, v) - 1) / 2e0 AS rk, count(*) OVER (PARTITION BY p_type, v) AS t FROM d),
  u AS (SELECT p_type, count(*) FILTER (arm) AS n_a, count(*) FILTER (NOT arm) AS n_b, sum(rk) FILTER (arm) - count(*) FILTER (arm) * (count(*) FILTER (arm) + 1) / 2e0 AS u, sum((t * t - 1) * 1e0) AS tie FROM r GROUP BY p_type)"""
DELTA_SQL = f"{U_SQL}, delta AS (SELECT p_type, n_a, n_b, 2e0 * u / (n_a * n_b) - 1e0 AS d FROM u)"


def arms(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_type", F.col("p_retailprice").alias("v"), (F.col("p_size") <= 10).alias("arm"))


@query(f"WITH {DELTA_SQL} SELECT p_type, n_a, n_b, round(d, 8) AS cliffs_delta FROM delta")
def cliffs_delta(spark, sf_dir):
    return rounded(a.cliffs_delta(arms(spark, sf_dir), "v", "arm", ["p_type"]), "cliffs_delta", digits=8)


@query(f"WITH {U_SQL} SELECT p_type, n_a, n_b, u, round(greatest(abs(u - n_a * n_b / 2e0) - 0.5e0, 0e0) / sqrt(n_a * n_b / 12e0 * ((n_a + n_b + 1) - tie / ((n_a + n_b) * (n_a + n_b - 1e0)))) * sign(u - n_a * n_b / 2e0), 6) + 0e0 AS z FROM u")
def mann_whitney_u(spark, sf_dir):
    return rounded(a.mann_whitney(arms(spark, sf_dir), "v", "arm", ["p_type"]), "z")


@query(f"""WITH {PARTS_SQL}, g AS (SELECT p_type, v, count(*) FILTER (arm) AS a, count(*) FILTER (NOT arm) AS b FROM d GROUP BY ALL),
  c AS (SELECT p_type, sum(a) OVER w AS ca, sum(b) OVER w AS cb, sum(a) OVER (PARTITION BY p_type) AS na, sum(b) OVER (PARTITION BY p_type) AS nb FROM g WINDOW w AS (PARTITION BY p_type ORDER BY v))
  SELECT p_type, CAST(max(na) AS BIGINT) AS n_a, CAST(max(nb) AS BIGINT) AS n_b, round(max(abs(ca / na - cb / nb)), 8) AS ks FROM c GROUP BY p_type""")
def ks_statistic(spark, sf_dir):
    return rounded(a.ks_statistic(arms(spark, sf_dir), "v", "arm", ["p_type"]), "ks", digits=8)


#: Paths that stay within the distance, and rank sums, counted step by step; a row of ``lat`` is a place that paths reach.
EXACT_SQL = f"""WITH RECURSIVE {U_SQL}, g AS (SELECT p_type, v, count(*) FILTER (arm) AS a, count(*) FILTER (NOT arm) AS b FROM d GROUP BY ALL),
  c AS (SELECT p_type, sum(a) OVER w AS ca, sum(b) OVER w AS cb FROM g WINDOW w AS (PARTITION BY p_type ORDER BY v)),
  h AS (SELECT u.p_type, n_a, n_b, u, tie, max(abs(ca * n_b - cb * n_a)) AS h FROM c JOIN u ON u.p_type = c.p_type WHERE n_a > 0 AND n_b > 0 GROUP BY ALL),
  lat(p_type, s, i, n_a, n_b, h, ways) AS (SELECT p_type, 0, 0, n_a, n_b, h, 1e0 FROM h UNION ALL
    SELECT p_type, s + 1, i + up AS i, n_a, n_b, h, sum(ways * CASE WHEN up = 1 THEN n_a - i ELSE n_b - (s - i) END / (n_a + n_b - s)) FROM lat, (VALUES (0), (1)) AS t(up)
    WHERE i + up <= n_a AND s + 1 - i - up <= n_b AND abs((i + up) * n_b - (s + 1 - i - up) * n_a) < h GROUP BY p_type, s, i + up, n_a, n_b, h),
  sums(p_type, s, i, area, n_a, n_b, ways) AS (SELECT p_type, 0, 0, 0, n_a, n_b, 1e0 FROM h WHERE least(n_a, n_b) <= 8 AND tie = 0 UNION ALL
    SELECT p_type, s + 1, i + up AS i, area + up * (s - i) AS area, n_a, n_b, sum(ways * CASE WHEN up = 1 THEN n_a - i ELSE n_b - (s - i) END / (n_a + n_b - s)) FROM sums, (VALUES (0), (1)) AS t(up)
    WHERE i + up <= n_a AND s + 1 - i - up <= n_b GROUP BY p_type, s, i + up, area + up * (s - i), n_a, n_b),
  inside AS (SELECT p_type, sum(ways) AS q FROM lat WHERE s = n_a + n_b GROUP BY p_type),
  tail AS (SELECT sums.p_type, least(1e0, 2 * sum(ways)) AS p FROM sums JOIN h ON h.p_type = sums.p_type WHERE s = sums.n_a + sums.n_b AND area >= greatest(u, h.n_a * h.n_b - u) GROUP BY sums.p_type)
  SELECT h.p_type, n_a, n_b, round(1e0 - coalesce(q, 0e0), 8) + 0e0 AS ks_p, round(tail.p, 8) + 0e0 AS u_p FROM h LEFT JOIN inside ON inside.p_type = h.p_type LEFT JOIN tail ON tail.p_type = h.p_type"""


@query(EXACT_SQL)
def exact_tests(spark, sf_dir):
    """Exact p of both two-sample tests; that of U where an arm has at most 8 values and none are tied."""
    x = stash(arms(spark, sf_dir), "arms")
    u = a.mann_whitney(x, "v", "arm", ["p_type"], ties=True).filter("n_a > 0 and n_b > 0")
    few = (F.least("n_a", "n_b") <= lattice.SUMS) & (F.col("tie") == 0)
    ks = a.ks_statistic(x, "v", "arm", ["p_type"]).select("p_type", "ks")
    t = u.join(ks, "p_type").select("p_type", "n_a", "n_b", a.kolmogorov_p("ks", "n_a", "n_b").alias("ks_p"), F.when(few, a.mann_whitney_p("u", "n_a", "n_b", "z", "tie")).alias("u_p"))
    return rounded(t, "ks_p", "u_p", digits=8)


@query("""WITH n AS (SELECT lang, count(*) * 1e0 AS n, count(*) FILTER (quality = 1) AS k FROM documents JOIN labels USING (doc_id) GROUP BY lang), z AS (SELECT *, k / n AS p, 1.959964e0 AS z FROM n)
  SELECT lang, CAST(n AS BIGINT) AS n, k, round(p, 6) AS share, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) + 0e0 AS ci_low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS ci_high FROM z""")
def wilson_interval(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    g = j.groupBy("lang").agg(F.count("*").alias("n"), F.sum((F.col("quality") == 1).cast("long")).alias("k"))
    low, high = a.wilson(F.col("k"), F.col("n"))
    return rounded(g.select("lang", "n", "k", (F.col("k") / F.col("n")).alias("share"), low.alias("ci_low"), high.alias("ci_high")), "share", "ci_low", "ci_high")


def profile_pairs(spark, sf_dir):
    """Every pair of scopes' profiles, column by column; ties are decided on rounded scores."""
    s = scores(spark, sf_dir, ["grp"]).select("grp", "col_ix", F.round("jsd", 9).alias("jsd"))
    x, y = s.select(F.col("grp").alias("a"), "col_ix", F.col("jsd").alias("x")), s.select(F.col("grp").alias("b"), "col_ix", F.col("jsd").alias("y"))
    return stash(x.join(y, "col_ix").filter("a < b"), "pairs")


PAIRS_SQL = f"WITH {scores_sql(True)}, s AS (SELECT grp, col_ix, round(jsd, 9) AS jsd FROM scores), p AS (SELECT x.grp AS a, y.grp AS b, x.jsd AS x, y.jsd AS y FROM s x JOIN s y ON x.col_ix = y.col_ix AND x.grp < y.grp)"


@query(f"{PAIRS_SQL}, r AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2e0 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2e0 AS ry FROM p) SELECT a, b, count(*) AS n, round(corr(rx, ry), 6) + 0e0 AS rho FROM r GROUP BY a, b")
def spearman_concordance(spark, sf_dir):
    return rounded(a.spearman(profile_pairs(spark, sf_dir), "x", "y", ["a", "b"]), "rho")


@query(f"{PAIRS_SQL} SELECT a, b, count(*) AS n, round(corr(x, y), 6) + 0e0 AS r FROM p GROUP BY a, b")
def pearson_concordance(spark, sf_dir):
    return rounded(a.pearson(profile_pairs(spark, sf_dir), "x", "y", ["a", "b"]), "r")


@query(f"""WITH {DELTA_SQL}, t AS (SELECT split_part(p_type, ' ', 1) AS half, d AS e, d - 1.96e0 * sqrt((n_a + n_b + 1) / (3e0 * n_a * n_b)) AS lo, d + 1.96e0 * sqrt((n_a + n_b + 1) / (3e0 * n_a * n_b)) AS hi FROM delta),
  w AS (SELECT half, e, 1e0 / (((hi - lo) / (2 * 1.959964e0)) ** 2) AS w FROM t),
  m AS (SELECT 'all' AS model, * FROM w UNION ALL SELECT 'only_' || half AS model, * FROM w),
  g AS (SELECT model, count(*) AS n_tests, sum(w) AS sw, sum(w * e) AS swe, sum(w * e * e) AS swee FROM m GROUP BY model)
  SELECT model, n_tests, round(swe / sw, 6) + 0e0 AS pooled, round(swe / sw - 1.959964e0 / sqrt(sw), 6) + 0e0 AS ci_low, round(swe / sw + 1.959964e0 / sqrt(sw), 6) + 0e0 AS ci_high, round(swe / sw * sqrt(sw), 5) + 0e0 AS z,
    CASE WHEN model = 'all' THEN round(greatest(swee - swe * swe / sw, 0e0), 5) + 0e0 END AS cochran_q,
    CASE WHEN model = 'all' THEN round(greatest(0e0, 1e0 - (n_tests - 1) / greatest(swee - swe * swe / sw, 1e-300)), 5) + 0e0 END AS i_squared FROM g""")
def meta_fixed_effect(spark, sf_dir):
    """The types' effects pooled, all together and by the first word of the type."""
    d = a.cliffs_delta(arms(spark, sf_dir), "v", "arm", ["p_type"])
    half = 1.96 * F.sqrt((F.col("n_a") + F.col("n_b") + 1) / (3.0 * F.col("n_a") * F.col("n_b")))
    t = d.select(F.substring_index("p_type", " ", 1).alias("half"), "cliffs_delta", (F.col("cliffs_delta") - half).alias("lo"), (F.col("cliffs_delta") + half).alias("hi"))
    return rounded(rounded(a.fixed_effect(t, "cliffs_delta", "lo", "hi", "half"), "pooled", "ci_low", "ci_high"), "z", "cochran_q", "i_squared", digits=5)
