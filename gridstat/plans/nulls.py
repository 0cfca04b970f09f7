"""Permutation and bootstrap nulls on the driver's tables; SQL repeats those whose draws come of arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridstat.functions.ordered import by_keys
from gridstat.operators import association, resample
from gridstat.operators import matrix as m
from gridstat.operators import ranking as rk
from gridstat.sources.scratch import stash

from .inputs import ALIGNED_SQL, BACKGROUND_SQL, LETTERS, MODULES, MODULES_SQL, aligned, aligned_rows, aligned_scores, scores_sql
from .matrix import mi_sql
from .ranking import STRATA_SQL, strata
from .registry import query, rounded, table
from .testing import PARTS_SQL, arms

MOTIF = (3, 9, 14, 21)
#: Replicates of each null.
PERMUTATIONS, LEFT_OUT, POWER, MODULE_DRAWS, ROW_DRAWS, DELTA_DRAWS = 10_000, 2_000, 600, 2_000, 1_000, 5_000
SCORES_SQL = scores_sql(True, ALIGNED_SQL)


def draws_sql(pool: str, keys: str, value: str, n: int, size: str = "k") -> str:
    """CTE ``null_stats`` (keys, rep, stat): means of the ``size`` rows of least numbers of (keys, col_ix, value, size) in ``pool``."""
    return f"""dr AS (SELECT {keys}, rep, {value} AS v, {size} AS k_, row_number() OVER (PARTITION BY {keys}, rep ORDER BY {resample.number_sql('rep', 'col_ix')}, col_ix) AS rn FROM {pool}, range(0, {n}) AS r(rep)),
  null_stats AS (SELECT {keys}, avg(v) AS stat FROM dr WHERE rn <= k_ GROUP BY {keys}, rep)"""


def tail_sql(by: str, stat: str, how: str, centre: str = "0e0") -> str:
    """CTE ``tail`` from ``null_stats`` (by, stat) and ``obs`` (by, stat)."""
    using = f"USING ({by})" if by else "ON true"
    cols = f"{by}," if by else ""
    group = f"GROUP BY {by}" if by else ""
    hit = f"x.{stat} >= o.{stat} - 1e-9" if how == "greater" else f"abs(x.{stat} - {centre}) >= abs(o.{stat} - {centre}) - 1e-9"
    return f"""mom AS (SELECT {cols} avg({stat}) AS null_mean, stddev_pop({stat}) AS null_sd, max({stat}) AS null_max, count(*) AS n FROM null_stats {group}),
    tail AS (SELECT {cols} max(o.{stat}) AS observed, max(null_mean) AS null_mean, max(null_sd) AS null_sd, max(null_max) AS null_max,
      CASE WHEN max(null_sd) > 0 THEN (max(o.{stat}) - max(null_mean)) / max(null_sd) END AS z, (count(*) FILTER ({hit}) + 1e0) / (max(n) + 1) AS p
      FROM null_stats x JOIN obs o {using} JOIN mom {using} {group})"""


@query()
def perm_label_mi(spark, sf_dir):
    """Specificity of every column against labels permuted over all rows, with its rank among all tests; draws are of tables with the columns' margins."""
    joint = stash(m.symbol_counts(aligned(spark, sf_dir), ["grp"]), "joint")
    null = resample.permuted_information(joint, ["col_ix"], "symbol", "grp", PERMUTATIONS)
    t = resample.tail(null.drop("replicate"), m.mutual_information(joint, ["col_ix"]), ["col_ix"], "mi_bits", "greater")
    q = rk.benjamini_hochberg(stash(t.drop("z"), "tests"), "p")
    return rounded(q, "observed", "null_mean", "null_sd", "null_max")


STRATIFIED = 1_000
STRATIFIED_SQL = f"""{STRATA_SQL}, ok AS (SELECT stratum FROM named GROUP BY stratum HAVING count(*) FILTER (flag) BETWEEN 1 AND count(*) - 1),
  u AS (SELECT stratum, p_partkey, p_retailprice AS v, flag, row_number() OVER (PARTITION BY stratum ORDER BY p_partkey) AS pos FROM named WHERE stratum IN (SELECT stratum FROM ok)),
  n_ AS (SELECT stratum, count(*) FILTER (flag) AS k FROM u GROUP BY stratum), all_ AS (SELECT count(*) AS n, count(*) FILTER (flag) AS k, sum(v) AS t FROM u),
  sh AS (SELECT rep, stratum, v, row_number() OVER (PARTITION BY rep, stratum ORDER BY {resample.number_sql('rep', 'p_partkey')}, p_partkey) AS rn FROM u, range(0, {STRATIFIED}) AS r(rep)),
  null_stats AS (SELECT sum(v) / max(all_.k) - (max(t) - sum(v)) / (max(all_.n) - max(all_.k)) AS diff FROM sh JOIN n_ USING (stratum), all_ WHERE rn <= n_.k GROUP BY rep),
  obs AS (SELECT avg(v) FILTER (flag) - avg(v) FILTER (NOT flag) AS diff FROM u), {tail_sql('', 'diff', 'two_sided')}"""


@query(f"WITH {STRATIFIED_SQL} SELECT round(observed, 4) + 0e0 AS observed, round(null_mean, 4) + 0e0 AS null_mean, round(null_sd, 4) + 0e0 AS null_sd, round(z, 3) + 0e0 AS z, p FROM tail")
def perm_stratified(spark, sf_dir):
    """Difference of means against labels permuted within matched strata, two-sided about 0."""
    u = stash(rk.usable_strata(strata(spark, sf_dir), "stratum", "flag").select("stratum", "p_partkey", F.col("p_retailprice").alias("v"), "flag"), "strata")
    return _stratified(u, STRATIFIED)


@query()
def perm_stratified_full(spark, sf_dir):
    """The same with ten times as many replicates."""
    u = stash(rk.usable_strata(strata(spark, sf_dir), "stratum", "flag").select("stratum", "p_partkey", F.col("p_retailprice").alias("v"), "flag"), "strata")
    return _stratified(u, PERMUTATIONS)


def _stratified(u, n):
    diff = F.avg(F.when(F.col("flag"), F.col("v"))) - F.avg(F.when(~F.col("flag"), F.col("v")))
    whole = u.agg(F.count("*").alias("n"), F.sum(F.col("flag").cast("long")).alias("k"), F.sum("v").alias("t"))
    sums = resample.stratified_sums(u, "stratum", "p_partkey", "v", "flag", n).crossJoin(F.broadcast(whole))  # one row
    null = sums.select((F.col("flagged_sum") / F.col("k") - (F.col("t") - F.col("flagged_sum")) / (F.col("n") - F.col("k"))).alias("diff"))
    t = resample.tail(null, u.agg(diff.alias("diff")), [], "diff", "two_sided")
    return rounded(rounded(t.drop("null_max"), "observed", "null_mean", "null_sd", digits=4), "z", digits=3)


MOTIF_SQL = f"""{SCORES_SQL},
  motif AS (SELECT grp, avg(jsd) AS obs, count(*) AS k FROM scores WHERE col_ix IN {MOTIF} GROUP BY grp),
  pool AS (SELECT grp, col_ix, jsd FROM scores WHERE col_ix BETWEEN 8 AND 29 AND col_ix NOT IN {MOTIF}),
  centre AS (SELECT grp, avg(jsd) AS centre FROM pool GROUP BY grp),
  sized AS (SELECT pool.*, k FROM pool JOIN motif USING (grp)), {draws_sql('sized', 'grp', 'jsd', PERMUTATIONS)},
  obs AS (SELECT grp, obs AS stat, centre FROM motif JOIN centre USING (grp)), {tail_sql('grp', 'stat', 'two_sided', 'o.centre')}"""


@query(f"WITH {MOTIF_SQL} SELECT grp, round(observed, 6) AS observed, round(null_mean, 6) AS null_mean, round(null_sd, 6) AS null_sd, round(z, 4) + 0e0 AS z, p FROM tail")
def perm_subset_two_sided(spark, sf_dir):
    """A declared set of columns against size-matched draws of its domain's other columns, two-sided about their mean."""
    s = stash(aligned_scores(spark, sf_dir).select("grp", "col_ix", "jsd"), "scores")
    inside = F.col("col_ix").isin(*MOTIF)
    motif = s.filter(inside).groupBy("grp").agg(F.avg("jsd").alias("stat"), F.count("*").alias("k"))
    pool = s.filter(F.col("col_ix").between(8, 29) & ~inside)
    centre = pool.groupBy("grp").agg(F.avg("jsd").alias("centre"))
    null = resample.subset_means(by_keys(pool, motif.select("grp", "k"), ["grp"]), "col_ix", "jsd", "k", PERMUTATIONS, ["grp"])
    t = resample.tail(null, by_keys(motif, centre, ["grp"]), ["grp"], "stat", "two_sided", "centre")
    return rounded(rounded(t.drop("null_max"), "observed", "null_mean", "null_sd"), "z", digits=4)


DEFICIT_SQL = f"""{SCORES_SQL}, {MODULES_SQL},
  piv AS (SELECT col_ix, (max(jsd) FILTER (grp = '1') + max(jsd) FILTER (grp = '2')) / 2 - max(jsd) FILTER (grp = '0') AS d1,
    (max(jsd_residues) FILTER (grp = '1' AND gap_fraction < 1) + max(jsd_residues) FILTER (grp = '2' AND gap_fraction < 1)) / 2 - max(jsd_residues) FILTER (grp = '0' AND gap_fraction < 1) AS d2, max(gap_fraction) FILTER (grp = '0') AS gap FROM scores GROUP BY col_ix),
  vals AS (SELECT 'gap_penalised' AS variant, col_ix, d1 AS delta FROM piv WHERE d1 IS NOT NULL UNION ALL SELECT 'residues_only', col_ix, d2 FROM piv WHERE d2 IS NOT NULL UNION ALL SELECT 'contrast_occupied', col_ix, d2 FROM piv WHERE d2 IS NOT NULL AND gap < 0.5e0),
  inm AS (SELECT variant, module, avg(delta) FILTER (col_ix BETWEEN a AND b) AS stat, avg(delta) FILTER (col_ix NOT BETWEEN a AND b) AS other, count(*) FILTER (col_ix BETWEEN a AND b) AS k FROM vals, modules GROUP BY variant, module HAVING count(*) FILTER (col_ix BETWEEN a AND b) >= 3 AND count(*) > count(*) FILTER (col_ix BETWEEN a AND b)),
  sized AS (SELECT variant, module, col_ix, delta, k FROM vals JOIN inm USING (variant)), {draws_sql('sized', 'variant, module', 'delta', PERMUTATIONS)},
  obs AS (SELECT * FROM inm), {tail_sql('variant, module', 'stat', 'greater')},
  full_t AS (SELECT tail.*, inm.k, inm.other FROM tail JOIN inm USING (variant, module)),
  rnk AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY p, module) AS rn, count(*) OVER (PARTITION BY variant) AS nn FROM full_t),
  q AS (SELECT *, least(1e0, min(p * nn / rn) OVER (PARTITION BY variant ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)) AS q FROM rnk)"""


@query(f"WITH {DEFICIT_SQL} SELECT variant, module, k AS n_columns, round(observed, 6) + 0e0 AS mean_delta, round(other, 6) + 0e0 AS mean_delta_other_columns, round(null_mean, 6) + 0e0 AS null_mean, round(null_sd, 6) AS null_sd, round(z, 4) + 0e0 AS z, round(p, 8) AS p_perm, round(q, 8) AS q_bh, q < 0.05e0 AS significant_q05 FROM q")
def perm_deficit_three_variants(spark, sf_dir):
    """Is a module's deficit in one scope greater than that of random columns?  Three readings of the score, corrected within each."""
    s = aligned_scores(spark, sf_dir).withColumn("jr", F.when(F.col("gap_fraction") < 1, F.col("jsd_residues")))
    w = s.groupBy("col_ix").pivot("grp", ["0", "1", "2"]).agg(F.max("jsd").alias("j"), F.max("jr").alias("r"), F.max("gap_fraction").alias("g"))
    d1, d2 = (F.col("1_j") + F.col("2_j")) / 2 - F.col("0_j"), (F.col("1_r") + F.col("2_r")) / 2 - F.col("0_r")
    both = [("gap_penalised", d1, F.lit(True)), ("residues_only", d2, F.lit(True)), ("contrast_occupied", d2, F.col("0_g") < 0.5)]
    vals = stash(w.select("col_ix", F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), F.when(ok, d).alias("delta")) for n, d, ok in both))).alias("v")).select("col_ix", "v.variant", "v.delta").filter("delta is not null"), "deltas")
    modules = F.broadcast(spark.createDataFrame(MODULES, "module string, a int, b int"))  # three rows
    each = vals.crossJoin(modules).withColumn("inside", F.col("col_ix").between(F.col("a"), F.col("b")))
    obs = each.groupBy("variant", "module").agg(F.avg(F.when(F.col("inside"), F.col("delta"))).alias("stat"), F.avg(F.when(~F.col("inside"), F.col("delta"))).alias("mean_delta_other_columns"), F.sum(F.col("inside").cast("long")).alias("n_columns"), F.count("*").alias("n"))
    obs = obs.filter("n_columns >= 3 and n > n_columns")
    pool = each.join(obs.select("variant", "module", "n_columns"), ["variant", "module"]).select("variant", "module", "col_ix", "delta", "n_columns")
    null = resample.subset_means(pool, "col_ix", "delta", "n_columns", PERMUTATIONS, ["variant", "module"])
    t = resample.tail(stash(null, "null"), obs, ["variant", "module"], "stat", "greater").join(obs.select("variant", "module", "n_columns", "mean_delta_other_columns"), ["variant", "module"])
    t = stash(t, "tests")
    q = rk.benjamini_hochberg(t.withColumnRenamed("p", "p_perm"), "p_perm", ["variant"]).withColumn("significant_q05", F.col("q_bh") < 0.05)
    out = q.select("variant", "module", "n_columns", F.col("observed").alias("mean_delta"), "mean_delta_other_columns", "null_mean", "null_sd", "z", "p_perm", "q_bh", "significant_q05")
    return rounded(rounded(rounded(out, "mean_delta", "mean_delta_other_columns", "null_mean", "null_sd"), "z", digits=4), "p_perm", "q_bh", digits=8)


def boot_sql(source: str, by: str, key: str, n: int, pick: str | None = None) -> str:
    """CTE ``drawn``: rows of ``source`` with a replicate, drawn with replacement."""
    return f"""num AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {key}) AS pos, count(*) OVER (PARTITION BY {by}) AS n FROM {source}),
    pick AS (SELECT {by}, rep, {pick or resample.number_sql('rep', 'pos')} % n + 1 AS pos FROM num, range(0, {n}) AS r(rep)),
    drawn AS (SELECT pick.rep, num.* FROM pick JOIN num USING ({by}, pos))"""


@query(f"WITH {SCORES_SQL}, {MODULES_SQL}, src AS (SELECT grp, module, col_ix, jsd FROM scores JOIN modules ON col_ix BETWEEN a AND b), {boot_sql('src', 'grp, module', 'col_ix', MODULE_DRAWS)}, st AS (SELECT grp, module, avg(jsd) AS s FROM drawn GROUP BY grp, module, rep) SELECT st.grp, st.module, round(quantile_cont(s, 0.025), 6) AS ci_low, round(quantile_cont(s, 0.975), 6) AS ci_high, count(*) AS n FROM st GROUP BY ALL")
def bootstrap_ci(spark, sf_dir):
    """Interval of a module's mean score, columns drawn with replacement."""
    modules = F.broadcast(spark.createDataFrame(MODULES, "module string, a int, b int"))
    s = stash(aligned_scores(spark, sf_dir).select("grp", "col_ix", "jsd").crossJoin(modules).filter("col_ix between a and b").select("grp", "module", "col_ix", "jsd"), "scores")
    st = resample.bootstrap_means(s, "col_ix", "jsd", MODULE_DRAWS, ["grp", "module"]).withColumnRenamed("stat", "s")
    return rounded(st.groupBy("grp", "module").agg(F.percentile("s", 0.025).alias("ci_low"), F.percentile("s", 0.975).alias("ci_high"), F.count("*").alias("n")), "ci_low", "ci_high")


@query()
def bootstrap_rows_ci(spark, sf_dir):
    """Intervals of every column's divergence, rows drawn with replacement and carrying their position-based weights."""
    return rounded(row_intervals(spark, sf_dir), "jsd", "ci_low", "ci_high")


def row_intervals(spark, sf_dir, n: int = ROW_DRAWS):
    x = aligned(spark, sf_dir)
    weights = stash(m.henikoff_weights(x, ["grp"]), "weights")
    packed = by_keys(aligned_rows(spark, sf_dir), weights, ["grp", "row_id"])
    counts = m.symbol_counts(by_keys(x, weights, ["grp", "row_id"]), ["grp"], "weight")
    background = stash(m.pooled_background(counts), "background")
    drawn = resample.bootstrap_divergence(packed, ["grp"], n, background)
    ci = drawn.groupBy("grp", "col_ix").agg(F.percentile("jsd", 0.025).alias("ci_low"), F.percentile("jsd", 0.975).alias("ci_high"))
    return m.column_constraint(counts, background, ["grp"], LETTERS).select("grp", "col_ix", "jsd").transform(by_keys, ci, ["grp", "col_ix"])


@query(f"""WITH {PARTS_SQL}, num AS (SELECT p_type, arm, v, row_number() OVER (PARTITION BY p_type, arm ORDER BY v) AS pos, count(*) OVER (PARTITION BY p_type, arm) AS n FROM d),
  pick AS (SELECT p_type, arm, rep, {resample.number_sql('rep', '(2 * pos + CAST(arm AS BIGINT))')} % n + 1 AS pos FROM num, range(0, {DELTA_DRAWS}) AS r(rep)),
  c AS (SELECT p_type, rep, v, count(*) FILTER (arm) AS a, count(*) FILTER (NOT arm) AS b FROM pick JOIN num USING (p_type, arm, pos) GROUP BY ALL),
  less AS (SELECT p_type, rep, a, b, sum(b) OVER (PARTITION BY p_type, rep ORDER BY v) - b AS before FROM c),
  dl AS (SELECT p_type, rep, sum(a * (2 * before + b)) * 1e0 / (sum(a) * sum(b)) - 1e0 AS d FROM less GROUP BY p_type, rep)
  SELECT p_type, round(quantile_cont(d, 0.025), 6) + 0e0 AS ci_low, round(quantile_cont(d, 0.975), 6) + 0e0 AS ci_high FROM dl GROUP BY p_type""")
def bootstrap_delta(spark, sf_dir):
    """Interval of Cliff's delta, each arm drawn on its own."""
    d = resample.bootstrap_deltas(arms(spark, sf_dir), "v", "arm", DELTA_DRAWS, ["p_type"])
    return rounded(d.groupBy("p_type").agg(F.percentile("cliffs_delta", 0.025).alias("ci_low"), F.percentile("cliffs_delta", 0.975).alias("ci_high")), "ci_low", "ci_high")


SETS = [("1", "1"), ("1", "1+2"), ("2", "1+2"), ("2", "2")]
LOO_SQL = f"""{ALIGNED_SQL}, sets AS (SELECT * FROM (VALUES ('1', '1', 'binder'), ('1', '1+2', 'binder'), ('2', '1+2', 'binder'), ('2', '2', 'binder'), ('0', '1', 'other'), ('0', '1+2', 'other'), ('0', '2', 'other')) AS t(lang, included, role)),
  joint AS (SELECT included, col_ix, symbol, role AS grp, count(*) * 1e0 AS w FROM cells JOIN sets ON cells.grp = sets.lang GROUP BY ALL), {mi_sql('joint', 'included, col_ix')},
  pool AS (SELECT * FROM mi WHERE col_ix NOT BETWEEN 0 AND 9), inm AS (SELECT included, avg(mi_bits) AS stat, count(*) AS k FROM mi WHERE col_ix BETWEEN 0 AND 9 GROUP BY included), centre AS (SELECT included, avg(mi_bits) AS centre FROM pool GROUP BY included),
  sized AS (SELECT pool.*, k FROM pool JOIN inm USING (included)), {draws_sql('sized', 'included', 'mi_bits', LEFT_OUT)}, obs AS (SELECT included, stat, centre FROM inm JOIN centre USING (included)), {tail_sql('included', 'stat', 'two_sided', 'o.centre')}"""


@query(f"WITH {LOO_SQL} SELECT included, round(observed, 6) AS observed, round(centre, 6) AS control_mean, round(observed / centre, 4) AS fold, round(z, 4) + 0e0 AS z, p FROM tail JOIN centre USING (included)")
def leave_one_group_out(spark, sf_dir):
    """A module's specificity with each of the pooled groups left out in turn."""
    rows = [(g, s, "binder") for g, s in SETS] + [("0", s, "other") for s in ("1", "1+2", "2")]
    sets = F.broadcast(spark.createDataFrame(rows, "grp string, included string, role string"))
    joint = aligned(spark, sf_dir).join(sets, "grp").groupBy("included", "col_ix", "symbol", "role").agg(F.count("*").cast("double").alias("w"))
    mi = stash(m.mutual_information(joint, ["included", "col_ix"], "symbol", "role"), "mi")
    inside = F.col("col_ix").between(0, 9)
    obs = mi.filter(inside).groupBy("included").agg(F.avg("mi_bits").alias("stat"), F.count("*").alias("k"))
    pool = mi.filter(~inside)
    centre = pool.groupBy("included").agg(F.avg("mi_bits").alias("centre"))
    null = resample.subset_means(pool.join(obs.select("included", "k"), "included"), "col_ix", "mi_bits", "k", LEFT_OUT, ["included"])
    t = resample.tail(null, obs.join(centre, "included"), ["included"], "stat", "two_sided", "centre").join(centre, "included")
    out = t.select("included", "observed", F.col("centre").alias("control_mean"), (F.col("observed") / F.col("centre")).alias("fold"), "z", "p")
    return rounded(rounded(out, "observed", "control_mean"), "fold", "z", digits=4)


POWER_SQL = f"""{SCORES_SQL}, sd AS (SELECT grp, avg(jsd) AS mu, stddev_pop(jsd) AS sd FROM scores GROUP BY grp), shifts AS (SELECT * FROM (VALUES (0e0), (0.5e0), (1e0), (2e0)) AS t(shift)),
  {draws_sql('scores', 'grp', 'jsd', POWER, '8')}, st AS (SELECT grp, stat AS s FROM null_stats)
  SELECT grp, shift, round(count(*) FILTER (abs(s + shift * sd - mu) / (sd / sqrt(8e0) * sqrt(56e0 / 63e0)) >= 1.959964e0 - 1e-9) / (count(*) * 1e0), 6) + 0e0 AS power FROM st JOIN sd USING (grp), shifts GROUP BY grp, shift"""


@query(f"WITH {POWER_SQL}")
def power_curve(spark, sf_dir):
    """How often a shift of so many standard deviations of 8 random columns is found at the 5 % level."""
    s = stash(aligned_scores(spark, sf_dir).select("grp", "col_ix", "jsd"), "scores")
    sd = s.groupBy("grp").agg(F.avg("jsd").alias("mu"), F.stddev_pop("jsd").alias("sd"), F.count("*").alias("n"))
    st = resample.subset_means(s.withColumn("k", F.lit(8)), "col_ix", "jsd", "k", POWER, ["grp"]).withColumnRenamed("stat", "s").transform(by_keys, sd, ["grp"])
    st = st.withColumn("shift", F.explode(F.array(*(F.lit(x) for x in (0.0, 0.5, 1.0, 2.0)))))
    # the draw is without replacement from n columns
    error = F.col("sd") / F.sqrt(F.lit(8.0)) * F.sqrt((F.col("n") - 8.0) / (F.col("n") - 1.0))
    found = F.abs(F.col("s") + F.col("shift") * F.col("sd") - F.col("mu")) / error >= association.Z95 - 1e-9
    return rounded(st.groupBy("grp", "shift").agg((F.sum(found.cast("long")) / F.count("*")).alias("power")), "power")
