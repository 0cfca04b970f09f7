"""Whole records and tests, made of the operators, and unions, sets and guards on the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstat.functions.ordered import by_keys
from gridstat.operators import association, families, mapping, resample
from gridstat.operators import matrix as m
from gridstat.operators import ranking as rk
from gridstat.sources.scratch import stash

from .inputs import LETTERS, MODULES, aligned, aligned_rows, aligned_scores, cells_sql, rows, scores_sql
from .nulls import DELTA_DRAWS, PERMUTATIONS, SCORES_SQL, draws_sql, row_intervals, tail_sql
from .ranking import strata
from .registry import query, rounded, table
from .testing import arms, profile_pairs

LEAST_ROWS, LEAST_ARM = 20, 5


@query()
def specificity_table(spark, sf_dir):
    """Per column: mutual information with the label, its null and q-value, contrast between groups, and every group's consensus."""
    x = aligned(spark, sf_dir)
    counts = stash(m.symbol_counts(x, ["grp"]), "counts")
    null = resample.permuted_information(counts, ["col_ix"], "symbol", "grp", PERMUTATIONS).drop("replicate")
    t = resample.tail(null, m.mutual_information(counts, ["col_ix"]), ["col_ix"], "mi_bits", "greater").withColumnRenamed("observed", "mi_bits")
    q = rk.benjamini_hochberg(stash(t, "tests"), "p")
    contrast = m.group_contrast(counts, m.pooled_background(counts), "grp", [], LETTERS, "A")
    consensus = m.consensus_residue(counts, ["grp"], "A").groupBy("col_ix").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("grp", "consensus")))).alias("consensus"))
    out = q.join(contrast, "col_ix").join(consensus, "col_ix").withColumn("consensus", F.to_json("consensus"))
    return rounded(out, "mi_bits", "null_mean", "null_sd", "null_max", "z", "p", "q_bh", "within_group_conservation", "min_within_group_conservation", "contrast")


@query()
def constraint_record(spark, sf_dir):
    """Per group of at least 20 rows and column: weighted scores with their interval, raw and weighted gaps, sizes, and the intervals that hold the column."""
    x = families.large_enough(aligned(spark, sf_dir), ["grp", "col_ix"], LEAST_ROWS)
    w = stash(m.henikoff_weights(x, ["grp"]), "weights")
    weighted = by_keys(x, w, ["grp", "row_id"])
    counts = m.symbol_counts(weighted, ["grp"], "weight")
    scores = m.column_constraint(counts, m.pooled_background(counts), ["grp"], LETTERS).drop("jsd")
    ci, sizes = row_intervals(spark, sf_dir), m.kish(w, ["grp"])
    raw = m.gap_fraction(x, ["grp"]).withColumnRenamed("gap_fraction", "gap_raw")
    out = by_keys(by_keys(by_keys(scores, ci, ["grp", "col_ix"]), raw, ["grp", "col_ix"]), sizes, ["grp"])
    out = mapping.column_features(out, MODULES).withColumn("features", F.array_join("features", ";")).drop("occupied", "jsd_residues")
    return rounded(out, "entropy_bits", "conservation_norm", "gap_fraction", "gap_raw", "jsd", "ci_low", "ci_high", "kish_neff")


@query()
def two_sample_tests(spark, sf_dir):
    """Cliff's delta, Mann-Whitney and Kolmogorov-Smirnov of both arms, with their p-values."""
    return rounded(_two_samples(arms(spark, sf_dir), "v", "arm", ["p_type"]), "cliffs_delta", "z", "u_p", "ks", "ks_p", digits=8)


def _two_samples(df: DataFrame, value: str, arm: str, by: list[str]) -> DataFrame:
    u = association.mann_whitney(df, value, arm, by, ties=True).withColumn("u_p", association.mann_whitney_p("u", "n_a", "n_b", "z", "tie")).drop("tie")
    ks = association.ks_statistic(df, value, arm, by).withColumn("ks_p", association.kolmogorov_p("ks", "n_a", "n_b")).drop("n_a", "n_b")
    d = association.cliffs_delta(df, value, arm, by).drop("n_a", "n_b")
    return by_keys(by_keys(d, u, by), ks, by)


@query()
def matched_control(spark, sf_dir):
    """Parts of a size against matched ones of the same type and tertiles: effect with its interval, three tests and q-values over the types."""
    u = rk.usable_strata(strata(spark, sf_dir), "stratum", "flag").select("p_type", "stratum", "p_partkey", F.col("p_retailprice").alias("v"), "flag")
    u = stash(families.large_enough(families.large_enough(u, ["p_type"], LEAST_ARM, F.col("flag")), ["p_type"], LEAST_ARM, ~F.col("flag")), "matched")
    tests = _two_samples(u, "v", "flag", ["p_type"])
    whole = u.groupBy("p_type").agg(F.count("*").alias("n"), F.sum(F.col("flag").cast("long")).alias("k"), F.sum("v").alias("t"), F.count_distinct("stratum").alias("n_strata"), F.avg(F.when(F.col("flag"), F.col("v"))).alias("mean_flagged"), F.avg(F.when(~F.col("flag"), F.col("v"))).alias("mean_control"))
    null = by_keys(resample.stratified_sums(u, "stratum", "p_partkey", "v", "flag", PERMUTATIONS, by=["p_type"]), whole, ["p_type"])
    null = null.select("p_type", (F.col("flagged_sum") / F.col("k") - (F.col("t") - F.col("flagged_sum")) / (F.col("n") - F.col("k"))).alias("difference"))
    observed = whole.select("p_type", (F.col("mean_flagged") - F.col("mean_control")).alias("difference"))
    p = resample.tail(stash(null, "null"), observed, ["p_type"], "difference", "two_sided").select("p_type", F.col("observed").alias("difference"), F.col("p").alias("permutation_p"))
    boot = resample.bootstrap_deltas(u, "v", "flag", DELTA_DRAWS, ["p_type"])
    ci = boot.groupBy("p_type").agg(F.percentile("cliffs_delta", 0.025).alias("delta_ci_low"), F.percentile("cliffs_delta", 0.975).alias("delta_ci_high"))
    joined = reduce(lambda a, b: by_keys(a, b, ["p_type"]), [whole.drop("n", "k", "t"), p, ci], tests)
    q = rk.benjamini_hochberg(stash(joined, "tests"), "permutation_p").withColumn("significant_q05", F.col("q_bh") < 0.05)
    return rounded(q, "cliffs_delta", "z", "u_p", "ks", "ks_p", "mean_flagged", "mean_control", "difference", "permutation_p", "delta_ci_low", "delta_ci_high", "q_bh")


MOTIFS = [("inner", 8, 29, (9, 14, 21)), ("wide", 0, 9, (0, 2, 3, 5, 7, 9)), ("end", 30, 39, (31, 35)), ("open", 0, 63, (1, 33, 60))]
MOTIF_ROWS = ", ".join(f"('{n}', {a}, {b}, {c})" for n, a, b, cs in MOTIFS for c in cs)


@query(f"""WITH {SCORES_SQL}, members AS (SELECT * FROM (VALUES {MOTIF_ROWS}) AS t(motif, a, b, c)), motifs AS (SELECT motif, max(a) AS a, max(b) AS b, count(*) AS k FROM members GROUP BY motif),
  one AS (SELECT col_ix, jsd FROM scores WHERE grp = '0'), inside AS (SELECT motif, avg(jsd) AS stat, count(*) AS k FROM members JOIN one ON c = col_ix GROUP BY motif),
  block AS (SELECT motif, a, b, one.* FROM motifs, one WHERE NOT EXISTS (SELECT 1 FROM members WHERE members.motif = motifs.motif AND c = col_ix)),
  few AS (SELECT motif, count(*) FILTER (col_ix BETWEEN a AND b) < max(k) + 2 AS few FROM block JOIN inside USING (motif) GROUP BY motif),
  pool AS (SELECT motif, col_ix, jsd, k, few FROM block JOIN few USING (motif) JOIN inside USING (motif) WHERE few OR col_ix BETWEEN a AND b), centre AS (SELECT motif, avg(jsd) AS centre, count(*) AS n_control_columns FROM pool GROUP BY motif),
  {draws_sql('pool', 'motif', 'jsd', PERMUTATIONS)}, obs AS (SELECT motif, stat, centre FROM inside JOIN centre USING (motif)), {tail_sql('motif', 'stat', 'two_sided', 'o.centre')},
  r AS (SELECT motif, observed, z, p, few, n_control_columns, row_number() OVER (ORDER BY p, motif) AS rn, count(*) OVER () AS nn FROM tail JOIN few USING (motif) JOIN centre USING (motif))
  SELECT motif, CASE WHEN few THEN 'whole_block' ELSE 'domain' END AS pool_used, n_control_columns, round(observed, 6) AS observed, round(z, 4) + 0e0 AS z, round(p, 8) AS p, round(least(1e0, min(p * nn / rn) OVER (ORDER BY rn DESC ROWS UNBOUNDED PRECEDING)), 8) AS q_bh FROM r""")
def motif_family(spark, sf_dir):
    """Declared sets of columns against draws of their domain's other columns, or of the whole block where that has too few; corrected over the sets."""
    s = stash(aligned_scores(spark, sf_dir).filter("grp = '0'").select("col_ix", "jsd"), "scores")
    sets = spark.createDataFrame([(n, a, b, list(c)) for n, a, b, c in MOTIFS], "motif string, a int, b int, columns array<int>")
    each = sets.join(s, F.lit(True), "inner")  # columns for each of the few sets
    member = F.array_contains("columns", F.col("col_ix"))
    inside = stash(each.filter(member).groupBy("motif").agg(F.avg("jsd").alias("stat"), F.count("*").alias("k")).withColumn("need", F.col("k") + 2), "inside")
    block = each.filter(~member).select("motif", "col_ix", "jsd", "a", "b")
    pool = stash(families.with_fallback(block.filter(F.col("col_ix").between(F.col("a"), F.col("b"))), block, inside, ["motif"], "need"), "pool")
    facts = pool.groupBy("motif").agg(F.avg("jsd").alias("centre"), F.max("n_pool").alias("n_control_columns"), F.when(F.max("fell_back"), "whole_block").otherwise("domain").alias("pool_used"))
    null = resample.subset_means(pool.join(inside.select("motif", "k"), "motif"), "col_ix", "jsd", "k", PERMUTATIONS, ["motif"])
    t = resample.tail(null, inside.join(facts, "motif"), ["motif"], "stat", "two_sided", "centre").join(facts, "motif")
    q = rk.benjamini_hochberg(stash(t, "tests"), "p")
    return rounded(rounded(rounded(q.select("motif", "pool_used", "n_control_columns", "observed", "z", "p", "q_bh"), "observed"), "z", digits=4), "p", "q_bh", digits=8)


@query()
def meta_p_values(spark, sf_dir):
    """Pooled effects with the p-values of the effect and of heterogeneity."""
    d = association.cliffs_delta(arms(spark, sf_dir), "v", "arm", ["p_type"])
    half = 1.96 * F.sqrt((F.col("n_a") + F.col("n_b") + 1) / (3.0 * F.col("n_a") * F.col("n_b")))
    t = d.select(F.substring_index("p_type", " ", 1).alias("half"), "cliffs_delta", (F.col("cliffs_delta") - half).alias("lo"), (F.col("cliffs_delta") + half).alias("hi"))
    f = association.fixed_effect(t, "cliffs_delta", "lo", "hi", "half")
    out = f.withColumns({"p": association.normal_p("z"), "heterogeneity_p": association.chi2_p("cochran_q", F.col("n_tests") - 1)})
    return rounded(out, "pooled", "ci_low", "ci_high", "z", "cochran_q", "i_squared", "p", "heterogeneity_p")


@query()
def concordance_p_values(spark, sf_dir):
    """Rank correlation of every pair of scopes' profiles, with its p-value."""
    s = association.spearman(profile_pairs(spark, sf_dir), "x", "y", ["a", "b"])
    return rounded(s.withColumn("p", association.correlation_p(F.col("rho"), F.col("n"))), "rho", "p")


@query()
def overlap_p_values(spark, sf_dir):
    """How many of the top ten columns of two ways to group rows are the same, and the chance of as many."""
    x = aligned(spark, sf_dir)
    axes = [("label", F.col("grp")), ("parity", (F.col("grp").cast("int") % 2).cast("string")), ("half", (F.col("row_id") % 2).cast("string"))]
    joint = reduce(DataFrame.unionByName, (x.groupBy("col_ix", "symbol", g.alias("grp")).agg(F.count("*").cast("double").alias("w")).withColumn("axis", F.lit(n)) for n, g in axes))
    s = m.mutual_information(joint, ["axis", "col_ix"]).withColumn("mi_bits", F.round("mi_bits", 9))
    top = association.top_overlap(s, "axis", "col_ix", "mi_bits", 10)
    return rounded(top.withColumn("p", association.hypergeom_p("overlap", "n_columns", F.lit(10), F.lit(10))), "expected", "p")


NULL_GROUP_SQL = cells_sql().replace("lang AS grp", "nullif(lang, 'fr') AS grp")


def _null_group_rows(spark, sf_dir):
    """The documents as rows, and the counts of their symbols, without a row for each cell."""
    r = rows(spark, sf_dir).withColumn("grp", F.when(F.col("grp") != "fr", F.col("grp")))
    return r, stash(m.sequence_counts(r, "text", ["grp"], empty=True), "counts")


@query(f"WITH {scores_sql(True, NULL_GROUP_SQL)} SELECT grp, col_ix, round(entropy_bits, 6) + 0e0 AS entropy_bits, round(conservation_norm, 6) + 0e0 AS conservation_norm, round(jsd, 6) + 0e0 AS jsd, round(gap_fraction, 6) + 0e0 AS gap_fraction FROM scores")
def null_group_scores(spark, sf_dir):
    """Column scores where one group is null: it is a group like the others."""
    _, counts = _null_group_rows(spark, sf_dir)
    s = m.column_constraint(counts, m.pooled_background(counts), ["grp"], LETTERS)
    return rounded(s.select("grp", "col_ix", "entropy_bits", "conservation_norm", "jsd", "gap_fraction"), "entropy_bits", "conservation_norm", "jsd", "gap_fraction")


@query(f"""WITH {NULL_GROUP_SQL}, named AS (SELECT coalesce(grp, '?') AS g, row_id, col_ix, symbol FROM cells), n AS (SELECT g, col_ix, symbol, count(*) AS n FROM named WHERE symbol <> '-' GROUP BY ALL),
  r AS (SELECT g, col_ix, count(*) AS r FROM n GROUP BY ALL HAVING count(*) > 1), share AS (SELECT g, col_ix, symbol, 1e0 / (r * n) AS s FROM n JOIN r USING (g, col_ix)),
  raw AS (SELECT g, row_id, coalesce(sum(s), 0e0) AS raw FROM named LEFT JOIN share USING (g, col_ix, symbol) GROUP BY ALL), w AS (SELECT g, raw * count(*) OVER (PARTITION BY g) / sum(raw) OVER (PARTITION BY g) AS weight FROM raw)
  SELECT nullif(g, '?') AS grp, count(*) AS n, round(sum(weight) ** 2 / sum(weight ** 2), 5) AS kish_neff FROM w GROUP BY g""")
def null_group_weights(spark, sf_dir):
    """Effective sizes where one group is null."""
    r, counts = _null_group_rows(spark, sf_dir)
    return rounded(m.kish(m.sequence_weights(r, "text", counts, ["grp"], empty=True), ["grp"]), "kish_neff", digits=5)


@query("WITH d AS (SELECT nullif(p_type, 'ECONOMY') AS p_type, p_retailprice AS v, p_size <= 10 AS arm FROM part), r AS (SELECT *, rank() OVER (PARTITION BY p_type ORDER BY v) + (count(*) OVER (PARTITION BY p_type, v) - 1) / 2e0 AS rk FROM d) SELECT p_type, count(*) FILTER (arm) AS n_a, count(*) FILTER (NOT arm) AS n_b, round(2e0 * (sum(rk) FILTER (arm) - count(*) FILTER (arm) * (count(*) FILTER (arm) + 1) / 2e0) / (count(*) FILTER (arm) * count(*) FILTER (NOT arm)) - 1e0, 8) AS cliffs_delta FROM r GROUP BY p_type")
def null_group_delta(spark, sf_dir):
    """Cliff's delta where one group is null."""
    a = arms(spark, sf_dir).withColumn("p_type", F.when(F.col("p_type") != "ECONOMY", F.col("p_type")))
    return rounded(association.cliffs_delta(a, "v", "arm", ["p_type"]), "cliffs_delta", digits=8)


@query("SELECT DISTINCT word FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part)")
def distinct_flattened(spark, sf_dir):
    """The set of all words of all names."""
    return table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).distinct()


@query("SELECT c_name AS name, c_nationkey AS nation, c_mktsegment AS segment, c_acctbal AS balance FROM customer UNION ALL SELECT s_name, s_nationkey, NULL, s_acctbal FROM supplier UNION ALL SELECT n_name, n_nationkey, NULL, NULL FROM nation")
def ragged_union(spark, sf_dir):
    """Tables with some columns in common, one under the other: what a table lacks is null."""
    c = table(spark, sf_dir, "customer").selectExpr("c_name AS name", "c_nationkey AS nation", "c_mktsegment AS segment", "c_acctbal AS balance")
    s = table(spark, sf_dir, "supplier").selectExpr("s_acctbal AS balance", "s_name AS name", "s_nationkey AS nation")
    return c.unionByName(s, allowMissingColumns=True).unionByName(table(spark, sf_dir, "nation").selectExpr("n_name AS name", "n_nationkey AS nation"), allowMissingColumns=True)


@query("SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"))
    return c.union(table(spark, sf_dir, "supplier").select("s_nationkey")).distinct()


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS kinds FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1 GROUP BY user_id")
def ordered_dedupe(spark, sf_dir):
    """Each user's kinds of events once, in the order in which they first came: firsts by kind are combinable, lists are as short as there are kinds."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    return first.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "event_type"))), lambda x: x["event_type"]), ",").alias("kinds"))


@query("SELECT l_returnflag, count(*) AS n, count(*) FILTER (l_returnflag <> '' AND l_linestatus <> '') AS both_filled, count(*) FILTER (l_returnflag = l_linestatus) AS equal FROM lineitem GROUP BY l_returnflag")
def equal_columns(spark, sf_dir):
    """Rows in which two columns are filled, and in which they are equal."""
    a, b = F.col("l_returnflag"), F.col("l_linestatus")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_if((a != "") & (b != "")).alias("both_filled"), F.count_if(a == b).alias("equal"))


@query("SELECT source, lang, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY ALL HAVING count(*) >= 20 AND count(*) FILTER (n_chars > 100) >= 5")
def group_guards(spark, sf_dir):
    """Means of groups with at least 20 rows, 5 of which are long enough."""
    d = table(spark, sf_dir, "documents").select("source", "lang", "n_chars")
    ok = families.large_enough(families.large_enough(d, ["source", "lang"], LEAST_ROWS), ["source", "lang"], LEAST_ARM, F.col("n_chars") > 100)
    return rounded(ok.groupBy("source", "lang").agg(F.count("*").alias("n"), F.avg("n_chars").alias("mean_chars")), "mean_chars", digits=4)


@query("SELECT p_partkey, p_name, p_size, p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY p_type) AS forced FROM part WHERE p_size <= 10 OR p_partkey IN (SELECT min(p_partkey) FROM part GROUP BY p_type)")
def family_assembly(spark, sf_dir):
    """Small parts, and the first part of each type whether small or not."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_type")
    return families.assemble(p.filter("p_size <= 10").drop("p_type"), p.groupBy("p_type").agg(F.min("p_partkey").alias("p_partkey")), p.drop("p_type"), "p_partkey")


@query("SELECT p_type, p_partkey, fell_back, n_pool FROM (SELECT *, count(*) OVER (PARTITION BY p_type) AS n_pool FROM (SELECT p_type, p_partkey, p_size, few AS fell_back FROM part JOIN (SELECT p_type, count(*) FILTER (p_size > 48) < count(*) // 20 AS few FROM part GROUP BY p_type) USING (p_type)) WHERE fell_back OR p_size > 48)")
def fallback_pool(spark, sf_dir):
    """Large parts of each type, or all parts of types where fewer than one in twenty is large."""
    p = table(spark, sf_dir, "part").select("p_type", "p_partkey", "p_size")
    needs = p.groupBy("p_type").agg(F.floor(F.count("*") / 20).alias("need"))
    return families.with_fallback(p.filter("p_size > 48"), p, needs, ["p_type"], "need").select("p_type", "p_partkey", "fell_back", "n_pool")


@query("WITH f AS (SELECT p_partkey, concat_ws(';', CASE WHEN p_size <= 20 THEN 'SH2' END, CASE WHEN p_size BETWEEN 10 AND 30 THEN 'SH2_ext' END, CASE WHEN p_size > 25 THEN 'box' END) AS features FROM part) SELECT p_partkey, features, contains(features, 'SH2') AS contains_it, list_contains(string_split(features, ';'), 'SH2') AS has_it FROM f")
def feature_contains(spark, sf_dir):
    """A name found anywhere in a list's text, which overlapping names satisfy too, beside one found as an entry of the list."""
    s = F.col("p_size")
    names = F.concat_ws(";", F.when(s <= 20, "SH2"), F.when(s.between(10, 30), "SH2_ext"), F.when(s > 25, "box"))
    f = table(spark, sf_dir, "part").select("p_partkey", names.alias("features"))
    return f.select("p_partkey", "features", F.col("features").contains("SH2").alias("contains_it"), F.array_contains(F.split("features", ";"), "SH2").alias("has_it"))
