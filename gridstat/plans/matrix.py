"""Column profiles, weights, consensus and specificity of the documents matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridstat.functions.ordered import by_keys
from gridstat.operators import association, mapping
from gridstat.operators import matrix as m
from gridstat.sources.scratch import stash

from .inputs import LETTERS, MODULES, MODULES_SQL, cells, cells_sql, counts, rows, scored, scores, scores_sql, weighed
from .registry import query, rounded, table


@query(f"WITH {scores_sql(False)} SELECT col_ix, round(jsd, 6) + 0e0 AS jsd FROM scores")
def jsd_profile(spark, sf_dir):
    return rounded(scores(spark, sf_dir, []).select("col_ix", "jsd"), "jsd")


@query(f"WITH {scores_sql(True)} SELECT grp, col_ix, round(entropy_bits, 6) + 0e0 AS entropy_bits, round(conservation_norm, 6) + 0e0 AS conservation_norm, round(jsd, 6) + 0e0 AS jsd, round(gap_fraction, 6) + 0e0 AS gap_fraction FROM scores")
def entropy_conservation(spark, sf_dir):
    s = scores(spark, sf_dir, ["grp"]).select("grp", "col_ix", "entropy_bits", "conservation_norm", "jsd", "gap_fraction")
    return rounded(s, "entropy_bits", "conservation_norm", "jsd", "gap_fraction")


@query(f"WITH {cells_sql()} SELECT col_ix, round(avg(CASE WHEN symbol = '-' THEN 1e0 ELSE 0e0 END), 6) AS gap_raw FROM cells GROUP BY col_ix")
def gap_fraction_raw(spark, sf_dir):
    return rounded(m.gap_fraction(cells(spark, sf_dir)).withColumnRenamed("gap_fraction", "gap_raw"), "gap_raw")


HENIKOFF_SQL = f"""{cells_sql()},
  n AS (SELECT grp, col_ix, symbol, count(*) AS n FROM cells WHERE symbol <> '-' GROUP BY ALL),
  r AS (SELECT grp, col_ix, count(*) AS r FROM n GROUP BY ALL HAVING count(*) > 1),
  share AS (SELECT n.grp, n.col_ix, n.symbol, 1e0 / (r.r * n.n) AS s FROM n JOIN r USING (grp, col_ix)),
  raw AS (SELECT c.grp, c.row_id, coalesce(sum(s), 0e0) AS raw FROM cells c LEFT JOIN share USING (grp, col_ix, symbol) GROUP BY ALL),
  weights AS (SELECT grp, row_id, CASE WHEN sum(raw) OVER (PARTITION BY grp) > 0 THEN raw * count(*) OVER (PARTITION BY grp) / sum(raw) OVER (PARTITION BY grp) ELSE 1e0 END AS weight FROM raw)"""


@query(f"WITH {HENIKOFF_SQL} SELECT grp, row_id, round(weight, 6) AS weight FROM weights")
def henikoff_weights(spark, sf_dir):
    return rounded(weighed(spark, sf_dir, ["grp"])[1], "weight")


@query(f"WITH {HENIKOFF_SQL} SELECT c.grp, c.col_ix, round(sum(CASE WHEN symbol = '-' THEN weight ELSE 0e0 END) / sum(weight), 6) + 0e0 AS gap_w FROM cells c JOIN weights USING (grp, row_id) GROUP BY ALL")
def gap_fraction_weighted(spark, sf_dir):
    r, w = weighed(spark, sf_dir, ["grp"])
    counted = m.sequence_counts(by_keys(r, w, ["grp", "row_id"]), "text", ["grp"], weight="weight", empty=True)
    return rounded(m.gap_share(counted, ["grp"]).withColumnRenamed("gap_share", "gap_w"), "gap_w")


@query(f"WITH {HENIKOFF_SQL} SELECT grp, count(*) AS n, round(sum(weight) ** 2 / sum(weight ** 2), 5) AS kish_neff, round(sum(weight) ** 2 / sum(weight ** 2) / count(*), 6) AS kish_share FROM weights GROUP BY grp")
def kish_effective_size(spark, sf_dir):
    k = m.kish(stash(weighed(spark, sf_dir, ["grp"])[1], "weights"), ["grp"])
    return rounded(rounded(k.withColumn("kish_share", F.col("kish_neff") / F.col("n")), "kish_share"), "kish_neff", digits=5)


FEATURED_SQL = f"""{scores_sql(True)}, {MODULES_SQL},
  feat AS (SELECT s.*, concat_ws(';', CASE WHEN col_ix BETWEEN 8 AND 29 THEN 'body' END, CASE WHEN col_ix BETWEEN 0 AND 9 THEN 'head' END, CASE WHEN col_ix BETWEEN 30 AND 39 THEN 'tail' END) AS features FROM scores s)"""
SUMMARY_SQL = "count(*) AS n_columns, round(avg(jsd), 6) AS mean_jsd, round(min(jsd), 6) AS min_jsd, round(max(jsd), 6) AS max_jsd, round(median(jsd), 6) AS median_jsd, round(avg(conservation_norm), 6) AS mean_conservation, round(avg(gap_fraction), 6) AS mean_gap_fraction"


@query(f"WITH {FEATURED_SQL} SELECT grp, 'exact' AS rule, features AS module, {SUMMARY_SQL} FROM feat GROUP BY ALL UNION ALL SELECT grp, 'contains' AS rule, module, {SUMMARY_SQL} FROM feat JOIN modules ON contains(features, module) GROUP BY ALL")
def module_constraint(spark, sf_dir):
    """Summaries by the exact set of intervals that hold a column, and by each interval that does."""
    s = mapping.column_features(scores(spark, sf_dir, ["grp"]), MODULES)
    exact = s.select("*", F.lit("exact").alias("rule"), F.array_join("features", ";").alias("module"))
    each = s.select("*", F.lit("contains").alias("rule"), F.explode("features").alias("module"))
    g = exact.unionByName(each).groupBy("grp", "rule", "module")
    out = g.agg(F.count("*").alias("n_columns"), F.avg("jsd").alias("mean_jsd"), F.min("jsd").alias("min_jsd"), F.max("jsd").alias("max_jsd"), F.median("jsd").alias("median_jsd"), F.avg("conservation_norm").alias("mean_conservation"), F.avg("gap_fraction").alias("mean_gap_fraction"))
    return rounded(out, "mean_jsd", "min_jsd", "max_jsd", "median_jsd", "mean_conservation", "mean_gap_fraction")


@query(f"WITH {FEATURED_SQL} SELECT grp, module, round(avg(jsd), 6) AS mean_jsd, round(avg(jsd_residues), 6) AS mean_jsd_residues, round(avg(jsd_residues) - avg(jsd), 6) + 0e0 AS gap_part FROM feat JOIN modules ON contains(features, module) GROUP BY ALL")
def module_gap_decomposition(spark, sf_dir):
    s = mapping.column_features(scores(spark, sf_dir, ["grp"]), MODULES).withColumn("module", F.explode("features"))
    g = s.groupBy("grp", "module").agg(F.avg("jsd").alias("mean_jsd"), F.avg("jsd_residues").alias("mean_jsd_residues"))
    return rounded(g.withColumn("gap_part", F.col("mean_jsd_residues") - F.col("mean_jsd")), "mean_jsd", "mean_jsd_residues", "gap_part")


@query(f"WITH {cells_sql()} SELECT coalesce(grp, 'FAMILY') AS scope, count(*) AS n_cells, count(DISTINCT row_id) AS n_rows, round(avg(CASE WHEN symbol = '-' THEN 1e0 ELSE 0e0 END), 6) AS gap_fraction FROM cells GROUP BY GROUPING SETS ((grp), ())")
def scope_grouping_sets(spark, sf_dir):
    """Each group and all together in one pass: rows are counted before cells are dropped to one count each."""
    rows = cells(spark, sf_dir).groupBy("grp", "row_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("symbol") == m.GAP, 1).otherwise(0)).alias("gaps"))
    g = rows.rollup("grp").agg(F.sum("n").alias("n_cells"), F.count("*").alias("n_rows"), (F.sum("gaps") / F.sum("n")).alias("gap_fraction"))
    return rounded(g.select(F.coalesce("grp", F.lit("FAMILY")).alias("scope"), "n_cells", "n_rows", "gap_fraction"), "gap_fraction")


ARGMAX_SQL = "res AS (SELECT grp, col_ix, symbol AS consensus FROM (SELECT *, row_number() OVER (PARTITION BY grp, col_ix ORDER BY w DESC, ascii(symbol)) AS rn FROM cnt WHERE symbol <> '-') WHERE rn = 1), cons AS (SELECT tot.grp, tot.col_ix, coalesce(consensus, 'A') AS consensus FROM tot LEFT JOIN res USING (grp, col_ix))"


@query(f"WITH {scores_sql(True)}, {ARGMAX_SQL} SELECT * FROM cons")
def consensus_no_gap(spark, sf_dir):
    return m.consensus_residue(counts(spark, sf_dir), ["grp"], "A")


@query(f"""WITH {cells_sql()}, c AS (SELECT grp, col_ix, symbol, count(*) AS n, min(row_id) AS seen FROM cells GROUP BY ALL)
  SELECT grp, col_ix, symbol AS consensus, round(n * 1e0 / t, 6) AS consensus_share FROM (SELECT *, sum(n) OVER (PARTITION BY grp, col_ix) AS t, row_number() OVER (PARTITION BY grp, col_ix ORDER BY n DESC, seen) AS rn FROM c) WHERE rn = 1""")
def consensus_with_gap(spark, sf_dir):
    return rounded(m.consensus_of(m.sequence_counts(rows(spark, sf_dir), "text", ["grp"], seen="row_id", empty=True), ["grp"]), "consensus_share")


@query(f"""WITH {scores_sql(True)}, {ARGMAX_SQL},
  g AS (SELECT col_ix, avg(jsd) AS w, min(jsd) AS lo, count(DISTINCT consensus) AS k FROM scores JOIN cons USING (grp, col_ix) GROUP BY col_ix)
  SELECT col_ix, round(w, 6) AS within_group_conservation, round(lo, 6) AS min_within_group_conservation, k AS n_distinct_consensus, round(lo * (k - 1), 6) + 0e0 AS contrast FROM g""")
def group_contrast(spark, sf_dir):
    c = counts(spark, sf_dir, empty=False)
    g = m.group_contrast(c, m.pooled_background(c), "grp", [], LETTERS, "A")
    return rounded(g, "within_group_conservation", "min_within_group_conservation", "contrast")


def mi_sql(joint: str, by: str, corrected: bool = True) -> str:
    """CTE ``mi`` (by, mi_bits) from ``joint`` (by, symbol, grp, w)."""
    fix = "+ (kx + ky - kxy - 1) / (2e0 * greatest(t, 1e0) * ln(2e0))" if corrected else ""
    return f"""px AS (SELECT {by}, symbol, sum(w) AS w FROM {joint} GROUP BY ALL), py AS (SELECT {by}, grp, sum(w) AS w FROM {joint} GROUP BY ALL), pt AS (SELECT {by}, sum(w) AS t FROM {joint} GROUP BY ALL),
    hx AS (SELECT {by}, -sum(w / t * log2(w / t)) AS hx, count(*) AS kx FROM px JOIN pt USING ({by}) GROUP BY ALL),
    hy AS (SELECT {by}, -sum(w / t * log2(w / t)) AS hy, count(*) AS ky FROM py JOIN pt USING ({by}) GROUP BY ALL),
    hxy AS (SELECT {by}, -sum(w / t * log2(w / t)) AS hxy, count(*) AS kxy FROM {joint} JOIN pt USING ({by}) GROUP BY ALL),
    mi AS (SELECT {by}, greatest(0e0, hx + hy - hxy {fix}) AS mi_bits FROM hx JOIN hy USING ({by}) JOIN hxy USING ({by}) JOIN pt USING ({by}))"""


@query(f"WITH {cells_sql()}, joint AS (SELECT col_ix, symbol, grp, count(*) * 1e0 AS w FROM cells GROUP BY ALL), {mi_sql('joint', 'col_ix')} SELECT col_ix, round(mi_bits, 6) + 0e0 AS mi_bits FROM mi")
def mi_specificity(spark, sf_dir):
    return rounded(m.mutual_information(counts(spark, sf_dir, empty=False), ["col_ix"]), "mi_bits")


AXES_SQL = f"""{cells_sql()},
  joint AS (SELECT 'lang' AS axis, col_ix, symbol, grp, count(*) * 1e0 AS w FROM cells GROUP BY ALL
    UNION ALL SELECT 'quality' AS axis, col_ix, symbol, CAST(quality AS VARCHAR) AS grp, count(*) * 1e0 AS w FROM cells JOIN labels ON row_id = doc_id GROUP BY ALL
    UNION ALL SELECT 'source' AS axis, col_ix, symbol, entity AS grp, count(*) * 1e0 AS w FROM cells GROUP BY ALL),
  {mi_sql('joint', 'axis, col_ix')}"""


def axis_scores(spark, sf_dir):
    """Specificity of every column for three ways to group rows.

    Labels are joined to rows; a row is counted once for each way, and no row is made for a cell.
    """
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").cast("string").alias("quality"), F.lit(True).alias("labelled"))
    r = rows(spark, sf_dir).join(labels, "row_id", "left").withColumnsRenamed({"grp": "lang", "entity": "source"})
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("axis"), F.col(a).alias("grp")) for a in ("lang", "quality", "source")))).alias("a")
    ways = r.select("text", "labelled", each).filter("a.axis != 'quality' or labelled").select("text", "a.axis", "a.grp")
    joint = stash(m.sequence_counts(ways, "text", ["axis", "grp"]), "joint")
    return m.mutual_information(joint, ["axis", "col_ix"])


@query(f"WITH {AXES_SQL} SELECT axis, col_ix, round(mi_bits, 6) + 0e0 AS mi_bits FROM mi")
def mi_miller_madow_axes(spark, sf_dir):
    return rounded(axis_scores(spark, sf_dir), "mi_bits")


@query(f"""WITH {AXES_SQL}, top AS (SELECT axis, col_ix FROM (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY round(mi_bits, 9) DESC, col_ix) AS rn FROM mi) WHERE rn <= 10),
  n AS (SELECT axis, count(DISTINCT col_ix) AS n_columns FROM mi GROUP BY axis),
  k AS (SELECT x.axis AS axis_a, y.axis AS axis_b, count(*) AS overlap FROM top x JOIN top y ON x.col_ix = y.col_ix AND x.axis < y.axis GROUP BY ALL)
  SELECT a.axis AS axis_a, b.axis AS axis_b, a.n_columns, coalesce(overlap, 0) AS overlap, round(100e0 / a.n_columns, 6) AS expected FROM n a JOIN n b ON a.axis < b.axis LEFT JOIN k ON axis_a = a.axis AND axis_b = b.axis""")
def axis_overlap(spark, sf_dir):
    s = axis_scores(spark, sf_dir).withColumn("mi_bits", F.round("mi_bits", 9))
    return rounded(association.top_overlap(s, "axis", "col_ix", "mi_bits", 10), "expected")


@query(f"WITH {scores_sql(True)} SELECT col_ix, round(max(jsd) FILTER (grp = 'de'), 6) AS de, round(max(jsd) FILTER (grp = 'en'), 6) AS en, round(max(jsd) FILTER (grp = 'es'), 6) AS es, round(max(jsd) FILTER (grp = 'fr'), 6) AS fr, round((max(jsd) FILTER (grp = 'en') + max(jsd) FILTER (grp = 'fr')) / 2 - max(jsd) FILTER (grp = 'de'), 6) + 0e0 AS delta FROM scores GROUP BY col_ix")
def pivot_scope_delta(spark, sf_dir):
    """Profiles side by side, and the mean of two scopes less a third."""
    p = scores(spark, sf_dir, ["grp"]).groupBy("col_ix").pivot("grp", ["de", "en", "es", "fr"]).avg("jsd")
    return rounded(p.withColumn("delta", (F.col("en") + F.col("fr")) / 2 - F.col("de")), "de", "en", "es", "fr", "delta")


PANEL = [("P1", 0, "T", "A"), ("P2", 5, "e", "a"), ("P3", 12, "t", "-"), ("P4", 25, "n", "s"), ("P5", 38, "h", "o")]
PANEL_SQL = ", ".join(f"('{n}', {c}, '{w}', '{x}')" for n, c, w, x in PANEL)


@query(f"""WITH {scores_sql(True)}, panel AS (SELECT * FROM (VALUES {PANEL_SQL}) AS t(variant, col_ix, wild, mutant)),
  seen AS (SELECT grp, col_ix, symbol, count(*) AS n, min(row_id) AS seen FROM cells GROUP BY ALL),
  mode AS (SELECT grp, col_ix, symbol AS consensus FROM (SELECT *, row_number() OVER (PARTITION BY grp, col_ix ORDER BY n DESC, seen) AS rn FROM seen) WHERE rn = 1),
  below AS (SELECT grp, col_ix, jsd, (rank() OVER (PARTITION BY grp ORDER BY round(jsd, 9)) - 1) * 1e0 / count(*) OVER (PARTITION BY grp) AS pr FROM scores)
  SELECT variant, panel.col_ix, below.grp, wild, mutant, consensus, round(jsd, 6) AS jsd, round(pr, 6) AS jsd_percentile,
    round(coalesce((SELECT w / t FROM cnt WHERE cnt.grp = below.grp AND cnt.col_ix = panel.col_ix AND symbol = wild), 0e0), 6) AS wild_share,
    round(coalesce((SELECT w / t FROM cnt WHERE cnt.grp = below.grp AND cnt.col_ix = panel.col_ix AND symbol = mutant), 0e0), 6) AS mutant_share
  FROM panel JOIN below USING (col_ix) JOIN tot ON tot.grp = below.grp AND tot.col_ix = panel.col_ix JOIN mode ON mode.grp = below.grp AND mode.col_ix = panel.col_ix""")
def value_shift_panel(spark, sf_dir):
    """Declared substitutions against each group's consensus, shares and percentile of constraint."""
    from gridstat.functions.ordered import fraction_below

    counted = stash(m.sequence_counts(rows(spark, sf_dir), "text", ["grp"], seen="row_id", empty=True), "counts")
    panel = F.broadcast(spark.createDataFrame(PANEL, "variant string, col_ix int, wild string, mutant string"))
    s = fraction_below(scored(counted, ["grp"]).withColumn("jsd9", F.round("jsd", 9)), "jsd9", ["grp"], "jsd_percentile")
    share = lambda c: (F.sum(F.when(F.col("symbol") == F.col(c), F.col("w")).otherwise(0.0)) / F.sum("w")).alias(f"{c}_share")
    shares = counted.join(panel, "col_ix").groupBy("variant", "col_ix", "grp", "wild", "mutant").agg(share("wild"), share("mutant"))
    j = shares.join(m.consensus_of(counted, ["grp"]).drop("consensus_share"), ["grp", "col_ix"]).join(s.select("grp", "col_ix", "jsd", "jsd_percentile"), ["grp", "col_ix"])
    return rounded(j, "jsd", "jsd_percentile", "wild_share", "mutant_share")
