"""Effective depth, paired pools and column coupling of the documents matrix."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridstat.operators import coupling as c
from gridstat.operators import resample
from gridstat.sources.scratch import stash

from .inputs import ALIGNED_SQL, DIMENSIONS, aligned, aligned_rows
from .registry import query, rounded, table

THETAS = (0.4, 0.6, 0.8)
#: Columns of the two blocks: each half of the matrix.
HALF = DIMENSIONS // 2

PACKED_SQL = f"{ALIGNED_SQL}, rows_ AS (SELECT grp, row_id, string_agg(symbol, '' ORDER BY col_ix) AS s FROM cells GROUP BY ALL)"
SAME_SQL = f"{DIMENSIONS} - hamming(a.s, b.s)"
NEFF_SQL = f"{PACKED_SQL}, thetas AS (SELECT * FROM (VALUES (0.4e0), (0.6e0), (0.8e0)) AS t(theta)), same AS (SELECT a.grp, a.row_id, {SAME_SQL} AS k, count(*) AS n FROM rows_ a JOIN rows_ b ON a.grp = b.grp GROUP BY ALL), nb AS (SELECT theta, grp, row_id, sum(n) AS n FROM same, thetas WHERE k / {DIMENSIONS}e0 >= theta GROUP BY ALL), neff AS (SELECT theta, grp, count(*) AS n, sum(1e0 / n) AS n_eff FROM nb GROUP BY ALL)"


def depths(spark, sf_dir):
    """Effective number of rows of each group at three identity thresholds."""
    rows = stash(aligned_rows(spark, sf_dir), "rows")
    return c.effective_depth(c.identity_weights(rows, DIMENSIONS, THETAS, ["grp"]), ["grp", "theta"])


@query(f"WITH {NEFF_SQL} SELECT theta, grp, n, round(n_eff, 6) AS n_eff FROM neff")
def identity_neff(spark, sf_dir):
    return rounded(depths(spark, sf_dir), "n_eff")


@query(f"WITH {NEFF_SQL} SELECT theta, grp, round(n_eff / 210e0, 6) AS gate_ratio, n_eff > 210e0 AS passes FROM neff")
def depth_gate(spark, sf_dir):
    """Is the depth more than the mean length of two blocks of 140 and 280 columns?"""
    ratio, passes = c.depth_gate(F.col("n_eff"), 140, 280)
    return rounded(depths(spark, sf_dir).select("theta", "grp", ratio.alias("gate_ratio"), passes.alias("passes")), "gate_ratio")


QUALITY_SQL = f"""{NEFF_SQL}, smp AS (SELECT grp, s, rn FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5(CAST(row_id AS VARCHAR)), row_id) AS rn FROM rows_) WHERE rn <= 250),
  idn AS (SELECT a.grp, avg(({SAME_SQL}) / {DIMENSIONS}e0) AS m FROM smp a JOIN smp b ON a.grp = b.grp AND a.rn < b.rn GROUP BY a.grp),
  occ AS (SELECT grp, avg(CASE WHEN symbol = '-' THEN 0e0 ELSE 1e0 END) AS o FROM cells GROUP BY grp)"""


@query(f"WITH {QUALITY_SQL} SELECT grp, n AS n_sequences, round(n_eff, 6) AS neff_80, round(o, 6) AS mean_occupancy, round(m, 6) AS mean_identity FROM neff JOIN idn USING (grp) JOIN occ USING (grp) WHERE theta = 0.8e0")
def alignment_quality(spark, sf_dir):
    """Rows, effective depth, occupancy and mean identity of a bounded sample of 250 rows, by group."""
    rows = stash(aligned_rows(spark, sf_dir), "rows")
    d = c.effective_depth(c.identity_weights(rows, DIMENSIONS, (0.8,), ["grp"]), ["grp"])
    occupancy = aligned(spark, sf_dir).groupBy("grp").agg(F.avg(F.when(F.col("symbol") == "-", 0.0).otherwise(1.0)).alias("mean_occupancy"))
    j = d.join(occupancy, "grp").join(c.mean_pairwise_identity(rows, DIMENSIONS, ["grp"], 250), "grp")
    return rounded(j.select("grp", F.col("n").alias("n_sequences"), F.col("n_eff").alias("neff_80"), "mean_occupancy", "mean_identity"), "neff_80", "mean_occupancy", "mean_identity")


@query("WITH k AS (SELECT DISTINCT lang, source FROM documents), n AS (SELECT lang, count(*) AS n FROM k GROUP BY lang) SELECT a.lang AS lang_a, b.lang AS lang_b, max(na.n) AS species_a, max(nb.n) AS species_b, count(*) AS paired FROM k a JOIN k b ON a.source = b.source AND a.lang < b.lang JOIN n na ON na.lang = a.lang JOIN n nb ON nb.lang = b.lang GROUP BY a.lang, b.lang")
def paired_entities(spark, sf_dir):
    """Sources that each pair of groups has in common."""
    k = table(spark, sf_dir, "documents").select("lang", "source").distinct()
    n = k.groupBy("lang").agg(F.count("*").alias("n"))
    pairs = k.select(F.col("lang").alias("lang_a"), "source").join(k.select(F.col("lang").alias("lang_b"), "source"), "source").filter("lang_a < lang_b").groupBy("lang_a", "lang_b").agg(F.count("*").alias("paired"))
    a, b = n.select(F.col("lang").alias("lang_a"), F.col("n").alias("species_a")), n.select(F.col("lang").alias("lang_b"), F.col("n").alias("species_b"))
    return pairs.join(a, "lang_a").join(b, "lang_b").select("lang_a", "lang_b", "species_a", "species_b", "paired")


@query("SELECT lang AS route, CASE WHEN n_chars < 1000 THEN 'short' WHEN n_chars < 5000 THEN 'middle' ELSE 'long' END AS tier, count(*) AS entries, count(DISTINCT source) AS species FROM documents GROUP BY ALL")
def retrieval_yield(spark, sf_dir):
    tier = F.when(F.col("n_chars") < 1000, "short").when(F.col("n_chars") < 5000, "middle").otherwise("long")
    return table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("route"), tier.alias("tier")).agg(F.count("*").alias("entries"), F.count_distinct("source").alias("species"))


def mi_sql(joint: str, by: str = "") -> str:
    """CTE ``mi`` (by, i, j, mi) from joint (by, i, j, x, y, w)."""
    b = f"{by}, " if by else ""
    return f"""t_ AS (SELECT {b}i, j, sum(w) AS t FROM {joint} GROUP BY ALL),
    hx AS (SELECT {b}i, j, -sum(w / t * log2(w / t)) AS h FROM (SELECT {b}i, j, x, sum(w) AS w FROM {joint} GROUP BY ALL) JOIN t_ USING ({b}i, j) GROUP BY ALL),
    hy AS (SELECT {b}i, j, -sum(w / t * log2(w / t)) AS h FROM (SELECT {b}i, j, y, sum(w) AS w FROM {joint} GROUP BY ALL) JOIN t_ USING ({b}i, j) GROUP BY ALL),
    hxy AS (SELECT {b}i, j, -sum(w / t * log2(w / t)) AS h FROM {joint} JOIN t_ USING ({b}i, j) GROUP BY ALL),
    mi AS (SELECT {b}i, j, greatest(0e0, hx.h + hy.h - hxy.h) AS mi FROM hx JOIN hy USING ({b}i, j) JOIN hxy USING ({b}i, j))"""


BLOCKS_SQL = f"{ALIGNED_SQL}, cl AS (SELECT * FROM cells WHERE col_ix < {HALF}), cr AS (SELECT row_id, col_ix - {HALF} AS col_ix, symbol FROM cells WHERE col_ix >= {HALF}), joint AS (SELECT a.col_ix AS i, b.col_ix AS j, a.symbol AS x, b.symbol AS y, count(*) * 1e0 AS w FROM cl a JOIN cr b USING (row_id) GROUP BY ALL), {mi_sql('joint')}"
APC_SQL = "apc AS (SELECT *, CASE WHEN avg(mi) OVER () > 0 THEN mi - avg(mi) OVER (PARTITION BY i) * avg(mi) OVER (PARTITION BY j) / avg(mi) OVER () ELSE mi END AS apc FROM mi)"


def blocks(spark, sf_dir):
    """Both halves of the aligned matrix, as packed rows."""
    rows = aligned_rows(spark, sf_dir)
    return rows.withColumn("symbols", F.substring("symbols", 1, HALF)), rows.withColumn("symbols", F.substring("symbols", HALF + 1, HALF))


def observed(spark, sf_dir):
    left, right = blocks(spark, sf_dir)
    pool = left.select(F.col("row_id").alias("a"), F.col("row_id").alias("b"))
    return c.interblock_mi(pool, left, right)


@query(f"WITH {BLOCKS_SQL} SELECT i, j, round(mi, 6) + 0e0 AS mi FROM mi")
def interblock_mi(spark, sf_dir):
    return rounded(observed(spark, sf_dir), "mi")


@query(f"WITH {BLOCKS_SQL}, {APC_SQL} SELECT i, j, round(mi, 6) + 0e0 AS mi, round(apc, 6) + 0e0 AS apc FROM apc")
def interblock_mi_apc(spark, sf_dir):
    return rounded(c.average_product_correction(observed(spark, sf_dir)), "mi", "apc")


#: Ten neighbouring ids are of one entity, so that there are more entities where there are more vectors; even groups are paired with odd ones.
REPLICATES = 200
TOP = 100
POOL_SQL = f"""{ALIGNED_SQL}, cl AS (SELECT * FROM cells WHERE col_ix < {HALF}), cr AS (SELECT row_id, col_ix - {HALF} AS col_ix, symbol FROM cells WHERE col_ix >= {HALF}),
  one AS (SELECT CAST(label % 2 AS VARCHAR) AS side, CAST(label AS VARCHAR) AS part, vec_id // 10 AS source, min(vec_id) AS id FROM embeddings GROUP BY ALL),
  sp AS (SELECT source, row_number() OVER (ORDER BY source) AS pos FROM (SELECT DISTINCT source FROM one WHERE side = '1')),
  sh AS (SELECT k AS replicate, source, row_number() OVER (PARTITION BY k ORDER BY md5(concat_ws(':', k, source)), source) AS pos FROM sp, range(0, {REPLICATES}) AS r(k)),
  pairing AS (SELECT replicate, sh.source, sp.source AS partner FROM sh JOIN sp USING (pos) UNION ALL SELECT -1, source, source FROM sp),
  pool AS (SELECT replicate, a.id AS a, b.id AS b FROM one a JOIN pairing USING (source) JOIN one b ON b.source = partner WHERE a.side = '0' AND b.side = '1'),
  joint AS (SELECT replicate, x.col_ix AS i, y.col_ix AS j, x.symbol AS x, y.symbol AS y, count(*) * 1e0 AS w FROM pool JOIN cl x ON x.row_id = a JOIN cr y ON y.row_id = b GROUP BY ALL),
  {mi_sql('joint', 'replicate')},
  apc AS (SELECT *, CASE WHEN avg(mi) OVER (PARTITION BY replicate) > 0 THEN mi - avg(mi) OVER (PARTITION BY replicate, i) * avg(mi) OVER (PARTITION BY replicate, j) / avg(mi) OVER (PARTITION BY replicate) ELSE mi END AS apc FROM mi),
  rk AS (SELECT *, row_number() OVER (PARTITION BY replicate ORDER BY apc DESC, i, j) AS rn FROM apc),
  st AS (SELECT replicate, avg(apc) AS m, avg(apc) FILTER (rn <= {TOP}) AS top, max(apc) AS hi FROM rk GROUP BY replicate)"""


def paired_replicates(spark, sf_dir, within: bool = False):
    """Corrected couplings of the observed pool (replicate -1) and of pools paired through permuted sources, and the pools.

    The permuted keys are those of the whole right side, so that a left row whose partner source lacks rows of a
    group drops out; ``within`` permutes them inside each right group, which keeps the number of rows.
    """
    left, right = (stash(x, "block") for x in blocks(spark, sf_dir))
    v = table(spark, sf_dir, "embeddings")
    one = stash(v.groupBy((F.col("label") % 2).alias("side"), F.col("label").cast("string").alias("part"), F.floor(F.col("vec_id") / 10).alias("source")).agg(F.min("vec_id").alias("id")), "pool")
    a, b = one.filter("side = 0").drop("side"), one.filter("side = 1").drop("side")
    if within:
        # a permutation of the right rows' sources inside each group: those that a left row can meet
        own = b.select("part", "source", F.col("source").alias("partner"))
        moved = resample.permuted(own, "source", "partner", REPLICATES, ["part"]).unionByName(own.withColumn("replicate", F.lit(-1)))
        right_rows = moved.join(b.select("part", F.col("source").alias("partner"), "id"), ["part", "partner"])
        pool = a.select("source", F.col("id").alias("a")).join(right_rows.select("replicate", "source", F.col("id").alias("b")), "source")
        pool = stash(pool.select("replicate", F.concat_ws("|", "a", "b").alias("row_id"), "a", "b"), "pool")
    else:
        sources = b.select("source").distinct().withColumn("partner", F.col("source"))
        pairing = resample.permuted(sources, "source", "partner", REPLICATES).unionByName(sources.withColumn("replicate", F.lit(-1)))
        pool = stash(c.paired_pool(a, b, "source", pairing, ["replicate"]), "pool")
    mi = stash(c.interblock_mi(pool, left, right, ["replicate"]), "mi")
    apc = c.average_product_correction(mi, ["replicate"])
    w = Window.partitionBy("replicate").orderBy(F.desc("apc"), "i", "j")
    st = apc.withColumn("rn", F.row_number().over(w)).groupBy("replicate").agg(F.avg("apc").alias("mean_apc"), F.avg(F.when(F.col("rn") <= TOP, F.col("apc"))).alias("top_mean"), F.max("apc").alias("top_max"))
    return stash(st.join(pool.groupBy("replicate").agg(F.count("*").alias("n_rows")), "replicate"), "replicates")


@query(f"""WITH {POOL_SQL}, n AS (SELECT avg(top) AS mu, stddev_pop(top) AS sd, count(*) AS n FROM st WHERE replicate >= 0), o AS (SELECT top, m, hi FROM st WHERE replicate < 0)
  SELECT 'top_mean' AS measure, round(o.top, 6) AS observed, round(mu, 6) AS null_mean, round(sd, 6) AS null_sd, ((SELECT count(*) FROM st, n, o WHERE replicate >= 0 AND abs(st.top - mu) >= abs(o.top - mu) - 1e-9) + 1e0) / (n.n + 1) AS p FROM o, n""")
def scramble_null(spark, sf_dir):
    """Mean of the hundred strongest coupled column pairs against pools paired through permuted sources."""
    top = paired_replicates(spark, sf_dir).select("replicate", F.col("top_mean").alias("top"))
    t = resample.tail(top.filter("replicate >= 0").select("top"), top.filter("replicate < 0").select("top"), [], "top", "two_sided", "null")
    return rounded(t.select(F.lit("top_mean").alias("measure"), "observed", "null_mean", "null_sd", "p"), "observed", "null_mean", "null_sd")


@query(f"""WITH {POOL_SQL} SELECT CAST(replicate AS INTEGER) AS replicate, round(m, 6) + 0e0 AS mean_apc, round(top, 6) AS top_mean, round(hi, 6) AS top_max, (SELECT count(*) FROM pool WHERE pool.replicate = st.replicate) AS n_rows FROM st""")
def scramble_replicates(spark, sf_dir):
    """Every replicate's mean, mean of the hundred strongest and maximum, and the rows its pool has; -1 is the observed pairing."""
    return rounded(paired_replicates(spark, sf_dir), "mean_apc", "top_mean", "top_max")


WITHIN_SQL = POOL_SQL.replace(
    POOL_SQL[POOL_SQL.index("sp AS (") : POOL_SQL.index("joint AS (")],
    """sp AS (SELECT part, source, id, row_number() OVER (PARTITION BY part ORDER BY source) AS pos FROM one WHERE side = '1'),
  sh AS (SELECT k AS replicate, part, source, row_number() OVER (PARTITION BY k, part ORDER BY md5(concat_ws(':', k, source)), source) AS pos FROM sp, range(0, {REPLICATES}) AS r(k)),
  moved AS (SELECT replicate, sh.source, sp.id FROM sh JOIN sp USING (part, pos) UNION ALL SELECT -1, source, id FROM sp),
  pool AS (SELECT replicate, a.id AS a, moved.id AS b FROM one a JOIN moved USING (source) WHERE a.side = '0'),
  """.replace("{REPLICATES}", str(REPLICATES)),
)


@query(f"""WITH {WITHIN_SQL} SELECT CAST(replicate AS INTEGER) AS replicate, round(m, 6) + 0e0 AS mean_apc, round(top, 6) AS top_mean, round(hi, 6) AS top_max, (SELECT count(*) FROM pool WHERE pool.replicate = st.replicate) AS n_rows FROM st""")
def scramble_within_groups(spark, sf_dir):
    """As ``scramble_replicates`` with sources permuted inside each right group, so that every replicate has as many rows."""
    return rounded(paired_replicates(spark, sf_dir, True), "mean_apc", "top_mean", "top_max")
