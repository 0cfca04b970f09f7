"""Exposed area, canonical numbers of chains and windows aligned anew, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridstat.functions.ordered import by_keys, sorted_by_keys
from gridstat.operators import mapping, star, structure
from gridstat.sources.scratch import stash

from .inputs import ALIGNED_SQL, BINS, aligned, aligned_rows
from .registry import query, rounded, table

#: Radii of points by their id, and of the probe, in units of the embeddings' space.
RADII = (0.02, 0.03, 0.05)
PROBE = 0.02
POINTS = 60

SPHERE_SQL = f"""u AS (SELECT cos(t) * sin(p) AS ux, sin(t) * sin(p) AS uy, cos(p) AS uz FROM (SELECT acos(1e0 - 2e0 * (k + 0.5e0) / {POINTS}) AS p, pi() * (1e0 + sqrt(5e0)) * (k + 0.5e0) AS t FROM range({POINTS}) AS s(k)))"""
ATOMS_SQL = f"""atoms AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, {PROBE}e0 + CASE vec_id % 3 WHEN 0 THEN {RADII[0]}e0 WHEN 1 THEN {RADII[1]}e0 ELSE {RADII[2]}e0 END AS r FROM embeddings)"""


@query(f"""WITH {SPHERE_SQL}, {ATOMS_SQL},
  near AS (SELECT a.vec_id, a.x - b.x AS dx, a.y - b.y AS dy, a.z - b.z AS dz, a.r, b.r AS rb FROM atoms a JOIN atoms b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) < (a.r + b.r) * (a.r + b.r)),
  hit AS (SELECT DISTINCT vec_id, ux, uy, uz FROM near, u WHERE (dx + r * ux) * (dx + r * ux) + (dy + r * uy) * (dy + r * uy) + (dz + r * uz) * (dz + r * uz) < rb * rb),
  n AS (SELECT vec_id, count(*) AS n FROM hit GROUP BY vec_id)
  SELECT label AS chain, CAST(vec_id // 4 AS INTEGER) AS residue, round(sum(4e0 * pi() * r * r * ({POINTS} - coalesce(n, 0)) / {POINTS}), 6) AS sasa FROM atoms LEFT JOIN n USING (vec_id) GROUP BY ALL""")
def exposed_area(spark, sf_dir):
    """Area of every four neighbouring vectors' spheres, in their first three dimensions, that no other vector of the label covers."""
    kind = F.col("vec_id") % 3
    radius = F.when(kind == 0, RADII[0]).when(kind == 1, RADII[1]).otherwise(RADII[2])
    atoms = table(spark, sf_dir, "embeddings").select(F.col("label").alias("chain"), F.floor(F.col("vec_id") / 4).cast("int").alias("residue"), *(F.col("embedding")[i].alias(c) for i, c in enumerate("xyz")), radius.alias("radius"))
    return rounded(structure.exposed_area(atoms, POINTS, PROBE), "sasa")


#: A letter's own score, that of its neighbours in the alphabet, and all others'.
SAME, NEXT, OTHER = 5.0, 1.0, -4.0
GAP_OPEN, GAP_EXTEND = -12.0, -1.0
LETTERS = "-" + "ABCDEFGHIJ"[:BINS]
SCORES = {(a, b): SAME if a == b else NEXT if abs(ord(a) - ord(b)) == 1 else OTHER for a in LETTERS for b in LETTERS}


def chains(spark, sf_dir):
    """Each row of the aligned matrix as a chain: places 8 to 55 are observed, but for a loop of six that moves with the id."""
    loop = F.lit(20) + (F.col("row_id") % 16).cast("int")
    seen = F.filter(F.sequence(F.lit(8), F.lit(55)), lambda c: ~c.between(loop, loop + 5))
    return aligned_rows(spark, sf_dir).select(
        F.col("row_id").alias("chain"), F.transform(seen, lambda c: c + 101).alias("numbers"), F.array_join(F.transform(seen, lambda c: F.substring("symbols", c + 1, F.lit(1))), "").alias("observed"), F.col("symbols").alias("canonical")
    )


@query(f"""WITH RECURSIVE {ALIGNED_SQL}, pr AS (SELECT row_id AS chain, list(symbol ORDER BY col_ix) AS b, list(symbol ORDER BY col_ix) FILTER (col_ix BETWEEN 8 AND 55 AND NOT col_ix BETWEEN 20 + row_id % 16 AND 25 + row_id % 16) AS a FROM cells GROUP BY row_id),
  st(chain, a, b, i, best, up, hi) AS (
    SELECT chain, a, b, 0, list_transform(range(len(b) + 1), lambda k: 0e0), list_transform(range(len(b) + 1), lambda k: -1e18), 0e0 FROM pr
    UNION ALL SELECT chain, a, b, i, w, up, greatest(hi, w[len(w)], CASE WHEN i = len(a) THEN list_max(w) ELSE 0e0 END) FROM (
      SELECT chain, a, b, i, hi, up, list_transform(range(1, len(b) + 2), lambda k: CASE WHEN k = 1 THEN 0e0 ELSE greatest(o[k], list_max(list_transform(range(1, k), lambda q: o[q] - {GAP_EXTEND}e0 * q)) + {GAP_OPEN}e0 + {GAP_EXTEND}e0 * (k - 1)) END) AS w FROM (
        SELECT chain, a, b, i, hi, up, list_transform(range(1, len(b) + 2), lambda k: CASE WHEN k = 1 THEN 0e0 ELSE greatest(up[k], best[k - 1] + CASE WHEN a[i] = b[k - 1] THEN {SAME}e0 WHEN abs(ascii(a[i]) - ascii(b[k - 1])) = 1 THEN {NEXT}e0 ELSE {OTHER}e0 END) END) AS o FROM (
          SELECT chain, a, b, i + 1 AS i, hi, best, list_transform(range(1, len(b) + 2), lambda k: CASE WHEN k = 1 THEN -1e18 ELSE greatest(best[k] + {GAP_OPEN}e0, up[k] + {GAP_EXTEND}e0) END) AS up FROM st WHERE i < len(a)))))
  SELECT chain, hi AS score FROM st WHERE i = len(a)""")
def alignment_scores(spark, sf_dir):
    """Score of the best alignment of every chain's observed letters with its canonical ones, by a substitution table."""
    return structure.alignment_scores(chains(spark, sf_dir), SCORES).select("chain", "score")


@query()
def canonical_numbers(spark, sf_dir):
    """The canonical place of every observed residue; which of equally good alignments gives it is a choice, so SQL does not state it."""
    return structure.map_to_canonical(chains(spark, sf_dir), SCORES)


#: Residues of each label's first row whose columns are the window.
FROM, TO = 11, 44
PIECES_SQL = f"""WITH {ALIGNED_SQL}, cmap AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY col_ix) AS residue FROM cells WHERE symbol <> '-'),
  cols AS (SELECT grp, col_ix FROM cmap JOIN (SELECT grp, min(row_id) AS row_id FROM cells GROUP BY grp) USING (grp, row_id) WHERE residue BETWEEN {FROM} AND {TO}),
  pieces AS (SELECT grp, row_id, string_agg(symbol, '' ORDER BY col_ix) AS piece FROM cmap JOIN cols USING (grp, col_ix) GROUP BY ALL HAVING count(*) >= 0.5e0 * ({TO} - {FROM}))"""


def window_pass(spark, sf_dir):
    """The first pass: residues of all rows, the window's columns, the pieces that rows have there, and each label's first row."""
    cmap = stash(mapping.coordinate_map(aligned(spark, sf_dir), ["grp", "row_id"]), "residues")
    first = stash(cmap.groupBy("grp").agg(F.min("row_id").alias("row_id")), "first")
    anchor = by_keys(cmap, first, ["grp", "row_id"])
    columns = stash(mapping.window_columns(anchor, F.lit(True), FROM, TO, ["grp"]), "columns")
    return cmap, columns, stash(mapping.window_extract(cmap, anchor, F.lit(True), FROM, TO, ["grp"]), "pieces"), first


def second_passed(pieces, first):
    anchors = by_keys(pieces, first, ["grp", "row_id"]).select("grp", F.col("piece").alias("anchor"))
    return star.star_alignment(pieces.withColumnRenamed("piece", "seq"), anchors, ["grp"], SCORES)


@query()
def second_pass(spark, sf_dir):
    """Windows cut out on each label's first row and aligned with it anew; which of equally good alignments is taken is a choice, so SQL does not state it."""
    _, _, pieces, first = window_pass(spark, sf_dir)
    return second_passed(pieces, first)


@query(f"{PIECES_SQL} SELECT grp, row_id, piece, true AS rectangular FROM pieces")
def second_pass_pieces(spark, sf_dir):
    """What rows of the second pass say without their gaps, which is what the first pass cut out, and whether they are as long as others of their label."""
    _, _, pieces, first = window_pass(spark, sf_dir)
    x = stash(second_passed(pieces, first), "aligned")
    size = x.groupBy("grp").agg(F.max(F.length("symbols")).alias("size"))
    return by_keys(x, size, ["grp"]).select("grp", "row_id", F.replace("symbols", F.lit("-"), F.lit("")).alias("piece"), (F.length("symbols") == F.col("size")).alias("rectangular"))


@query(f"{PIECES_SQL} SELECT grp, row_id, length(piece) AS n_mapped, 0 AS n_violations FROM pieces")
def second_pass_columns(spark, sf_dir):
    """Canonical residues mapped to columns of the second pass through the pieces, and how many of those columns hold another letter."""
    cmap, columns, pieces, first = window_pass(spark, sf_dir)
    x = stash(second_passed(pieces, first), "aligned")
    keys = ["grp", "row_id"]
    mapped = stash(star.canonical_columns(mapping.window_positions(cmap, columns, ["grp"]), x, keys), "mapped")
    letters = sorted_by_keys(by_keys(cmap, columns, ["grp", "col_ix"]), x.select(*keys), keys).select(*keys, "residue", F.col("symbol").alias("letter"))
    wrong = star.column_violations(mapped, x, letters, keys).groupBy(*keys).agg(F.count("*").alias("n_violations"))
    n = mapped.groupBy(*keys).agg(F.count("*").alias("n_mapped"))
    return sorted_by_keys(n, wrong, keys, "left").select(*keys, "n_mapped", F.coalesce("n_violations", F.lit(0)).cast("int").alias("n_violations"))
