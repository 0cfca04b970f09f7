"""Checks of the matrix, its maps and its weights, counted while the tables are written."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridstat.operators import checks as ck
from gridstat.operators import mapping as mp
from gridstat.operators import matrix as m
from gridstat.sources.scratch import stash

from .inputs import ALIGNED_SQL, MODULES, aligned, aligned_rows
from .registry import query

KEYS = ["grp", "row_id"]
#: Required features of a column, and those of another family.
REQUIRED, FOREIGN = ["body", "head"], ["tail"]


@query(f"""WITH {ALIGNED_SQL}, residues AS (SELECT * FROM cells WHERE symbol <> '-'), anchor AS (SELECT grp, min(row_id) AS row_id FROM cells GROUP BY grp),
  cols AS (SELECT c.grp, c.col_ix, c.symbol <> '-' AS anchored, col_ix <= 29 AS required, col_ix BETWEEN 30 AND 39 AS strange FROM cells c JOIN anchor USING (grp, row_id)),
  prov AS (SELECT grp, count(*) FILTER (anchored) AS n, count(*) FILTER (anchored AND NOT required) AS outside, count(*) FILTER (strange) AS strange FROM cols GROUP BY grp),
  g AS (SELECT count(DISTINCT grp) AS n FROM cells), r AS (SELECT count(*) AS n FROM residues),
  shifted AS (SELECT count(*) FILTER (symbol IS DISTINCT FROM nxt) AS wrong FROM (SELECT symbol, lead(symbol) OVER (PARTITION BY row_id ORDER BY col_ix) AS nxt FROM residues)),
  last AS (SELECT count(DISTINCT row_id) AS n FROM residues)
  SELECT 'matrix' AS part, 'rows of a group differ in length' AS "check", n AS n_rows, 0 AS n_wrong FROM g
  UNION ALL SELECT 'weights', unnest(['a weight is not finite', 'weights sum to nothing']), n, 0 FROM g
  UNION ALL SELECT 'map', unnest(['a canonical residue is not mapped once', 'a column holds another letter', 'a column leads back to another residue']), n, 0 FROM r
  UNION ALL SELECT 'moved', 'a canonical residue is not mapped once', r.n, last.n FROM r, last
  UNION ALL SELECT 'moved', 'a column holds another letter', r.n, shifted.wrong FROM r, shifted
  UNION ALL SELECT 'moved', 'a column leads back to another residue', r.n, last.n FROM r, last
  UNION ALL SELECT 'columns', 'a fifth of the anchored columns lie outside the required features', count(*), count(*) FILTER (NOT outside < 0.2e0 * greatest(n, 1)) FROM prov
  UNION ALL SELECT 'columns', 'columns carry features of another family', count(*), count(*) FILTER (strange > 0) FROM prov""")
def audited_matrix(spark, sf_dir):
    """How many rows each check of the matrix judged and found wrong; ``moved`` is a map that is off by one residue, which the checks have to find."""
    cells = stash(aligned(spark, sf_dir), "cells")
    cmap = stash(mp.coordinate_map(cells, KEYS), "residues")
    letters = cmap.select(*KEYS, "residue", F.col("symbol").alias("letter"))
    moved = cmap.withColumn("residue", F.col("residue") - 1).filter("residue > 0")
    first = stash(cells.groupBy("grp").agg(F.min("row_id").alias("row_id")), "first")
    anchored = cells.join(first, KEYS).select("grp", "col_ix", (F.col("symbol") != m.GAP).alias("anchored"))
    parts = {
        "matrix": (ck.extents(aligned_rows(spark, sf_dir), ["grp"]), ck.RECTANGULAR),
        "weights": (ck.weight_sums(m.henikoff_weights(cells, ["grp"]), ["grp"]), ck.WEIGHED),
        "map": (ck.round_trips(cmap, cmap, letters, KEYS), ck.ROUND_TRIP),
        "moved": (ck.round_trips(moved, moved, letters, KEYS), ck.ROUND_TRIP),
        "columns": (ck.provenance_counts(mp.column_features(anchored, MODULES), ["grp"], REQUIRED, FOREIGN), ck.PROVENANCE),
    }
    found = [(part, name, *n) for part, (df, checks) in parts.items() for name, n in ck.audit(df, checks, part)[1].items()]
    return spark.createDataFrame(found, "part string, check string, n_rows long, n_wrong long")
