"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step joins a node's edges with the least neighbour of the node, which is a
combinable aggregate; the edges of a node with very many are cut (``spread``), so
that one with a third of all edges is not brought into one task.  Every round is
written into the shared folder; nothing is collected but two numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstat.sources.scratch import discard, stash

from . import spread


def _star(edges: DataFrame, large: bool, hot: DataFrame | None) -> DataFrame:
    """Edges (hi, lo), hi > lo.  Large: a node's larger neighbours go to its least; small: its smaller ones and itself do."""
    if large:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    else:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.select("u", F.least("u", "m").alias("m"))
    out = both.join(least, "u") if hot is None else spread.join(both, least, hot, ["u"], F.col("v"))
    if large:
        out = out.filter(F.col("v") > F.col("u")).select(F.col("v").alias("hi"), F.col("m").alias("lo"))
    else:
        out = out.select(F.col("v").alias("hi"), F.col("m").alias("lo")).unionByName(least.select(F.col("u").alias("hi"), F.col("m").alias("lo")))
    return out.filter(F.col("hi") > F.col("lo"))


def _degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("hi").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("lo").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int | None = None) -> DataFrame:
    """(node, root) for every node with an edge to another; root is the least node of its component.

    With ``rounds`` at most so many are made: nodes with one root then belong together, but a component may have several.
    The number of rounds that settle a graph grows with the logarithm of its size.
    """
    now = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter(F.col("hi") > F.col("lo")).distinct()
    now = stash(now, "edges")
    done = 0
    while rounds is None or done < rounds:
        # settled: each node above another has only one below it, and none is both above and below another
        open_ = F.max(((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).cast("int"))
        state = _degrees(now).agg(open_.alias("open"), F.max(F.col("up") + F.col("down")).alias("most")).first()
        if not state["open"]:
            break
        # large stars give a node no more smaller neighbours than it had neighbours
        hot = spread.hot_keys(_degrees(now).withColumn("n", F.col("up") + F.col("down")), ["u"]) if state["most"] > spread.EACH else None
        old, now = now, stash(_star(_star(now, True, hot), False, hot).distinct(), "edges")
        discard(old, hot)
        done += 1
    else:
        # of several below one node the least
        now = now.groupBy("hi").agg(F.min("lo").alias("lo"))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
