"""Connected components of a graph in a DataFrame, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, staged


def _stars(edges: DataFrame) -> DataFrame:
    """One round on ``edges(u, v)`` with ``u > v``; joins with one row per node, so a hub is never gathered."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least.hint("merge"), "u").select("v", "m").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` of longs -> ``node, component``: the least node reachable, for every node with a link.

    Self-links and repeated links do no harm; nodes that are their own
    component's least one are not listed.  The result is a table of ``staged``;
    those of the rounds before are deleted.
    """
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = state(edges)
    while now[0]:
        old, edges = edges, staged(_stars(edges), "edges")
        drop(old)
        before, now = now, state(edges)
        if before == now:
            break
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found._scratch = edges._scratch
    return found
