"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(node, root)``: root is the smallest node reachable; nodes without an edge to another are absent.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest neighbour; a chain of n nodes
    needs about log n rounds, and none is spent on a graph of stars. Rounds are tables in the shared folder, and so are the
    smallest neighbours: both sides of a join are then plain shuffles, whose hot keys (a node with very many links) adaptive
    execution splits. Whether a node is left that has two larger ends, or both kinds, is all that reaches the driver.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    links = stored(links, "links")
    while True:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        nodes = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") < F.col("u")).alias("below"), F.max("v").alias("top"))
        least = stored(nodes.select("u", F.least("u", "m").alias("m"), ((F.col("below") > 1) | (F.col("below") == 1) & (F.col("top") > F.col("u"))).alias("open")), "least")
        if not least.filter("open").limit(1).count():
            discard(least)
            break
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = stored(large, "links")
        discard(links, least)
        least = stored(large.groupBy("hi").agg(F.min("lo").alias("m")), "least")
        small = large.join(least, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("x"))
        links = stored(small.select("x.hi", "x.lo").filter("hi <> lo").distinct(), "links")
        discard(large, least)
    return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(links.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
