"""Connected components of an edge table, as alternating large-star and small-star joins (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threatframe.llm.common import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): link each node's neighbours (larger ones, or smaller ones) to its least neighbour."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    if large:  # only here a hot node has many rows; a fresh exchange on both sides lets its partition be split
        least = staged(least, "least")
    linked = edges.join(least, "u")
    if large:
        return linked.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
    own = linked.select("u", F.col("m").alias("v"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, label): every node of an edge with the least node of its component.

    Every round is written to the shared folder. A hot node's edges are joined on the node, which adaptive execution
    splits; its minimum is aggregated before the shuffle.
    """
    down = lambda e: e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v")
    now = staged(down(now).distinct(), "edges")
    mark = None
    while True:
        # sum of hashes and count name the edge set
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        now = staged(down(_star(both, True)), "edges")
        now = staged(down(_star(now, False)), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
