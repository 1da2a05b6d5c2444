"""Connected components of edges between long ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) -> node, root: each node that has an edge to another, and the smallest id it reaches, itself included.

    Both steps need the least neighbour of each node, which is aggregated before the shuffle, so a node with
    very many edges is no more work for a task than others; the join that hands it back is one that adaptive
    execution splits. They are merge joins whatever their size: nothing of them goes through the driver. The number of rounds grows with the logarithm of the longest path.

    Edges that a round has moved are marked: a round that moves none had stars only, and ends the work. Equal edges
    are one from the next round on, as each node keeps one edge to its least neighbour, so they aren't sought by a shuffle of their own.
    The driver keeps memory for each plan and each shuffle, so a round is one plan with four.
    """
    now = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    moved = True
    while moved:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"), (F.col("m") < F.col("u")).alias("moved"))
        least = large.groupBy("u").agg(F.min("v").alias("v"), F.max("moved").alias("moved"))
        small = large.select("u", "v").join(least.select("u", F.col("v").alias("m")).hint("merge"), "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"), F.lit(True).alias("moved"))
        new = written(small.unionByName(least))
        dropped(now)
        now = new
        moved = not now.filter("moved").isEmpty()
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
