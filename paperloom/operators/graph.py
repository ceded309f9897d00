"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def connected(edges: DataFrame) -> DataFrame:
    """(x, component): for every node of edges (a, b) the smallest node that it can reach.

    Every node keeps a pointer to a smaller node, or to itself: then it is a root. A round hangs each root below its smallest
    neighbour, if that is smaller, lets pointers skip ahead twice (so paths shorten fourfold), and moves edges to where their ends point; edges
    within one tree go. A long chain takes about as many rounds as its length has binary digits. Only whether an edge is left reaches the driver.
    """
    near = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    nodes = near.select(F.explode(F.array("a", "b")).alias("x")).distinct()
    to = cut(nodes.withColumn("p", F.col("x")))
    while not near.isEmpty():
        least = near.select("a", "b").unionAll(near.select("b", "a")).groupBy("a").agg(F.min("b").alias("m")).where("m < a")
        hung = to.join(least, F.col("x") == F.col("a"), "left").select("x", F.when(F.col("p") == F.col("x"), F.coalesce("m", "p")).otherwise(F.col("p")).alias("p"))
        for _ in range(2):
            hung = cut(hung)
            up = hung.select(F.col("x").alias("p"), F.col("p").alias("q"))
            hung = hung.join(up, "p").select("x", F.col("q").alias("p"))
        to = cut(hung)
        ends = lambda c: to.select(F.col("x").alias(c), F.col("p").alias(f"p{c}"))
        near = near.join(ends("a"), "a").join(ends("b"), "b").where("pa <> pb")
        near = cut(near.select(F.greatest("pa", "pb").alias("a"), F.least("pa", "pb").alias("b")).distinct())
    while True:  # the last pointers may still lead to a root by steps
        up = to.select(F.col("x").alias("p"), F.col("p").alias("q"))
        moved = cut(to.join(up, "p").select("x", "p", "q"))
        if moved.where("p <> q").isEmpty():
            return to.select("x", F.col("p").alias("component"))
        to = moved.select("x", F.col("q").alias("p"))
