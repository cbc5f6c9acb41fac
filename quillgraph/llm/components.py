"""Connected components by alternating large-star and small-star joins; links and labels stay in the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, component`` (its smallest node) of every node of ``links(a, b)``.

    Each round points every node's larger neighbours at the smallest node around it, then
    its smaller ones; the number of rounds grows with the logarithm of the longest chain.
    Every round is a stored table, so lineage stays short. No links: no rows.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = store(edges, "cc")
    for _ in range(max_rounds):
        before = edges
        # large star: all neighbours above u go to the smallest of u and its neighbours
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and the neighbours below it go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(low, "u")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = store(small.where("u <> v").distinct(), "cc")
        if edges.exceptAll(before).isEmpty() and before.exceptAll(edges).isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    tops = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))
