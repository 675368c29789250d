"""Connected components by alternating stars, on frames of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from orderlake.llm.common import cut, forget


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest reachable node) of every node of the edges ``a``, ``b``; null ends and loops don't count.

    Large star: every node hands its smallest neighbour to its larger ones; small star: to its smaller ones. Either
    keeps the components, and edges end up pointing from every node to the smallest. Each round is written to the shared
    folder. Minima are combined before they are sent, so a node with very many edges is no burden; the join that
    hands them back can be split.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # at the end every node but the smallest has one edge, to the smallest
        seen = now.agg(F.count("*").alias("n"), F.count_distinct("u").alias("nodes")).first()
        if seen["n"] == seen["nodes"] and now.join(now.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        old, now = now, cut(small.where("u <> v").distinct())
        forget(old)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
