"""Connected components by alternating stars, each round a few joins over a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from belegwerk.workspace import Workspace


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(u, v)`` but the roots: the smallest node it reaches.

    A large-star step links each node's larger neighbours to the smallest neighbour, a small-star
    step does so with the smaller ones. Edges never grow in number, and the rounds grow with the
    logarithm of the longest path. Every step is a join on a key whose other side has one row a
    key, so Spark can split a node with very many edges.
    """
    now = ws.stage(edges.where("u <> v").select("u", "v").distinct(), "edges")
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = ws.stage(large.where("u <> v").distinct(), "large")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        now = ws.stage(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        # Done when every node has one link and no node at the upper end is at a lower end too.
        degrees = now.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        inner = now.join(now.select(F.col("v").alias("u")).distinct(), "u", "left_semi")
        if degrees.select("u").union(inner.select("u")).isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
