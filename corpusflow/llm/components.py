"""Connected components of a table of links, by alternating star contractions.

Each round joins labels along links with partial aggregates; ids stay in tables,
every round is stored in the shared folder, and the driver sees one count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that a link names; component is the smallest node reachable.

    A round lets every node hand the smallest label of its neighbourhood to its
    larger neighbours (large star) and then to its smaller ones (small star).
    Label trees flatten at each, so rounds grow with the logarithm of a chain's
    length, and a node of many links only passes its minimum, which partial
    aggregates take before the shuffle.
    """
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: each larger neighbour v of u links to the least of u's neighbourhood
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: each smaller neighbour of u, and u, link to the least of them
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(below, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(below.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = stored(small)
        discard(edges)
        edges = new
        # done when every node has one label and no label has one of its own
        manifold = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
        chained = edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi")
        if not manifold.union(chained).limit(1).count():
            break
    out = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return out.union(edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node")))
