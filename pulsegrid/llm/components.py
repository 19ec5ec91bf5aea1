"""Connected components over an edge table, as alternating star contractions in Spark.

Each round replaces every neighbour of a node by the smallest node it knows (first for larger, then for smaller
neighbours). Rounds are written to the shared folder, so a lost executor costs one round at most, and the round before goes;
nothing of the graph passes the driver but two counters a round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _stars(edges: DataFrame) -> DataFrame:
    """One round; edges (u, v) with u > v in and out."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.where("u > v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(u, v: long, any direction, repeats and loops allowed) -> (node, root): root is the smallest node reachable.

    Nodes without an edge to another node are not in the result. An empty table gives an empty table.
    """
    tidy = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = stored(tidy, "edges"), None
    while True:
        n, mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if n == 0 or (n, mark) == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = (n, mark)
        last, now = now, stored(_stars(now), "stars")
        forget(last)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a[i]-b[i]: the smallest node of each node's component."""
    root = np.arange(n)
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], least)
        np.minimum.at(new, root[b], least)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        new = new[root]
        if np.array_equal(new, root):
            return root
        root = new
