"""Connected components of a graph given as links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonalis.materialise import discard, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of a link, with the smallest node of its component.

    Alternating large-star and small-star steps; links are kept as pairs (node, smaller node) and the graph shrinks to stars
    in a number of rounds that grows with the logarithm of its size. Self links give a component of one; null ends
    are left out; an empty table gives an empty result.

    Plan: each half step is a minimum per node (combined before the shuffle) joined back to the links; a hub's links are split
    by the skew join, its other side being one row. Every round is written to the shared folder, the round before is deleted.
    """
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    loops = ends.filter("u = v").select("u")
    now = materialise(ends.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        half = materialise(large, "large")
        low = half.groupBy("u").agg(F.min("v").alias("m"))
        small = half.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        nxt = materialise(small, "small")
        discard(half)
        discard(now)
        now = nxt
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if mark == seen:
            break
        seen = mark
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("root"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).unionByName(alone).groupBy("node").agg(F.min("root").alias("root"))
