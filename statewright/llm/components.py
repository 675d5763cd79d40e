"""Connected components by alternating large-star and small-star rounds over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Links that one task handles in a round.
ROWS = 200_000


def _least(links: DataFrame) -> DataFrame:
    """links (u, v) with m, the smallest of u and its neighbours. The grouping is summed before it is shuffled."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return links.join(least, "u")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of links (undirected, any order, repeats allowed): root is its component's smallest node.

    Null ends are ignored, a link of a node to itself makes a component of one. The rounds end when the
    links are the same as a round before, at stars around the roots.
    """
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null")
    loops = ends.where("x = y").select(F.col("x").alias("node")).distinct()
    edges = staged(ends.where("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "cc-links")
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == seen or now[0] == 0:
            break
        seen = now
        # Few links need few tasks and files; a task gets up to ROWS of them.
        parts = max(1, -(-now[0] // ROWS))
        edges = edges.coalesce(parts)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = staged(_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct().coalesce(parts), "cc-large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(parts), "cc-small")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
    alone = loops.select("node", F.col("node").alias("root"))
    return stars.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("root").alias("root"))
