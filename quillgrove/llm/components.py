"""Connected components of links between ids, by alternating star contractions in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, component): the smallest id reachable, for each id that has a link.

    `links` has columns a and b. Each round hangs neighbours under the smallest id around
    them, so paths shorten by a factor; the minimum of each id is pre-aggregated before its
    shuffle and joined back, so a hub is never one task's group. Rounds end when nothing changed.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("p")).distinct())
    before = None
    for _ in range(max_rounds):
        # Large star: every larger neighbour of u goes under the smallest id around u.
        both = edges.select(F.col("v").alias("u"), F.col("p").alias("n")).unionAll(edges.select(F.col("p").alias("u"), F.col("v").alias("n")))
        low = both.groupBy("u").agg(F.least(F.min("n"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("n > u").select(F.col("n").alias("v"), F.col("m").alias("p")).where("v <> p").distinct()
        # Small star: every smaller neighbour of v, and v, goes under the smallest of them.
        least = large.groupBy("v").agg(F.min("p").alias("m"))
        small = large.join(least, "v")
        edges = cut(small.where("p <> m").select(F.col("p").alias("v"), F.col("m").alias("p")).unionAll(least.select("v", F.col("m").alias("p"))).distinct())
        # A forest of stars with the same sum of parents twice is a fixed point: parents only fall.
        state = edges.agg(F.count("*"), F.sum(F.col("p").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components aren't settled after {max_rounds} rounds")
    roots = edges.select(F.col("p").alias("node"), F.col("p").alias("component")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("p").alias("component")).unionAll(roots)
