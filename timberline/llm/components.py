"""Connected components over links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(edges: DataFrame, rounds: int = 60, roots: bool = True) -> DataFrame:
    """edges: u, v, of any ordered type. Returns node, root: the smallest node reachable, for each node with a link (without roots: that isn't the smallest itself).

    A round hangs every larger neighbour, then every smaller one, on the smallest neighbour. Each round is written,
    so lineage stays short; the number of rounds grows with the logarithm of the longest path. Links of a node are
    reduced to their smallest end before the shuffle.
    """
    spark = edges.sparkSession
    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    for _ in range(rounds):
        both = _both(now)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v")))
        nxt = written(moved.where("u != v").distinct(), "edges")
        new_mark = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(spark, now)
        now = nxt
        if new_mark == mark:
            break
        mark = new_mark
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    hung = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return hung.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()) if roots else hung
