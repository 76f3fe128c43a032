"""Connected components of a table of links, for links that may chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.llm.common import saved


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the node's smallest one."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(
        "a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(
        F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """A node and its smaller neighbours link to the smallest of them."""
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    moved = pairs.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that ``links`` (a, b) names: root is the least
    node of its component.

    Alternates the two star steps until no link changes, a logarithmic number of
    rounds; each is written to the shared folder.  A hub's links are never in one
    group: the steps are a grouped minimum (combined before the shuffle) and a
    join against it (split by the skew join)."""
    pairs = saved(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                  .where("a > b").distinct())
    mark = _mark(pairs)
    while True:
        pairs = saved(_small_star(_large_star(pairs)))
        now = _mark(pairs)
        if now == mark:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = now


def _mark(pairs: DataFrame) -> tuple:
    """Count and order-free digest of the links."""
    row = pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")),
                    F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first()
    return tuple(row)
