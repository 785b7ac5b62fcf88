"""Connected components of a table of links, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.common import stored

MAX_ROUNDS = 60  # a guard against endless work; the steps need about the logarithm of the longest path


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is linked to the least node around it."""
    both = _both(links)
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    rest = down.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return rest.union(least.select("a", F.col("least").alias("b"))).filter("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, least): every node of links (a, b) and the least node reachable from it. Links stay in tables throughout."""
    now = stored(links.select("a", "b").filter("a <> b").distinct(), "links")
    seen = None
    for _ in range(MAX_ROUNDS):
        now = stored(_small_star(_large_star(now)), "links")
        state = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())
        if state == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("least")).union(now.select("b", "b").distinct())
        seen = state
    raise RuntimeError(f"components not settled in {MAX_ROUNDS} rounds")
