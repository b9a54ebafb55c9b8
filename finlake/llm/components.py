"""Connected components of a link table by alternating large-star and small-star rounds. Links never
leave the executors; only their number and a changed flag reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node links to the node's smallest neighbour (or itself)."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node's smaller neighbours and the node itself link to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for each node that has a link; ``root`` is the smallest node reachable.

    ``links`` has columns a and b of one orderable type; repeated links, links of a node to itself
    and an empty table are fine, links with a null end are none. Rounds stop once nothing changes;
    components with n nodes need about log(n)^2 of them."""
    links = cut(links.filter("a is not null and b is not null and a <> b").select("a", "b").distinct())
    before = None
    for _ in range(rounds):
        links = cut(_small_star(_large_star(links)))
        state = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
