"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traceloom.session import pin


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of the links, component being the smallest node it reaches.

    Links may repeat, run either way or join a node to itself; nulls are left out.  Each round
    moves links towards smaller nodes with two grouped minima, which are combined before the
    shuffle, so a node with very many links does not gather them in one task.  The number of
    rounds grows with the logarithm of the longest chain.  Every round is a table in the shared
    folder.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    links = pin(links.where("u <> v").distinct())
    seen = _mark(links)
    while seen[0]:
        links = pin(_small_star(pin(_large_star(links))))
        now = _mark(links)
        if now == seen:
            break
        seen = now
    # now every link leads from a node to the smallest of its component
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest neighbour of that node."""
    both = links.select("u", "v").unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = pin(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    up = both.where("v > u").join(least, "u")
    return up.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest neighbour."""
    least = pin(links.groupBy("u").agg(F.min("v").alias("m")))
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
