"""Connected components of an edge table, by alternating large and small stars.

Each round is two grouped minima, whatever the degree of a node: a hub with a million
edges sends one row for each of them. Rounds are written to the shared folder, so that
a lost executor costs one round's tasks. The number of rounds follows the logarithm of
the largest component's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("b"), F.col("m").alias("a")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge points from the larger node b to the smaller a
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").filter("a <> m").select(F.col("a").alias("b"), F.col("m").alias("a"))
    return moved.unionByName(least.select("b", F.col("m").alias("a"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(b, a): each node of the edges (a, b) that isn't the least of its component, and
    that least node. Null ends and loops count for nothing. A round's table goes once the
    next one is written."""
    edges = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).distinct()
    current, path = C.written(edges, "edges")
    before = None
    while True:
        mark = current.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint"))).first()
        if mark == before or not mark[0]:
            return current
        before, old = mark, path
        current, path = C.written(_small_star(_large_star(current)), "edges")
        C.remove_path(current.sparkSession, old)
