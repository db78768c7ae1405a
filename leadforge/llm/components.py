"""Connected components of an edge table, by alternating large and small stars.

Only edges move: no adjacency list is collected, minima are pre-aggregated and stored, so that the join
back to the edges is a broadcast up to a counted size, and beyond it one of two plain shuffles, of which adaptive execution can split a hub; every round is
stored in the shared folder, and removed when the next one is. Rounds end when every node that is not the smallest of
its component has one edge, to a node that has none to a smaller one.

Defined cases: edges of a node to itself and repeated edges count for nothing; edges with a null end are
left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadforge.llm.common import remove, shared_dir, small, stored


def _star(edges: DataFrame, large: bool, folder: str) -> DataFrame:
    """One round of stars over edges (a, b); its minima are stored in ``folder``."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    least = small(stored(least, "large" if large else "small", folder))
    met = near.join(least, near["a"] == least["k"])
    if large:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether all of the distinct edges (a, b), a above b, lead to the middle of a star."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("middle")).unionByName(edges.select(F.col("b"), F.lit(0), F.lit(1)).toDF("node", "up", "middle"))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("middle").alias("middle")).where("up > 1 OR (up = 1 AND middle = 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node of its component."""
    spark = edges.sparkSession
    folder = shared_dir(spark)
    edges = stored(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", folder)
    while not _are_stars(edges):
        before, folder = folder, shared_dir(spark)
        edges = stored(_star(_star(edges, True, folder), False, folder), "edges", folder)
        remove(spark, before)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
