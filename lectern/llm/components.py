"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import few_tasks, pin


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, its component's smallest node, from edges ``a``, ``b``.

    Alternates two rounds until every edge links a node to its root: every node's larger neighbours, then
    its smaller ones, are linked to the smallest neighbour. The edges stay at most as many as they were,
    each round moves two ids per edge, and long chains shorten by half or better. Edges live in the shared
    folder between rounds. Nodes without an edge to another node are not returned.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # Tasks follow the number of edges, not the partitions of the frame they were found in.
    rows = edges.count()

    def few(df: DataFrame) -> DataFrame:
        return few_tasks(df, rows)

    edges = pin(few(few(edges).distinct()))
    while not _are_stars(edges, few):
        both = edges.union(edges.select("b", "a"))
        least = pin(few(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = pin(few(few(large).distinct()))
        least = pin(few(large.groupBy("a").agg(F.min("b").alias("m"))))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = pin(few(few(small).union(least.select("a", F.col("m").alias("b"))).distinct()))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _are_stars(edges: DataFrame, few: Callable[[DataFrame], DataFrame]) -> bool:
    """Whether no larger end of an edge has another edge. Then each smaller end is its component's smallest node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("larger")).union(edges.select("b", F.lit(0)))
    met = few(ends.groupBy("node").agg(F.sum("larger").alias("larger"), F.count(F.lit(1)).alias("n")))
    return met.where("larger > 0 and n > 1").isEmpty()
