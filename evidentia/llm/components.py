"""Connected components of a graph too large for one machine: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ._shared import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b): the smallest node that it reaches.

    Each step is an aggregation that combines before its shuffle and a join against its written result, so that both sides
    of the join are plain shuffles, whose skewed keys Spark splits: a hub with very many neighbours is no unbounded group. Edges are written after each round; rounds grow with the
    logarithm of the longest path.
    """
    edges, state = _ordered(edges), None
    while True:
        seen = Observation()
        sum_of = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        edges = written(_small_star(_large_star(edges)).observe(seen, F.count("*").alias("n"), sum_of.alias("sum")), "edges")
        if seen.get == state:
            break
        state = seen.get
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b")).distinct()


def _ordered(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each larger neighbour of a node to the smallest node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Links each smaller neighbour of a node, and the node, to the smallest of them."""
    edges = written(edges, "edges")
    least = written(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _ordered(moved.union(least.select("a", "m")))
