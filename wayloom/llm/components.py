"""Connected components of an edge table: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import settled


def _same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables of distinct edges are equal."""
    return a.count() == b.count() and a.join(b, ["u", "v"], "left_anti").isEmpty()


def _large(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to its least neighbour (itself counts)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node ties itself and its smaller neighbours to the least of them.  Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component), for all nodes that have an edge.

    edges: u long, v long; either order, loops and repeats allowed.  Only
    sums by key and joins: a star of any size is split by skew handling.
    """
    edges = settled(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct())
    while not edges.isEmpty():
        before, edges = edges, settled(_small(_large(edges)))
        if _same(edges, before):
            break
    tied = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return tied.union(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
