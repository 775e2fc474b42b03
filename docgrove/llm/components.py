"""Connected components by large-star and small-star rounds, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import durable, scratch


def _state(edges: DataFrame) -> tuple:
    """What tells two sets of edges apart."""
    h = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.bit_xor(F.xxhash64(h, F.lit(1)))).first())


def _stars(edges: DataFrame) -> DataFrame:
    """One round: larger neighbours move to a node's least neighbour, then smaller ones do."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
    large = durable(large, "large-stars")
    least = large.groupBy("b").agg(F.min("a").alias("m"))
    small = large.join(least, "b").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return small.union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in links(a, b); component is the least node reachable.

    Least neighbours are sums that combine before they travel, and they meet the edges
    in a join of one row per node, which Spark splits where a node has very many edges:
    no node gathers its neighbours in one task.  Rounds end when the edges no longer
    change; then they are stars around the least nodes.  Edges from a node to itself
    are ignored, repeated ones count once; no links give no rows.
    """
    with scratch(links.sparkSession) as keep:
        edges = durable(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        before = _state(edges)
        while before[0]:
            edges = durable(_stars(edges), "stars")
            after = _state(edges)
            if after == before:
                break
            before = after
        found = edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
        return keep(found, "components")
