"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import materialized


def _sum(edges: DataFrame) -> tuple:
    """A number pair that changes when the set of edges does."""
    low = F.xxhash64("u", "v").bitwiseAND(0xFFFFFFFF)
    return tuple(edges.agg(F.count("*"), F.sum(low)).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of a link, the component being its smallest node.

    Steps only take minima per node, in aggregates that combine before the shuffle, and one
    join; no group is collected. Each round is written to the shared folder. Links of a node
    to itself and links with a null are ignored.
    """
    high, low = F.greatest(a, b), F.least(a, b)
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = pairs.select(high.alias("u"), low.alias("v")).where("u <> v").distinct()
    edges = materialized(edges, "links")
    before = None
    while (now := _sum(edges)) != before:
        before = now
        if not now[0]:
            break
        edges = materialized(_small(_large(edges)), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
