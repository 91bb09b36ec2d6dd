"""Connected components of a graph of links, by alternating stars; every round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from centime.session import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every larger (else: smaller) neighbour of a node is linked to the smallest one. edges has a > b."""
    both = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    met = both.join(least, "a")
    if large:
        linked = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return linked.where("a <> b").distinct()


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root): of links (a, b), every node that has one, with the smallest node it is connected to.

    Null ends and links to itself are left out; direction and repetition do not
    matter. Rounds grow with the logarithm of the longest path. Group minima are
    combined before the shuffle, so a node with very many links is no hot spot.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = durable(edges, "edges")
    before = None
    for _ in range(most_rounds):
        edges = durable(_star(_star(edges, large=True), large=False), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
