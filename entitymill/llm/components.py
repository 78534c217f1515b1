"""Connected components of a link table, as alternating star contractions in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Every larger neighbour of a node is hung on the node's smallest neighbour; a node without a smaller one keeps its own."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.put(edges.groupBy("u").agg(F.min("v").alias("m")), name)
    return both.where("v > u").join(least, "u", "left").select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are hung on the smallest of them."""
    least = scratch.put(edges.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")), name)
    # a node with one neighbour moves nothing
    moved = edges.join(least.where("m < most"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(links: DataFrame, scratch: Scratch, name: str, most_rounds: int = 60) -> DataFrame:
    """``links(a, b)`` to ``(node, component)`` for every linked node; the component is its smallest node.

    Each round shuffles the remaining links twice and writes them; the number
    of rounds grows with the logarithm of the longest chain. Groupings are
    partial minima. They are written before they are joined back, so that the
    join is no part of the grouping's stage: small minima are broadcast, and for
    large ones adaptive execution splits a hub with very many links.
    Null ends and self links are ignored; no links give an empty table.
    """
    edges = scratch.put(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    seen = None
    for k in range(1, most_rounds):
        large = scratch.put(_large_star(edges, scratch, f"{name}-{k}-least"), f"{name}-{k}-large")
        edges = scratch.put(_small_star(large, scratch, f"{name}-{k}-low"), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}", *(f"{name}-{k}-{part}" for part in ("least", "large", "low")))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
