"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.storage import checkpoint


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) for every node of edges(a, b); component is the smallest node it reaches.

    Alternates the large-star and small-star steps, each a grouped minimum and a join, and cuts the
    lineage after every round. Edges of a node are never gathered in one row. Nodes without an edge to
    another node don't appear. Null ends and self-links are dropped; no edges give an empty table."""
    links = checkpoint(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .filter("u is not null and v is not null and u <> v")
        .distinct()
    )
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)))
    before = links.agg(mark.alias("m")).first()["m"]
    if before[0] == 0:
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        )
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        links = checkpoint(small)
        after = links.agg(mark.alias("m")).first()["m"]
        if after == before:
            return stars(links)
        before = after
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def stars(links: DataFrame) -> DataFrame:
    """Members and centres of links(u, v), where every u points at its smallest node v."""
    return (
        links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), "v"))).alias("e"))
        .select(F.col("e.u").alias("node"), F.col("e.v").alias("component"))
        .distinct()
    )
