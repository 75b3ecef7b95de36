"""Connected components by alternating large and small stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Points neighbours at the smallest node of each neighbourhood, which is found by an aggregate; Spark splits the join of a hub that is too large for one task."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    near = both.join(low, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v")))
    return out.where("u != v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id, component (the smallest id reachable) of every node of edges (u long, v long); reads tables of the scratch."""
    edges = scratch.save(edges.where("u != v").distinct(), "cc")
    seen = None
    while True:
        edges = scratch.save(_star(_star(edges, True), False), "cc")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())
        if now == seen or not now[0]:
            break
        seen = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
