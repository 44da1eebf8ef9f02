"""Connected components over an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint


def _star(edges: DataFrame, to_larger: bool) -> DataFrame:
    """Link the neighbours of each node u, and u itself, to the smallest of them. edges: (u, v)."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    both = edges.join(least, "u")
    if to_larger:
        out = both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = both.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for each node with an edge to another: root is the smallest node reachable.

    Each round costs a logarithmic share of the remaining depth; all rows stay in tables, joins may be split
    where a node has very many edges, and each round ends in a checkpoint. No edges: an empty table.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links, before = checkpoint(links), None
    while True:
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not state[0] or state == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(links.select("v", "v").distinct())
        before = state
        both = links.union(links.select("v", "u"))
        large = _star(both, True)
        links = checkpoint(_star(large, False))
