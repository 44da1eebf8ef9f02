"""Paths between functions by name, with what guards them and what state they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions import payload as p
from graphloom.operators.match import display_labels, staged_match
from graphloom.operators.traverse import simple_paths, traversal_edges


def call_paths(nodes: DataFrame, edges: DataFrame, from_name: str, to_name: str, max_depth: int = 15, max_paths: int = 10, max_matches: int = 20, production_only: bool = False) -> DataFrame:
    """(start, end, path, length, labels): simple paths from any match of one name to any match of the other, the shortest first."""
    scope = nodes.where(~p.is_research("metadata")) if production_only else nodes
    ends = []
    for name in (from_name, to_name):
        found = staged_match(nodes, name, production_only=production_only).orderBy("id").select("id")
        ends.append(found.limit(max_matches) if max_matches else found)
    steps = traversal_edges(edges)
    if production_only:
        inside = scope.select("id")
        steps = steps.join(inside.withColumnRenamed("id", "source"), "source", "left_semi").join(inside.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target")
    found = simple_paths(*ends, steps, max_depth, max_paths).orderBy("length", "start", "end", F.array_join("path", "\x00"))
    if max_paths:
        found = found.limit(max_paths)
    return labelled(found, scope)


def labelled(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """paths with labels, the shown label of each node (its id where it has none)."""
    keyed = paths.withColumn("key", F.array_join("path", "\x00"))
    each = keyed.select("key", F.posexplode("path").alias("at", "id")).join(display_labels(nodes), "id", "left")
    names = each.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("shown", "id").alias("shown")))).alias("n"))
    return keyed.join(names, "key").select("start", "end", "path", "length", F.col("n.shown").alias("labels"))


def annotations(paths: DataFrame, nodes: DataFrame, edges: DataFrame, max_guards: int = 20, max_state: int = 25) -> DataFrame:
    """(key, at, id, kind, label): for each hop of each path its guards, reads and writes, capped for each hop and kind."""
    each = paths.select(F.array_join("path", "\x00").alias("key"), F.posexplode("path").alias("at", "id"))
    guards = edges.where("relation = 'guards'").select(F.col("target").alias("id"), F.col("source").alias("other"), F.lit("guard").alias("kind"))
    state = edges.where(F.col("relation").isin("reads_state", "writes_state")).select(F.col("source").alias("id"), F.col("target").alias("other"), F.when(F.col("relation") == "reads_state", "read").otherwise("write").alias("kind"))
    known = guards.unionByName(state).join(nodes.select(F.col("id").alias("other"), "label"), "other")
    rows = each.join(known, "id")
    n = F.row_number().over(Window.partitionBy("key", "at", "kind").orderBy("label", "other"))
    most = F.when(F.col("kind") == "guard", max_guards or 1 << 30).otherwise(max_state or 1 << 30)
    return rows.withColumn("_n", n).where(F.col("_n") <= most).select("key", "at", "id", "kind", "label")
