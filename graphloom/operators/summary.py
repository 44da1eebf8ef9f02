"""Counts of a graph and its health."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import payload as p
from graphloom.functions.names import is_entry


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends have a node."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def phantom_targets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls whose target has no node."""
    return edges.where("relation = 'calls'").join(nodes.select(F.col("id").alias("target")), "target", "left_anti")


def node_types(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def relations(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation")


def contexts(nodes: DataFrame) -> DataFrame:
    """Functions by provenance, the empty one as production."""
    context = F.coalesce(F.nullif(p.source_context("metadata"), F.lit("")), F.lit("production"))
    return nodes.where("type = 'function'").groupBy(context.alias("source_context")).agg(F.count("*").alias("n"))


def totals(nodes: DataFrame, edges: DataFrame, transitions: DataFrame) -> DataFrame:
    """One row: nodes, edges, valid_edges, files, functions, state_vars, entry_points, sinks, guarded, transitions."""
    of_nodes = nodes.agg(
        F.count("*").alias("nodes"),
        F.count_distinct("file").alias("files"),
        F.count_if(F.col("type") == "function").alias("functions"),
        F.count_if(F.col("type") == "state_var").alias("state_vars"),
        F.count_if((F.col("type") == "function") & is_entry()).alias("entry_points"),
        F.count_if(p.attr_enabled("metadata", "is_sink")).alias("sinks"),
    )
    of_edges = edges.agg(F.count("*").alias("edges"), F.count_distinct(F.when(F.col("relation") == "guards", F.col("target"))).alias("guarded"))
    valid = valid_edges(nodes, edges).agg(F.count("*").alias("valid_edges"))
    moves = transitions.agg(F.count("*").alias("transitions"))
    out = of_nodes
    for one in (of_edges, valid, moves):  # single rows
        out = out.crossJoin(F.broadcast(one))
    return out.withColumn("unguarded_entry_points", F.col("entry_points") - F.col("guarded"))
