"""Name lookups that try stricter readings first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.names import like
from graphloom.functions.payload import is_research


def exact_label(nodes: DataFrame, label: str, kind: str = "") -> DataFrame:
    found = nodes.where(F.col("label") == label)
    return (found.where(F.col("type") == kind) if kind else found).orderBy("id")


def staged_match(nodes: DataFrame, text: str, kind: str = "", production_only: bool = False, in_ids: bool = True) -> DataFrame:
    """Nodes by equal label, else by an id that contains the text, else by a label that does.

    The first reading that any node meets counts, even if all its nodes are then outside the scope. Adds stage.
    """
    pool = nodes.where(F.col("type") == kind) if kind else nodes
    stage = F.when(F.col("label") == text, 1)
    if in_ids:
        stage = stage.when(like("id", text), 2)
    found = pool.withColumn("stage", stage.when(like("label", text), 3)).where("stage is not null")
    best = found.agg(F.min("stage").alias("best"))
    found = found.join(F.broadcast(best), F.col("stage") == F.col("best")).drop("best")
    return found.where(~is_research("metadata")) if production_only else found


def state_variables(nodes: DataFrame, text: str, production_only: bool = False) -> DataFrame:
    """State variables by equal label, else by a label that contains the text; ordered by file and id."""
    return staged_match(nodes, text, "state_var", production_only, in_ids=False).orderBy("file", "id")


def display_labels(nodes: DataFrame) -> DataFrame:
    """(id, shown): the label where it is unique, else the qualified one."""
    from graphloom.functions.names import qualified_label

    n = F.count("*").over(Window.partitionBy("label"))
    return nodes.select("id", F.when(n == 1, F.col("label")).otherwise(qualified_label("id")).alias("shown"))
