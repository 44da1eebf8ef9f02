"""State machines: transitions by entity and what is odd about them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.caps import cap_per_key

WARNING = ("entity", "warning", "state", "other", "function_id")


def _conditions():
    return F.coalesce(F.from_json("conditions", "array<string>"), F.array().cast("array<string>"))


def warnings(transitions: DataFrame) -> DataFrame:
    """(entity, warning, state, other, function_id).

    Entities that go from any state to `exists`, or from any to `deleted`, are records: UNVALIDATED_WRITE and
    UNVALIDATED_DELETE (by transition), NO_DELETE_PATH and DELETE_WITHOUT_READ (by entity). All others are state
    machines: UNGUARDED (a transition from any state), TERMINAL (a state that nothing leaves), UNREACHABLE (one that
    nothing enters) and TOGGLE (two states with a way to and fro, one of them free of conditions; a state to itself counts).
    """
    t = transitions.withColumn("c", _conditions())
    to_exists = (F.col("from_state") == "*") & (F.col("to_state") == "exists")
    kinds = t.groupBy("entity").agg(F.max(to_exists | (F.col("to_state") == "deleted")).alias("record"), F.max(F.col("to_state") == "deleted").alias("deletes"), F.max(F.col("to_state") == "exists").alias("writes"), F.max(F.col("c") == F.array(F.lit("read"))).alias("reads"))
    null = F.lit(None).cast("string")

    def rows(df: DataFrame, name: str, state=null, other=null, function=null) -> DataFrame:
        return df.select("entity", F.lit(name).alias("warning"), state.alias("state"), other.alias("other"), function.alias("function_id"))

    t = t.join(kinds, "entity")
    records, machines = t.where("record"), t.where("NOT record")
    bare = F.array_contains("c", "no_validation")
    out = [
        rows(records.where((F.col("to_state") == "exists") & bare), "UNVALIDATED_WRITE", F.col("to_state"), null, F.col("function_id")),
        rows(records.where((F.col("to_state") == "deleted") & bare), "UNVALIDATED_DELETE", F.col("to_state"), null, F.col("function_id")),
        rows(kinds.where("record AND writes AND NOT deletes"), "NO_DELETE_PATH"),
        rows(kinds.where("record AND deletes AND NOT reads"), "DELETE_WITHOUT_READ"),
        rows(machines.where("from_state = '*'"), "UNGUARDED", F.col("to_state"), null, F.col("function_id")),
    ]
    left = machines.select("entity", F.col("from_state").alias("state")).where("state <> '*'").distinct()
    entered = machines.select("entity", F.col("to_state").alias("state")).distinct()
    out.append(rows(entered.join(left, ["entity", "state"], "left_anti"), "TERMINAL", F.col("state")))
    out.append(rows(left.join(entered, ["entity", "state"], "left_anti"), "UNREACHABLE", F.col("state")))
    arcs = machines.groupBy("entity", "from_state", "to_state").agg(F.max(F.size("c") == 0).alias("free"))
    back = arcs.select("entity", F.col("to_state").alias("from_state"), F.col("from_state").alias("to_state"), F.col("free").alias("free_back"))
    both = arcs.join(back, ["entity", "from_state", "to_state"]).where((F.col("free") | F.col("free_back")) & (F.col("from_state") <= F.col("to_state")))
    out.append(rows(both, "TOGGLE", F.col("from_state"), F.col("to_state")))
    every = out[0]
    for one in out[1:]:
        every = every.unionByName(one)
    return every


def by_entity(transitions: DataFrame, nodes: DataFrame, max_entities: int = 20, max_per_entity: int = 50) -> DataFrame:
    """Transitions of the first entities by name, the first of each, with their functions' labels and the number of all in `total`."""
    entities = transitions.select("entity").distinct().orderBy("entity")
    entities = entities.limit(max_entities) if max_entities else entities
    own = transitions.join(entities, "entity", "left_semi")
    named = own.join(nodes.select(F.col("id").alias("function_id"), F.col("label").alias("function"), "file"), "function_id", "left")
    return cap_per_key(named, ["entity"], [F.col(c) for c in ("from_state", "to_state", "function_id")], max_per_entity)
