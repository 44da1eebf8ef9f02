"""Data flows from SARIF files, resolved to nodes by file and line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.names import repository_path

_PLACE = "struct<location:struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>"
SARIF = f"runs array<struct<results:array<struct<ruleId:string,codeFlows:array<struct<threadFlows:array<struct<locations:array<{_PLACE}>>>>>>>>>"
#: How far a line may be from the start of a node that does not hold it.
NEAR = 3


def read_sarif(spark: SparkSession, path: str, root: str = "") -> DataFrame:
    """(rule, from_file, from_line, to_file, to_line): the first and the last place of each flow."""
    raw = spark.read.schema(SARIF).option("multiLine", True).json(path)
    result = raw.select(F.explode("runs").alias("run")).select(F.explode("run.results").alias("r"))
    thread = result.select(F.col("r.ruleId").alias("rule"), F.explode("r.codeFlows").alias("c")).select("rule", F.explode("c.threadFlows").alias("t")).where(F.size("t.locations") > 1)
    first, last = F.get("t.locations", F.lit(0)), F.element_at("t.locations", -1)

    def place(x, name: str):
        where = x["location"]["physicalLocation"]
        return repository_path(where["artifactLocation"]["uri"], root).alias(f"{name}_file"), F.coalesce(where["region"]["startLine"], F.lit(0)).alias(f"{name}_line")

    return thread.select("rule", *place(first, "from"), *place(last, "to"))


def resolve(probes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(probe, id) for probes (probe, file, line): the smallest node that holds the line, functions first, then modifiers; else the nearest such node if it starts within NEAR lines; else null."""
    own = nodes.select(F.translate("file", "\\", "/").alias("n_file"), F.col("id").alias("n_id"), F.col("type").alias("n_type"), F.col("line_start").alias("n_from"), F.col("line_end").alias("n_to"))
    # what a line resolves to depends on its place alone, so each place is joined with the nodes of its file once
    both = probes.select("file", "line").distinct().join(own, F.col("file") == F.col("n_file"), "left")
    rank = F.when(F.col("n_type") == "function", 0).when(F.col("n_type") == "modifier", 1).otherwise(2)
    holds = F.col("line").between(F.col("n_from"), F.col("n_to"))
    inside = F.min(F.when(holds, F.struct(rank.alias("r"), (F.col("n_to") - F.col("n_from")).alias("s"), "n_from", "n_id")))
    near = F.min(F.when(F.col("n_id").isNotNull(), F.struct(rank.alias("r"), F.abs(F.col("n_from") - F.col("line")).alias("d"), "n_from", "n_id")))
    places = both.groupBy(F.col("file").alias("p_file"), F.col("line").alias("p_line")).agg(inside.alias("inside"), near.alias("near"))
    found = probes.join(places, F.col("file").eqNullSafe(F.col("p_file")) & F.col("line").eqNullSafe(F.col("p_line")))
    best = found.groupBy("probe").agg(F.min("inside").alias("inside"), F.min("near").alias("near"))
    return best.select("probe", F.coalesce("inside.n_id", F.when(F.col("near.d") <= NEAR, F.col("near.n_id"))).alias("id"))


def flow_edges(flows: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges `flows_to` between the resolved ends, and the flows that have an end without a node. A flow of a node to itself is no edge."""
    keyed = flows.withColumn("key", F.xxhash64(*flows.columns)).dropDuplicates(["key"])
    ends = []
    for side in ("from", "to"):
        found = resolve(keyed.select(F.col("key").alias("probe"), F.col(f"{side}_file").alias("file"), F.col(f"{side}_line").alias("line")), nodes)
        ends.append(found.select(F.col("probe").alias("key"), F.col("id").alias(side)))
    both = keyed.join(ends[0], "key").join(ends[1], "key")
    edges = both.where("`from` <> `to`").groupBy(F.col("from").alias("source"), F.col("to").alias("target")).agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    made = edges.select("source", "target", F.lit("flows_to").alias("relation"), F.to_json(F.struct("rules")).alias("attributes"))
    return made, both.where("`from` IS NULL OR `to` IS NULL").select(*flows.columns)
