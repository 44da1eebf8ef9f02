"""The property graph: nodes, edges, state transitions and a few build facts, as DataFrames and as Parquet."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NODES = "id string, label string, type string, visibility string, file string, line_start int, line_end int, signature string, metadata string, seq long"
EDGES = "source string, target string, relation string, attributes string, seq long"
TRANSITIONS = "entity string, from_state string, to_state string, function_id string, conditions string, seq long"
#: What a column holds where the writer left it out.
DEFAULTS = {"visibility": "", "line_start": 0, "line_end": 0, "signature": "", "metadata": "{}", "attributes": "{}", "conditions": "[]"}
#: Relations that reachability follows.
TRAVERSAL = ("calls", "flows_to", "inherits")


class MissingGraph(FileNotFoundError):
    """There is no graph at the path; reading makes none."""


def _first(df: DataFrame, keys: list[str], last: bool = False) -> DataFrame:
    order = F.desc("seq") if last else F.asc("seq")
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")


def first_wins(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with equal keys, the one inserted first."""
    return _first(df, keys)


def last_wins(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with equal keys, the one inserted last, at its place."""
    return _first(df, keys, last=True)


def merge_attributes(edges: DataFrame) -> DataFrame:
    """Edges inserted one by one: attributes of equal edges are merged, later values replacing earlier ones."""
    keys = ["source", "target", "relation"]
    each = edges.sparkSession.sql("SELECT e.source, e.target, e.relation, e.seq, v.key, to_json(v.value) AS value FROM {edges} e LEFT JOIN LATERAL variant_explode_outer(try_parse_json(e.attributes)) v", edges=edges)
    latest = each.groupBy(*keys, "key").agg(F.max_by("value", F.struct("seq", "value")).alias("value"), F.min("seq").alias("seq"))
    part = F.when(F.col("key").isNotNull(), F.concat(F.lit('"'), "key", F.lit('":'), F.coalesce("value", F.lit("null"))))
    merged = latest.groupBy(*keys).agg(F.min("seq").alias("seq"), F.array_sort(F.collect_list(part)).alias("parts"))
    return merged.select(*keys, F.concat(F.lit("{"), F.array_join("parts", ","), F.lit("}")).alias("attributes"), "seq")


@dataclass
class Graph:
    nodes: DataFrame
    edges: DataFrame
    transitions: DataFrame
    facts: dict = field(default_factory=dict)

    @classmethod
    def of(cls, nodes: DataFrame, edges: DataFrame, transitions: DataFrame, facts: dict | None = None) -> Graph:
        """From rows in the order of insertion (seq): nodes and transitions keep the first of equal keys, edges the last."""
        return cls(first_wins(nodes, ["id"]), last_wins(edges, ["source", "target", "relation"]), first_wins(transitions, ["entity", "from_state", "to_state", "function_id"]), facts or {})

    @classmethod
    def from_rows(cls, spark: SparkSession, nodes=(), edges=(), transitions=(), facts: dict | None = None) -> Graph:
        """From dicts that may leave out columns with a default."""

        def frame(rows, schema: str) -> DataFrame:
            names = [c.split()[0] for c in schema.split(", ")]
            return spark.createDataFrame([tuple(r.get(c, i if c == "seq" else DEFAULTS.get(c)) for c in names) for i, r in enumerate(rows)], schema)

        return cls.of(frame(nodes, NODES), frame(edges, EDGES), frame(transitions, TRANSITIONS), facts)

    def production(self) -> Graph:
        """Without what comes from research files: nodes by their provenance, edges and transitions by their ends."""
        from graphloom.functions.payload import is_research

        nodes = self.nodes.where(~is_research("metadata"))
        ids = nodes.select("id")
        edges = self.edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
        moves = self.transitions.join(ids.withColumnRenamed("id", "function_id"), "function_id", "left_semi")
        return Graph(nodes, edges.select(*self.edges.columns), moves.select(*self.transitions.columns), self.facts)

    def save(self, path: str) -> None:
        """Edges lie by relation and nodes by type, sorted, so that scans of one relation or type read little else."""
        self.nodes.sortWithinPartitions("type", "label").write.mode("overwrite").partitionBy("type").parquet(f"{path}/nodes")
        self.edges.sortWithinPartitions("relation", "source").write.mode("overwrite").partitionBy("relation").parquet(f"{path}/edges")
        self.transitions.write.mode("overwrite").parquet(f"{path}/transitions")
        spark = self.nodes.sparkSession
        rows = [(k, json.dumps(v)) for k, v in self.facts.items()]
        spark.createDataFrame(rows, "key string, value string").write.mode("overwrite").parquet(f"{path}/facts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        from pyspark.errors import AnalysisException

        def read(name: str, schema: str) -> DataFrame:
            try:
                return spark.read.schema(schema).parquet(f"{path}/{name}").select(*[c.split()[0] for c in schema.split(", ")])
            except AnalysisException as error:
                raise MissingGraph(path) from error

        facts = {}
        for key, text in read("facts", "key string, value string").collect():
            try:
                facts[key] = json.loads(text)
            except ValueError:
                facts[key] = text
        return cls(read("nodes", NODES), read("edges", EDGES), read("transitions", TRANSITIONS), facts)
