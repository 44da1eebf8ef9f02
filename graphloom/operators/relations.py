"""Who reads, writes, calls and guards what; calls across trust boundaries; the whole profile of a function."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import payload as p
from graphloom.operators.caps import cap_per_key
from graphloom.operators.match import staged_match, state_variables
from graphloom.operators.traverse import closure, stored, traversal_edges

NODE = ("id", "label", "file", "line_start", "visibility")


def neighbours(nodes: DataFrame, edges: DataFrame, ids: DataFrame, relation: str, incoming: bool) -> DataFrame:
    """(of, relation, attributes, id, label, file, line_start, visibility): nodes on the other end of the edges of a relation."""
    here, there = ("target", "source") if incoming else ("source", "target")
    own = edges.where(F.col("relation") == relation).join(ids.toDF("of"), F.col(here) == F.col("of"))
    return own.join(nodes, F.col(there) == F.col("id")).select("of", "relation", "attributes", *NODE)


def _met(sets: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scope, holder, held), (scope, name, asked) and, of the distinct sets among them, (scope, held, asked, n, first) where held has all of asked; n holders have it, the first one among them.

    Equal sets are merged before they are compared. Wanted sets meet others at their item that is in the fewest of those
    only, then the whole sets are compared.
    """

    def whole(rows: DataFrame, key: str, name: str) -> DataFrame:
        return rows.dropna().groupBy("scope", key).agg(F.array_sort(F.collect_set("item")).alias(name))

    holders, names = whole(sets, "holder", "held"), whole(wanted, "name", "asked")
    held = stored(holders.groupBy("scope", "held").agg(F.count("*").alias("n"), F.min("holder").alias("first")))
    asked = stored(names.select("scope", "asked").distinct())
    each = held.select("scope", F.explode("held").alias("item"), "held", "n", "first")
    common = each.groupBy("scope", "item").agg(F.count("*").alias("sets"))
    rare = asked.select("scope", "asked", F.explode("asked").alias("item")).join(common, ["scope", "item"], "left")
    rare = rare.groupBy("scope", "asked").agg(F.min(F.struct(F.coalesce("sets", F.lit(0)).alias("sets"), "item")).alias("rare")).where("rare.sets > 0")
    met = rare.select("scope", "asked", F.col("rare.item").alias("item")).join(each, ["scope", "item"])
    return holders, names, met.where(F.size(F.array_except("asked", "held")) == 0).select("scope", "held", "asked", "n", "first")


def containing(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(scope, holder, name): holders whose set has all items of a wanted set in the same scope.

    sets: (scope, holder, item), wanted: (scope, name, item); repeated rows count once, rows with nulls are in no set.
    """
    holders, names, met = _met(sets, wanted)
    return met.select("scope", "held", "asked").join(names, ["scope", "asked"]).join(holders, ["scope", "held"]).select("scope", "holder", "name")


def containing_counts(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(scope, name, holders, first_holder): how many containing() has of each wanted set, and the first one; names of equal sets are counted together, so pairs are never made."""
    _, names, met = _met(sets, wanted)
    counted = met.groupBy("scope", "asked").agg(F.sum("n").alias("holders"), F.min("first").alias("first_holder"))
    return counted.join(names, ["scope", "asked"]).select("scope", "name", "holders", "first_holder")


def accessors(nodes: DataFrame, edges: DataFrame, variables: DataFrame) -> DataFrame:
    """(variable, access, id, label, file, line_start, visibility): writers and readers, each once."""
    own = edges.where(F.col("relation").isin("writes_state", "reads_state")).join(variables.toDF("variable"), F.col("target") == F.col("variable"))
    access = F.when(F.col("relation") == "writes_state", "writer").otherwise("reader")
    return own.join(nodes, F.col("source") == F.col("id")).select("variable", access.alias("access"), *NODE).distinct()


def trace(nodes: DataFrame, edges: DataFrame, name: str, production_only: bool = False, max_matches: int = 20, max_accessors: int = 100, callers: bool = False, max_callers: int = 20) -> dict[str, DataFrame]:
    """The state variables of a name, who accesses them and, if asked, who calls those."""
    matched = state_variables(nodes, name, production_only)
    matched = matched.limit(max_matches) if max_matches else matched
    scope = nodes.where(~p.is_research("metadata")) if production_only else nodes
    found = cap_per_key(accessors(scope, edges, matched.select("id")), ["access"], [F.col(c) for c in ("file", "line_start", "id")], max_accessors)
    out = {"variables": matched, "accessors": found}
    if callers:
        by = neighbours(scope, edges, found.select("id").distinct(), "calls", incoming=True)
        out["callers"] = cap_per_key(by, ["of"], [F.col("file"), F.col("id")], max_callers)
    return out


def boundary_calls(nodes: DataFrame, edges: DataFrame, start: DataFrame | None = None, production_only: bool = False) -> DataFrame:
    """Calls across a trust boundary, with what is known of either end; start: of the nodes reachable from these ids only.

    source, target, attributes, unresolved, sink, cross_boundary, source_label, source_file, source_context, target_label, target_file.
    """
    calls = edges.where((F.col("relation") == "calls") & p.boundary("attributes"))
    scope = nodes.where(~p.is_research("metadata")) if production_only else nodes
    if start is not None:
        steps = traversal_edges(edges)
        inside = scope.select("id")
        steps = steps.join(inside.withColumnRenamed("id", "source"), "source", "left_semi").join(inside.withColumnRenamed("id", "target"), "target", "left_semi").select("source", "target")
        reached = closure(start.join(inside, "id", "left_semi") if "id" in start.columns else start, steps)
        calls = calls.join(reached.select(F.col("node").alias("source")).distinct(), "source", "left_semi")
    source = scope.select(F.col("id").alias("source"), F.col("label").alias("source_label"), F.col("file").alias("source_file"), p.source_context("metadata").alias("source_context"))
    target = nodes.select(F.col("id").alias("target"), F.col("label").alias("target_label"), F.col("file").alias("target_file"))
    rows = calls.join(source, "source", "inner" if production_only else "left").join(target, "target", "left")
    flags = {"unresolved": p.unresolved("attributes"), "sink": p.attr_enabled("attributes", "sink"), "cross_boundary": p.attr_enabled("attributes", "cross_boundary")}
    return rows.withColumns(flags).select("source", "target", "attributes", *flags, "source_label", "source_file", "source_context", "target_label", "target_file")


def boundary_summary(calls: DataFrame) -> DataFrame:
    """(kind, name, n): totals, by attribute (a call can have several), by provenance, by file and by target."""

    def counted(kind: str, name) -> DataFrame:
        return calls.groupBy(F.lit(kind).alias("kind"), name.alias("name")).agg(F.count("*").alias("n"))

    flags = F.explode(F.array_compact(F.array(*(F.when(F.col(c), F.lit(c)) for c in ("unresolved", "sink", "cross_boundary")))))
    by_flag = calls.select(flags.alias("name")).groupBy(F.lit("attribute").alias("kind"), "name").agg(F.count("*").alias("n"))
    context = F.coalesce(F.nullif(F.col("source_context"), F.lit("")), F.lit("production"))
    total = calls.agg(F.lit("total").alias("kind"), F.lit("").alias("name"), F.count("*").alias("n"))
    return total.unionByName(by_flag).unionByName(counted("source_context", context)).unionByName(counted("file", F.coalesce("source_file", F.lit("")))).unionByName(counted("target", F.coalesce("target_label", "target")))


#: Parts of a profile, the relation they come from (empty: any that is not listed) and their direction.
PROFILE = (
    ("callers", "calls", True),
    ("callees", "calls", False),
    ("state_reads", "reads_state", False),
    ("state_writes", "writes_state", False),
    ("guards", "guards", True),
    ("other_edges_out", "", False),
    ("other_edges_in", "", True),
)


def profile(nodes: DataFrame, edges: DataFrame, ids: DataFrame, max_items: int = 100) -> DataFrame:
    """(of, part, total, relation, attributes, id, label, file, line_start, visibility).

    total counts the edges; ends without a node count and are not shown. Depth two is a profile of the shown ids.
    """
    w = ids.toDF("of")
    parts = []
    for part, relation, incoming in PROFILE:
        here, there = ("target", "source") if incoming else ("source", "target")
        if relation:
            own = edges.where(F.col("relation") == relation)
        else:
            own = edges.where(~F.col("relation").isin(*(("calls", "guards") if incoming else ("calls", "reads_state", "writes_state"))))
        own = own.join(w, F.col(here) == F.col("of")).select("of", F.lit(part).alias("part"), "relation", "attributes", F.col(there).alias("other"))
        parts.append(own)
    every = parts[0]
    for one in parts[1:]:
        every = every.unionByName(one)
    totals = every.groupBy("of", "part").agg(F.count("*").alias("edges"))
    shown = every.join(nodes, F.col("other") == F.col("id")).select("of", "part", "relation", "attributes", *NODE)
    shown = cap_per_key(shown, ["of", "part"], [F.col("file"), F.col("id"), F.col("relation")], max_items).drop("total")
    return totals.join(shown, ["of", "part"], "left").withColumnRenamed("edges", "total")


def lookup(nodes: DataFrame, edges: DataFrame, name: str, depth: int = 1, production_only: bool = False, max_matches: int = 20, max_items: int = 100) -> dict[str, DataFrame]:
    matched = staged_match(nodes, name, "function", production_only).orderBy("file", "line_start", "id")
    matched = matched.limit(max_matches) if max_matches else matched
    scope = nodes.where(~p.is_research("metadata")) if production_only else nodes
    out = {"functions": matched, "profile": profile(scope, edges, matched.select("id"), max_items)}
    if depth > 1:
        ends = out["profile"].where(F.col("part").isin("callers", "callees") & F.col("id").isNotNull()).select("id").distinct()
        out["second"] = profile(scope, edges, ends, max_items)
    return out
