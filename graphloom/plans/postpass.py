"""Passes over a freshly extracted graph, in their order: accounts of functions, implicit interfaces, calls to bare names, base types, calls across files, reentrancy findings that do not hold, reentrancy across functions; and the confidence of a build."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import payload as p
from graphloom.functions.names import bare_id, contract_key, short_variable
from graphloom.operators.relations import containing
from graphloom.operators.traverse import all_callers_guarded, cut, inherited_member, stored
from graphloom.sources.store import Graph, last_wins

#: Fixed value: the attributes of a call that was resolved to another file.
RESOLVED = '{"resolved_cross_file": true}'
#: Modifiers that protect from reentrancy, and the order of a sink whose place is unknown.
REENTRANCY_GUARDS = ("nonReentrant", "ReentrancyGuard", "noReentrant", "globalNonReentrant", "nonReentrant_", "lock_")
LAST_ORDER = 999
#: Types that can be a base.
BASES = ("contract", "abstract", "interface", "library")


def _retarget(edges: DataFrame, found: DataFrame, attributes=None) -> DataFrame:
    """Edges of found (source, target, relation, to) lead to `to`; where that edge exists already, the old one goes."""
    keys = ["source", "target", "relation"]
    moved = edges.join(found, keys).select("source", F.col("to").alias("target"), "relation", (F.col("attributes") if attributes is None else F.lit(attributes)).alias("attributes"), "seq")
    kept = edges.join(found.select(*keys), keys, "left_anti").select(*moved.columns)
    new = last_wins(moved, keys).join(kept.select(*keys), keys, "left_anti").select(*moved.columns)
    return kept.unionByName(new)


def resolve_bare_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls of a name without parameters lead to the first function of that name, in the owner itself or its nearest ancestor that has one."""
    functions = nodes.where("type = 'function'").select("id", "seq", bare_id("id").alias("bare"))
    first = functions.groupBy("bare").agg(F.min_by("id", "seq").alias("to"))
    phantom = edges.where("relation = 'calls'").join(nodes.select(F.col("id").alias("target")), "target", "left_anti").select("source", "target", "relation").withColumn("bare", bare_id("target"))
    direct = phantom.join(first, "bare").select("source", "target", "relation", "to")
    name = F.when(F.contains("bare", F.lit(".")), F.substring_index("bare", ".", -1))
    rest = phantom.join(first, "bare", "left_anti").withColumns({"owner": contract_key("bare"), "name": name}).where("owner is not null and name is not null")
    members = first.select(contract_key("bare").alias("owner"), F.substring_index("bare", ".", -1).alias("name"), F.col("to").alias("id")).where("owner is not null")
    above = inherited_member(edges, rest.select("owner", "name").distinct(), members)
    inherited = rest.join(above, ["owner", "name"]).select("source", "target", "relation", F.col("id").alias("to"))
    return _retarget(edges, direct.unionByName(inherited))


def resolve_bases(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Placeholders of base types (`_::Name`) lead to the last type of that label; those without one stay."""
    last = nodes.where(F.col("type").isin(*BASES)).groupBy(F.col("label").alias("name")).agg(F.max(F.struct("seq", "id"))["id"].alias("to"))
    open_ = edges.where((F.col("relation") == "inherits") & F.col("target").rlike("^.::")).select("source", "target", "relation", F.expr("substring(target, 4)").alias("name"))
    return _retarget(edges, open_.join(last, "name").select("source", "target", "relation", "to"))


def resolve_cross_file(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Unresolved calls with a known name lead to the first function of that label, one in another file if there is any."""
    calls = edges.where((F.col("relation") == "calls") & p.truthy("attributes", "unresolved") & p.value("attributes", "call_name").isNotNull())
    calls = calls.select("source", "target", "relation", p.value("attributes", "call_name").alias("name"), F.substring_index("source", "::", 1).alias("own"))
    functions = nodes.where("type = 'function'").select(F.col("label").alias("name"), "id", "file", "seq")
    # two candidates of a name are enough, however many files define it: the first of all, and the first of another file than that one's
    by_file = functions.groupBy("name", "file").agg(F.min(F.struct("seq", "id")).alias("c"))
    first = by_file.groupBy("name").agg(F.min(F.struct("c", "file")).alias("first"))
    second = by_file.join(first, "name").where(F.col("file") != F.col("first.file")).groupBy("name").agg(F.min("c").alias("second"))
    to = F.when((F.col("first.file") == F.col("own")) & F.col("second").isNotNull(), F.col("second.id")).otherwise(F.col("first.c.id"))
    best = calls.join(first, "name").join(second, "name", "left").select("source", "target", "relation", F.struct((F.col("first.file") == F.col("own")) & F.col("second").isNull(), F.when((F.col("first.file") == F.col("own")) & F.col("second").isNotNull(), F.col("second.seq")).otherwise(F.col("first.c.seq")).alias("seq"), to.alias("id")).alias("b"))
    best = best.groupBy("source", "target", "relation").agg(F.min("b").alias("b"))
    return _retarget(edges, best.select("source", "target", "relation", F.col("b.id").alias("to")), RESOLVED)


def suppressible(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions whose reentrancy finding does not hold: constructors, and others than entry points that are called from guarded functions only."""
    functions = nodes.where("type = 'function'")
    guarded = edges.where("relation = 'guards'").select(F.col("target").alias("id")).distinct()
    safe = all_callers_guarded(functions, edges, guarded).withColumn("safe", F.lit(True))
    flagged = functions.where(p.truthy("metadata", "reentrancy_risk")).join(safe, "id", "left")
    inner = ~F.col("visibility").isin("public", "external") & F.coalesce("safe", F.lit(False))
    return flagged.where((F.col("label") == "constructor") | inner).select("id", "label", "metadata")



def cross_reentrancy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, via, stale_vars): entry points of the same owner that touch what another function (via) writes after its first call out."""
    guards = F.from_json(p.value("metadata", "modifiers"), "array<string>")
    functions = nodes.where("type = 'function'").where(~F.coalesce(F.arrays_overlap(guards, F.array(*map(F.lit, REENTRANCY_GUARDS))), F.lit(False)))
    own = functions.select("id", "visibility", contract_key("id").alias("owner")).where("owner is not null")
    order = p.value("attributes", "order").try_cast("int")
    out = F.when(p.truthy("attributes", "unresolved") & order.isNotNull(), order).when(p.truthy("attributes", "sink"), F.coalesce(order, F.lit(LAST_ORDER)))
    first = edges.where("relation = 'calls'").select(F.col("source").alias("via"), out.alias("at")).where("at is not null").groupBy("via").agg(F.min("at").alias("at"))
    writes = edges.where("relation = 'writes_state'").select(F.col("source").alias("via"), F.col("target").alias("var"), F.coalesce(order, F.lit(-1)).alias("order"))
    late = writes.join(first, "via").where(F.col("order") > F.col("at")).select("via", "var").distinct().join(own.select(F.col("id").alias("via"), "owner"), "via")
    touched = edges.where(F.col("relation").isin("writes_state", "reads_state")).select(F.col("source").alias("id"), F.col("target").alias("var")).distinct()
    entries = own.where(F.col("visibility").isin("public", "external")).join(touched, "id")
    hit = late.join(entries, ["owner", "var"]).where(F.col("id") != F.col("via"))
    return hit.groupBy("id", "via").agg(F.array_sort(F.collect_set(short_variable("var"))).alias("stale_vars"), F.count_distinct("var").alias("stale"))


def implicit_interfaces(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """New edges from types to the interfaces of their file whose methods they all have, where a language asks for no more than that."""
    asked = nodes.where("type = 'interface'").select(F.col("file").alias("scope"), F.col("id").alias("name"), F.explode(F.from_json(p.value("metadata", "methods"), "array<string>")).alias("item"))
    methods = nodes.where("type = 'function'").select(F.col("id").alias("target"), F.col("file").alias("scope"), F.col("label").alias("item"))
    held = edges.where("relation = 'contains'").select(F.col("source").alias("holder"), "target").join(methods, "target").select("scope", "holder", "item")
    found = containing(held, asked).where("holder <> name").select(F.col("holder").alias("source"), F.col("name").alias("target"))
    interfaces = nodes.where("type = 'interface'").select(F.col("id").alias("target"), "label", "seq")
    return found.join(interfaces, "target").select("source", "target", F.lit("inherits").alias("relation"), F.to_json(F.struct(F.lit("implements").alias("kind"), F.col("label").alias("interface"))).alias("attributes"), "seq")


def account_contexts(nodes: DataFrame) -> DataFrame:
    """(context, label, file, line_start, line_end, metadata, seq, function): structs of accounts with the last function of their file that takes them."""
    taken = nodes.where("type = 'function'").select("file", p.value("metadata", "context_type").alias("label"), "id", "seq").where("label is not null")
    takers = taken.groupBy("file", "label").agg(F.max(F.struct("seq", "id"))["id"].alias("function"))
    contexts = nodes.where((F.col("type") == "struct") & p.truthy("metadata", "is_accounts_context")).select(F.col("id").alias("context"), "label", "file", "line_start", "line_end", "metadata", "seq")
    return contexts.join(takers, ["file", "label"])


def context_risks(contexts: DataFrame) -> DataFrame:
    """(function, type, field, detail): what the accounts of a function leave open."""
    fields = F.from_json(p.value("metadata", "field_metadata"), "map<string, struct<account_type: string, mutable: boolean, unchecked_account: boolean, owner_check: string>>")
    seeds = F.from_json(p.value("metadata", "pda_fields"), "map<string, struct<pda_seeds: array<string>, has_bump: boolean>>")
    own = contexts.select("function", "metadata", fields.alias("f"), seeds.alias("s"))
    changed = F.array_sort(F.map_keys(F.map_filter("f", lambda _, x: x["mutable"])))
    signed = F.exists(F.map_values("f"), lambda x: F.coalesce(x["account_type"] == "Signer", F.lit(False)))
    unsigned = own.where((F.size(changed) > 0) & ~signed & p.value("metadata", "access_controls").isNull())
    unsigned = unsigned.select("function", F.lit("missing_signer").alias("type"), F.lit(None).cast("string").alias("field"), F.concat(F.lit("mutable accounts without a signer: "), F.array_join(changed, ", ")).alias("detail"))
    each = own.select("function", F.explode("s").alias("field", "x"))
    constant = each.where(F.forall("x.pda_seeds", lambda v: v.rlike("^b[\"']"))).select("function", F.lit("weak_pda_seeds").alias("type"), "field", F.concat(F.lit("all seeds are constants: "), F.array_join("x.pda_seeds", ", ")).alias("detail"))
    bump = each.where("not x.has_bump").select("function", F.lit("missing_bump").alias("type"), "field", F.lit("seeds without a bump").alias("detail"))
    unchecked = own.select("function", F.explode("f").alias("field", "x")).where("x.unchecked_account and x.owner_check is null").select("function", F.lit("unchecked_no_owner").alias("type"), "field", F.lit("an unchecked account without an owner").alias("detail"))
    return unsigned.unionByName(constant).unionByName(bump).unionByName(unchecked)


def link_contexts(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Structs of accounts guard the functions that take them; what they close is a sink of those; what they leave open goes into the functions' metadata."""
    found = stored(account_contexts(nodes))
    controls = p.value("metadata", "access_controls")
    guards = found.where(controls.isNotNull()).select(F.col("context").alias("source"), F.col("function").alias("target"), F.lit("guards").alias("relation"), F.concat(F.lit('{"access_controls": '), controls, F.lit("}")).alias("attributes"), "seq")
    closed = found.select("*", F.explode(F.from_json(p.value("metadata", "close_targets"), "map<string, string>")).alias("field", "to"))
    sink = F.concat("file", F.lit("::_sink_close_"), "label", F.lit("_"), "field")
    facts = F.to_json(F.struct(F.lit(True).alias("is_sink"), F.lit("fund_destruction").alias("sink_type"), F.col("to").alias("close_target")))
    sinks = closed.select(sink.alias("id"), F.concat(F.lit("close("), "field", F.lit(")")).alias("label"), F.lit("function").alias("type"), F.lit("").alias("visibility"), "file", "line_start", "line_end", F.concat(F.lit("close = "), "to").alias("signature"), facts.alias("metadata"), "seq")
    calls = closed.select(F.col("function").alias("source"), sink.alias("target"), F.lit("calls").alias("relation"), F.lit('{"sink": true, "close": true}').alias("attributes"), "seq")
    open_ = context_risks(found).groupBy(F.col("function").alias("id")).agg(F.to_json(F.array_sort(F.collect_list(F.struct("type", "field", "detail")))).alias("risks"))
    body = F.regexp_replace("metadata", r"\}\s*$", "")
    full = F.when(F.col("risks").isNotNull(), F.concat(body, F.when(F.trim(body) == "{", "").otherwise(", "), F.lit('"anchor_risks": '), "risks", F.lit("}"))).otherwise(F.col("metadata"))
    marked = nodes.join(open_, "id", "left").withColumn("metadata", full).select(*nodes.columns)
    return marked.unionByName(sinks), edges.unionByName(guards).unionByName(calls)


def annotate(graph: Graph) -> Graph:
    """All passes; findings go into the metadata of the functions."""
    nodes, edges = link_contexts(*(map(cut, (graph.nodes, graph.edges))))
    edges = edges.unionByName(implicit_interfaces(nodes, edges))
    graph = Graph(cut(nodes), cut(last_wins(edges, ["source", "target", "relation"])), graph.transitions, graph.facts)
    edges = cut(resolve_bare_calls(graph.nodes, graph.edges))
    edges = cut(resolve_bases(graph.nodes, edges))
    edges = cut(resolve_cross_file(graph.nodes, edges))
    drop = suppressible(graph.nodes, edges).select("id").withColumn("drop", F.lit(True))
    labels = graph.nodes.select(F.col("id").alias("via"), F.col("label").alias("via_label"))
    item = F.struct(F.col("via_label").alias("via"), "stale_vars")
    cross = cross_reentrancy(graph.nodes, edges).join(labels, "via").groupBy("id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("cross"))
    nodes = graph.nodes.join(drop, "id", "left").join(cross, "id", "left")
    meta = F.col("metadata")
    base = F.when(F.col("drop"), F.regexp_replace(meta, r'"reentrancy_risk"\s*:\s*[^,}]+', '"reentrancy_suppressed": true')).otherwise(meta)
    body = F.regexp_replace(base, r"\}\s*$", "")
    comma = F.when(F.trim(body) == "{", "").otherwise(", ")
    full = F.when(F.col("cross").isNotNull(), F.concat(body, comma, F.lit('"cross_reentrancy": '), "cross", F.lit("}"))).otherwise(base)
    return Graph(nodes.withColumn("metadata", full).select(*graph.nodes.columns), edges, graph.transitions, graph.facts)


def confidence(considered: int, indexed: int, runs: int, failures: int, signal: float = 1.0) -> dict:
    """A build's confidence: most of it by the share of files that were indexed, the rest by the share of extractions that worked."""
    share = 0.7 * (indexed / considered if considered else 0) + 0.3 * (1 - failures / runs if runs else 0)
    score = round(min(1.0, max(0.0, share)) * signal * 100, 1)
    return {"score": score, "tier": "high" if score >= 95 else "good" if score >= 80 else "partial" if score >= 60 else "low"}
