"""Sinks and who reaches them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import payload as p
from graphloom.functions.names import has_parameters, is_entry
from graphloom.operators.caps import cap_per_key
from graphloom.operators.traverse import Shelf, call_edges, closure, closure_in_parts, hashes_tell_apart, reversed_edges, traversal_edges, two_hashes
from graphloom.sources.store import TRAVERSAL


def sinks(nodes: DataFrame, sink_type: str = "") -> DataFrame:
    """Nodes marked as sinks: id, label, file, line_start, sink_type, source_context, metadata."""
    found = nodes.where(p.attr_enabled("metadata", "is_sink")).withColumn("sink_type", F.coalesce(p.value("metadata", "sink_type"), F.lit("unknown")))
    if sink_type:
        found = found.where(F.col("sink_type") == sink_type)
    return found.select("id", "label", "file", "line_start", "sink_type", p.source_context("metadata").alias("source_context"), "metadata")


def callers(nodes: DataFrame, edges: DataFrame, sink_type: str = "", external_only: bool = False, production_only: bool = False) -> DataFrame:
    """(sink, id, label, file, line_start, visibility, distance): functions that reach a sink by calls, in the fewest hops.

    Hops may pass through any node; only functions in the scope are reported.
    """
    starts = sinks(nodes, sink_type)
    if production_only:
        starts = starts.where(~p.is_research("metadata"))
    reached = closure(starts.select("id"), reversed_edges(call_edges(edges))).where("distance > 0")
    shown = nodes.where("type = 'function'")
    if external_only:
        shown = shown.where(is_entry())
    if production_only:
        shown = shown.where(~p.is_research("metadata"))
    rows = reached.join(shown, F.col("node") == F.col("id"))
    return rows.select(F.col("start").alias("sink"), "id", "label", "file", "line_start", "visibility", "distance")


def capped_callers(nodes: DataFrame, edges: DataFrame, max_callers: int = 10, **scope) -> DataFrame:
    """The nearest callers of each sink, with the number of all of them in `total`."""
    return cap_per_key(callers(nodes, edges, **scope), ["sink"], [F.col(c) for c in ("distance", "file", "line_start", "id")], max_callers)


def reachability(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(sink_type, sinks, functions): sinks of each type and the distinct nodes that reach one, sinks included."""
    own = sinks(nodes)
    back = closure(own.select("id"), reversed_edges(call_edges(edges)))
    counts = own.groupBy("sink_type").agg(F.count("*").alias("sinks"))
    reached = back.join(own.select(F.col("id").alias("start"), "sink_type"), "start").groupBy("sink_type").agg(F.count_distinct("node").alias("functions"))
    return counts.join(reached, "sink_type")


def attack_surface(nodes: DataFrame, edges: DataFrame, sets: DataFrame | None = None, valid_only: bool = False) -> DataFrame:
    """Entry points with reachable_count and state_writes, the state writes of all they reach (themselves included).

    sets: closure() of the entry points, if there is one already. valid_only counts ids that have a node only.
    """
    entries = nodes.where((F.col("type") == "function") & is_entry())
    shelf = Shelf()
    steps = shelf.keep(edges.where(F.col("relation").isin(*TRAVERSAL)).select("source", "target").dropna().select(*two_hashes("source", "s", "s2"), *two_hashes("target", "t", "t2"))) if sets is None else None
    writes = edges.where("relation = 'writes_state'").groupBy(F.col("source").alias("node")).agg(F.count("*").alias("writes"))
    ids = nodes.select("id")
    short = False
    if sets is None:
        hashed = shelf.keep(writes.where("node is not null").select(*two_hashes("node"), "writes"))
        known = shelf.keep((nodes if valid_only else entries).where("id is not null").select(*two_hashes("id")).distinct())
        every = steps.select(F.col("s").alias("h"), F.col("s2").alias("h2")).union(steps.select("t", "t2")).union(hashed.select("h", "h2")).union(known)
        short = hashes_tell_apart(every)  # so that pairs are of numbers, which take a fraction of the room
        shelf.sweep()
        if short:
            writes, ids = hashed.select(F.col("h").alias("node"), "writes"), known.select(F.col("h").alias("id"))

    def summed(reached: DataFrame) -> DataFrame:
        if valid_only:
            reached = reached.join(ids.withColumnRenamed("id", "node"), "node", "left_semi")
        return reached.join(writes, "node", "left").groupBy("start").agg(F.count("*").alias("reachable_count"), F.coalesce(F.sum("writes"), F.lit(0)).alias("state_writes"))

    key = F.xxhash64("id") if short else F.col("id")
    if sets is not None:
        sums = summed(sets)
    else:
        sums = closure_in_parts(entries.where("id is not null").select(key.alias("start")), steps.select(F.col("s").alias("source"), F.col("t").alias("target")) if short else traversal_edges(edges), summed)
        shelf.clear()
    return entries.where("id is not null").withColumn("start", key).join(sums, "start").select("id", "label", "file", "signature", "reachable_count", "state_writes", "metadata", "seq")


def _sinks_of(entries: DataFrame, own: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, node): entries and the sinks that they reach. Sinks are few, so it goes backwards from them; what reaches none is never stored."""
    shelf = Shelf()
    steps = shelf.keep(edges.where(F.col("relation").isin(*TRAVERSAL)).select("source", "target").dropna().select(*two_hashes("source", "s", "s2"), *two_hashes("target", "t", "t2")))
    starts = entries.where("id is not null").select(F.col("id").alias("start")).distinct()
    ends = own.where("node is not null").select("node").distinct()
    every = steps.select(F.col("s").alias("h"), F.col("s2").alias("h2")).union(steps.select("t", "t2")).union(starts.select(*two_hashes("start"))).union(ends.select(*two_hashes("node")))
    if not hashes_tell_apart(every):
        shelf.clear()
        back = closure(ends, reversed_edges(traversal_edges(edges)))
        return back.select(F.col("start").alias("sink"), F.col("node").alias("start")).join(starts, "start", "left_semi").withColumnRenamed("sink", "node")
    back = closure_in_parts(ends.select(F.xxhash64("node")), steps.select(F.col("t").alias("source"), F.col("s").alias("target")), lambda pairs: pairs.select("start", "node"))
    shelf.clear()
    back = back.select(F.col("start").alias("h_sink"), F.col("node").alias("h_start"))
    return back.join(starts.withColumn("h_start", F.xxhash64("start")), "h_start").join(ends.withColumn("h_sink", F.xxhash64("node")), "h_sink").select("start", "node")


def taint(nodes: DataFrame, edges: DataFrame, sets: DataFrame | None = None) -> DataFrame:
    """Entry points with parameters, neither view nor pure, that reach sinks: id, label, file, visibility, guarded, reachable_sinks, sinks (ids, sorted), risk."""
    entries = nodes.where((F.col("type") == "function") & is_entry() & has_parameters("signature") & ~p.truthy("metadata", "view") & ~p.truthy("metadata", "pure"))
    own = sinks(nodes).select(F.col("id").alias("node"), F.col("label").alias("sink"), "sink_type")
    hit = (_sinks_of(entries, own, edges) if sets is None else sets).join(own, "node").groupBy(F.col("start").alias("id")).agg(F.count("*").alias("reachable_sinks"), F.slice(F.array_sort(F.collect_list(F.struct("node", "sink", "sink_type"))), 1, 5).alias("sinks"))
    guarded = edges.where("relation = 'guards'").select(F.col("target").alias("id")).distinct().withColumn("guarded", F.lit(True))
    rows = entries.join(hit, "id").join(guarded, "id", "left").withColumn("guarded", F.coalesce("guarded", F.lit(False)))
    return rows.select("id", "label", "file", "visibility", "guarded", "reachable_sinks", "sinks", F.when(F.col("guarded"), "MEDIUM").otherwise("HIGH").alias("risk"), p.source_context("metadata").alias("source_context"), "seq")
