"""The reports: each reads a graph and gives a bounded dict, ready for JSON.

Caps below 0 count as 0; 0 is no cap, but for `top`, where it is no rows. production=True leaves out what comes from research files.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import payload as p
from graphloom.operators import audit as sections
from graphloom.operators import caps, match, paths, relations, rules, scanners, sinks, states, summary, traverse
from graphloom.plans import build as builder
from graphloom.plans import profile as inventory
from graphloom.sources.store import Graph, MissingGraph


def _rows(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _scope(production: bool) -> str:
    return "production_only" if production else "all_sources"


def _graph(g: Graph, production: bool) -> Graph:
    return g.production() if production else g


def profile(spark: SparkSession, root: str, top: int = 20, strategy: str = "balanced", include_research: bool = False) -> dict:
    """What a workspace holds, its projects by weight, and what to build first."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root.rstrip("/")).select("path")
    prefix = root.rstrip("/").split(":")[-1] + "/"
    files = raw.select(F.substring_index("path", prefix, -1).alias("path")).cache()
    found = inventory.projects(files, include_research).cache()
    order = "bounty" if strategy == "bounty" else "priority"
    best = _rows(found.orderBy(F.desc(order), F.desc("source_files"), "project").limit(max(0, top)))
    for row in best:
        row["next"] = inventory.next_steps(set(row["languages"]), set(row["frameworks"]))
    recommended, risky, plan = inventory.build_plan(found, top, strategy)
    by_language: dict[str, list] = {}
    for row in _rows(inventory.by_language(found).orderBy("language", "place")):
        by_language.setdefault(row["language"], []).append({"project": row["project"], "files": row["files"]})
    shown: dict[str, list] = {}
    for row in _rows(inventory.examples(files, include_research).orderBy("reason", "language", "place")):
        shown.setdefault(row["reason"] or row["language"], []).append(row["path"])
    out = {
        "inventory": _rows(inventory.inventory(files, include_research).orderBy(F.desc("files"), "reason", "language")), "projects": best, "workspace": inventory.workspace(found),
        "clusters": _rows(inventory.clusters(found).orderBy(F.desc("bounty"), F.desc("source_files"), "cluster").limit(max(0, top))), "recommended": recommended, "risk_first": risky, "plan": plan,
        "by_language": by_language, "examples": shown, "markers": _rows(inventory.marker_counts(files).orderBy(F.desc("roots"), "marker")),
        "skipped_dirs": _rows(inventory.skipped_dirs(files, include_research).orderBy(F.desc("dirs"), "name").limit(12)),
    }
    files.unpersist()
    found.unpersist()
    return out


def overview(g: Graph, attack_surface: bool = False, top: int = 20, production: bool = False, max_contexts: int = 20) -> dict:
    g = _graph(g, production)
    contexts, info = caps.count_map(g.nodes.where("type = 'function'").select(F.coalesce(F.nullif(p.source_context("metadata"), F.lit("")), F.lit("production")).alias("c")), "c", max(0, max_contexts))
    valid = summary.valid_edges(g.nodes, g.edges)
    out = {"query_scope": _scope(production), "totals": _rows(summary.totals(g.nodes, g.edges, g.transitions))[0], "node_types": caps.count_map(g.nodes, "type")[0], "relations": caps.count_map(valid, "relation")[0], "source_contexts": contexts, "source_contexts_info": info, "build": g.facts}
    if attack_surface:
        rows = sinks.attack_surface(g.nodes, g.edges, valid_only=True).drop("metadata", "seq")
        out["attack_surface"] = _rows(caps.top(rows, [F.desc("state_writes"), F.col("file"), F.col("label"), F.col("id")], max(0, top)))
    return out


def audit(g: Graph, top: int = 15, production: bool = False, include_metadata: bool = False, dead_code_details: bool = False, max_metadata: int = 4096) -> dict:
    """All sections in one report."""
    g, top = _graph(g, production), max(0, top)
    sets = traverse.reachable_sets(g.nodes, g.edges)
    tallies = {r["key"]: r["functions"] for r in scanners.tallies(g.nodes, sections.DETECTIONS).collect()}
    report: dict = {"query_scope": _scope(production), "stats": _rows(summary.totals(g.nodes, g.edges, g.transitions))[0], "build": g.facts}
    report["detections"] = dict(sorted(tallies.items(), key=lambda x: (-x[1], x[0])))
    summed: dict = {}

    def part(name: str, df: DataFrame, order: list) -> list[dict]:
        df = df.cache()
        total, rows = df.count(), _rows(caps.top(df, order, top))
        df.unpersist()
        summed[name] = caps.section(total, len(rows))
        for row in rows:
            row.pop("seq", None)
        return rows

    surface = part("attack_surface", sinks.attack_surface(g.nodes, g.edges, sets), [F.desc("state_writes"), F.col("seq")])
    for row in surface:
        meta = row.pop("metadata")
        if include_metadata:
            row["metadata"], row["metadata_info"] = caps.cap_json(meta, max_metadata)
    report["attack_surface"] = surface
    report["critical_hotspots"] = part("critical_hotspots", rules.hotspots(g.nodes, g.edges, 5, cpi=True), [F.desc("score"), F.col("seq")])
    report["reentrancy"] = part("reentrancy", sections.reentrancy(g.nodes, g.edges), [F.col("file"), F.col("line_start"), F.col("id"), F.desc("kind")])
    report["taint_paths"] = part("taint_paths", sinks.taint(g.nodes, g.edges, sets), [F.col("risk"), F.desc("reachable_sinks"), F.col("seq")])
    report["sink_summary"] = _rows(sinks.reachability(g.nodes, g.edges).orderBy("sink_type"))
    report["access_control_gaps"] = part("access_control_gaps", sections.access_gaps(g.nodes, g.edges), [F.col("seq")])
    report["silent_state_changes"] = part("silent_state_changes", sections.silent_changes(g.nodes, g.edges), [F.desc("state_writes"), F.col("seq")])
    dead = sections.dead_code(g.nodes, g.edges)
    for kind in ("dead_internal", "direct_entry_point"):
        own = dead.where(F.col("kind") == kind)
        if dead_code_details:
            report[f"dead_code.{kind}"] = part(f"dead_code.{kind}", own, [F.col("seq")])
        else:
            summed[f"dead_code.{kind}"] = caps.section(own.count(), 0)
    report["defi_summary"] = {k: tallies[k] for k in sections.DEFI_SUMMARY if k in tallies}
    report["unsafe_summary"] = {k: tallies[k] for k in sections.UNSAFE_SUMMARY if k in tallies}
    report["sections"] = summed
    report["truncated"] = any(s["truncated"] for s in summed.values())
    return report


def hotspots(g: Graph, top: int = 30, production: bool = False) -> dict:
    g = _graph(g, production)
    found = rules.hotspots(g.nodes, g.edges).cache()
    buckets = {r[0]: r[1] for r in found.groupBy("bucket").count().collect()}
    rows = _rows(caps.top(found, [F.desc("score"), F.col("seq")], max(0, top)).drop("seq"))
    found.unpersist()
    return {"query_scope": _scope(production), "total": sum(buckets.values()), "buckets": buckets, "hotspots": rows}


def scan(g: Graph, kind: str, category: str = "all", production: bool = False, max_per_category: int = 25, max_details: int = 10) -> dict:
    """kind: defi or unsafe."""
    category = (category or "all").lower()
    nodes = _graph(g, production).nodes
    keys = scanners.defi_keys(category) if kind == "defi" else scanners.unsafe_keys(category)
    out: dict = {}
    totals: dict = {}
    cut = 0
    for row in _rows(scanners.scan(nodes, keys, max(0, max_per_category)).orderBy("category", "file", "line_start", "id")) if keys else ():
        meta = json.loads(row.pop("metadata"))
        value, left = meta.get(row["key"]), 0
        if isinstance(value, list):
            value, left = caps.cap_list(value, max(0, max_details))
        cut += left
        totals[row["category"]] = row["total"]
        item = {"function": row["label"], "file": row["file"], "line": row["line_start"], "visibility": row["visibility"], "source_context": row["source_context"]}
        if field := keys[row["key"]][1]:
            item[field] = value
        if row["key"] == "unsafe_blocks":
            item |= {"unsafe_operations": meta.get("unsafe_operations", []), "raw_pointers": meta.get("raw_pointers", False)}
        out.setdefault(row["category"], []).append(item)
    if kind == "unsafe" and category in ("all", "ffi"):
        ffi = scanners.foreign_calls(nodes).drop("id")
        if total := ffi.count():
            totals["ffi_risks"] = total
            out["ffi_risks"] = _rows(ffi.limit(max_per_category) if max_per_category > 0 else ffi)
    shown = {k: len(v) for k, v in out.items()}
    truncated = {k: {"total": totals[k], "shown": shown[k]} for k in totals if shown[k] < totals[k]}
    out["summary"] = {"total_findings": sum(totals.values()), "shown_findings": sum(shown.values()), "category_totals": totals, "truncated_categories": truncated, "truncated": bool(truncated) or cut > 0, "detail_truncated_items": cut, "query_scope": _scope(production)}
    return out


def sink_report(g: Graph, sink_type: str = "", external_only: bool = False, production: bool = False, max_results: int = 50, max_callers: int = 10) -> dict:
    scoped = _graph(g, production).nodes
    own = sinks.sinks(scoped, sink_type)
    rows = _rows(caps.capped(own.drop("metadata"), [F.col("file"), F.col("line_start"), F.col("id")], max(0, max_results)))
    by: dict = {}
    for c in _rows(sinks.capped_callers(g.nodes, g.edges, max(0, max_callers), sink_type=sink_type, external_only=external_only, production_only=production).orderBy("sink", "distance", "file", "line_start", "id")):
        by.setdefault(c.pop("sink"), []).append(c)
    for row in rows:
        row["callers"] = by.get(row["id"], [])
        row["callers_total"] = row["callers"][0]["total"] if row["callers"] else 0
    return {"query_scope": _scope(production), "by_type": caps.count_map(own, "sink_type")[0], "sinks": rows, "info": caps.section(own.count(), len(rows))}


def path_report(g: Graph, start: str, end: str, max_depth: int = 15, max_paths: int = 10, production: bool = False, guards: bool = False, state: bool = False, max_candidates: int = 50) -> dict:
    found = paths.call_paths(g.nodes, g.edges, start, end, max_depth, max_paths, production_only=production).cache()
    rows = _rows(found)
    out: dict = {"query_scope": _scope(production), "paths": rows, "found": len(rows)}
    for side, name in (("from", start), ("to", end)):
        many = match.staged_match(g.nodes, name, production_only=production).select("id", "label", "file").orderBy("id")
        out[f"{side}_candidates"] = _rows(many.limit(max_candidates) if max_candidates else many)
    if rows and (guards or state):
        notes = paths.annotations(found, g.nodes, g.edges)
        kinds = ["guard"] * guards + ["read", "write"] * state
        out["annotations"] = _rows(notes.where(F.col("kind").isin(*kinds)).select("key", "at", "id", "kind", "label").orderBy("key", "at", "kind", "label").withColumn("key", F.split("key", "\x00")))
    found.unpersist()
    return out


def trace(g: Graph, variable: str, callers: bool = False, production: bool = False, max_matches: int = 20, max_accessors: int = 100, max_callers: int = 20) -> dict:
    parts = relations.trace(g.nodes, g.edges, variable, production, max(0, max_matches), max(0, max_accessors), callers, max(0, max_callers))
    order = {"variables": ["file", "id"], "accessors": ["access", "file", "line_start", "id"], "callers": ["of", "file", "id"]}
    return {"query_scope": _scope(production)} | {k: _rows(df.drop("metadata", "seq").orderBy(*order[k])) for k, df in parts.items()}


def cross(g: Graph, start: str = "", production: bool = False, max_results: int = 50, summary_only: bool = False, top: int = 50, max_counters: int = 10, max_attributes: int = 2048) -> dict:
    """Calls across trust boundaries; from one function, whose name must be unique, or of the whole graph."""
    begin = None
    if start:
        found = match.staged_match(g.nodes, start, "function", production)
        candidates = _rows(found.select("id", "label", "file").orderBy("id").limit(20))
        if len(candidates) != 1:
            return {"error": "ambiguous" if candidates else "not found", "candidates": candidates}
        begin = found.select("id")
    calls = relations.boundary_calls(g.nodes, g.edges, begin, production).cache()
    out: dict = {"query_scope": _scope(production), "total": calls.count()}
    if summary_only:
        counted: dict = {}
        for r in relations.boundary_summary(calls).orderBy("kind", F.desc("n"), "name").collect():
            group = counted.setdefault(r["kind"], {})
            if not max_counters or len(group) < max_counters:
                group[r["name"]] = r["n"]
        out["summary"] = counted
    rows = _rows(caps.capped(calls, [F.col("source"), F.col("target")], top if summary_only else max(0, max_results)))
    for row in rows:
        row["attributes"], row["attributes_info"] = caps.cap_json(row["attributes"], max_attributes, caps.ATTRIBUTES_KEPT)
    calls.unpersist()
    return out | {"calls": rows, "info": caps.section(out["total"], len(rows))}


def state_report(g: Graph, entity: str = "", production: bool = False, max_entities: int = 20, max_transitions: int = 50, max_warnings: int = 50) -> dict:
    g = _graph(g, production)
    moves = g.transitions.where(F.col("entity") == entity) if entity else g.transitions
    shown = _rows(states.by_entity(moves, g.nodes, max(0, max_entities), max(0, max_transitions)).drop("seq").orderBy("entity", "from_state", "to_state", "function_id"))
    found = states.warnings(moves).cache()
    total, rows = found.count(), _rows(caps.capped(found, [F.col(c) for c in states.WARNING], max(0, max_warnings)))
    found.unpersist()
    return {"query_scope": _scope(production), "entities": caps.count_map(moves, "entity", 100)[0], "transitions": shown, "warnings": rows, "info": caps.section(total, len(rows))}


def lookup(g: Graph, name: str, depth: int = 1, production: bool = False, max_matches: int = 20, max_items: int = 100) -> dict:
    parts = relations.lookup(g.nodes, g.edges, name, depth, production, max(0, max_matches), max(0, max_items))
    out = {"query_scope": _scope(production), "functions": _rows(parts["functions"].drop("seq"))}
    for key in ("profile", "second"):
        if key in parts:
            nested: dict = {}
            for r in _rows(parts[key].orderBy("of", "part", "file", "id")):
                slot = nested.setdefault(r["of"], {}).setdefault(r["part"], {"total": r["total"], "items": []})
                if r["id"] is not None:
                    slot["items"].append({k: r[k] for k in ("relation", "id", "label", "file", "line_start", "visibility")})
            out[key] = nested
    return out


def guide() -> dict:
    """Which report answers what, in the order of use."""
    return {
        "workflow": ["profile", "build", "overview", "audit", "hotspots"],
        "reports": {name: (f.__doc__ or "").strip().split("\n")[0] for name, f in REPORTS.items()} | {"build": "Reads a source tree and writes its graph.", "profile": profile.__doc__},
    }


REPORTS = {"overview": overview, "audit": audit, "hotspots": hotspots, "scan": scan, "sinks": sink_report, "paths": path_report, "trace": trace, "cross": cross, "state": state_report, "lookup": lookup}


def run(spark: SparkSession, path: str, report: str, timeout: float = 0, **arguments) -> dict:
    """A report on a stored graph. A missing graph and a spent time budget give an error in the dict."""
    try:
        with builder.budget(spark, timeout, report):
            return REPORTS[report](Graph.load(spark, path), **arguments)
    except MissingGraph:
        return {"error": "missing graph", "report": report, "path": path}
    except builder.OutOfTime as error:
        return {"error": "timeout", "report": report, "detail": str(error)}
