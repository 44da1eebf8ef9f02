import pytest
from pyspark.sql import functions as F

from graphloom.functions import payload as p
from graphloom.operators import audit, match, paths, relations, rules, scanners, sinks, states, summary, traverse
from graphloom.plans import postpass, tools
from graphloom.sources import flows
from graphloom.sources.store import Graph, MissingGraph


def ids(df, *columns):
    rows = [tuple(r) for r in df.select(*(columns or ("id",))).collect()]
    return sorted(r[0] if len(r) == 1 else r for r in rows)


def starts(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


@pytest.fixture(scope="module")
def nine(spark):
    def node(i, visibility="", signature="", kind="function", meta="{}"):
        return {"id": f"m.sol::K.{i}", "label": i, "type": kind, "visibility": visibility, "file": "m.sol", "signature": signature, "metadata": meta}

    def edge(s, t, relation="calls", attributes="{}"):
        return {"source": f"m.sol::K.{s}", "target": t if "::" in t else f"m.sol::K.{t}", "relation": relation, "attributes": attributes}

    nodes = [node("A", "external", "dep(uint a)"), node("B", "internal"), node("C", "internal"), node("S", meta='{"is_sink": true, "sink_type": "fund_transfer"}'), node("W", "external", "close()"), node("R", "external", "r(uint a)", meta='{"source_context": "script"}'), node("X", kind="state_var"), node("Y", kind="state_var"), node("M", kind="modifier")]
    edges = [edge("A", "B"), edge("B", "C"), edge("C", "B"), edge("C", "S", attributes='{"sink": true}'), edge("R", "A"), edge("A", "_::ext", attributes='{"unresolved": true, "call_name": "ext"}'), edge("C", "X", "writes_state"), edge("A", "X", "reads_state"), edge("W", "Y", "writes_state"), edge("M", "W", "guards")]
    return Graph.from_rows(spark, nodes, edges)


def test_counts(nine):
    assert (nine.edges.count(), summary.valid_edges(nine.nodes, nine.edges).count()) == (10, 9)
    only = nine.production()
    assert (only.edges.count(), summary.valid_edges(only.nodes, only.edges).count()) == (8, 8)
    assert summary.phantom_targets(nine.nodes, nine.edges).count() == 1


def test_closure_and_surface(nine):
    got = {r["label"]: (r["reachable_count"], r["state_writes"]) for r in sinks.attack_surface(nine.nodes, nine.edges).collect()}
    assert got == {"A": (5, 1), "R": (6, 1), "W": (1, 1)}
    valid = {r["label"]: r["reachable_count"] for r in sinks.attack_surface(nine.nodes, nine.edges, valid_only=True).collect()}
    assert valid == {"A": 4, "R": 5, "W": 1}


def test_sinks_and_taint(nine):
    assert {(r["id"][-1], r["distance"]) for r in sinks.callers(nine.nodes, nine.edges).collect()} == {("C", 1), ("B", 2), ("A", 3), ("R", 4)}
    assert {(r["label"], r["risk"]) for r in sinks.taint(nine.nodes, nine.edges).collect()} == {("A", "HIGH"), ("R", "HIGH")}
    assert ids(traverse.propagate_sinks(nine.nodes, nine.edges)) == [f"m.sol::K.{x}" for x in "ABCR"]


def test_paths(spark, nine):
    found = paths.call_paths(nine.nodes, nine.edges, "A", "S").collect()
    assert [r["labels"] for r in found] == [["A", "B", "C", "S"]]
    assert paths.call_paths(nine.nodes, nine.edges, "A", "S", max_depth=2).count() == 0
    assert paths.call_paths(nine.nodes, nine.edges, "S", "A").count() == 0
    assert paths.call_paths(nine.nodes, nine.edges, "A", "A").count() == 0


def test_boundary_calls(nine):
    calls = relations.boundary_calls(nine.nodes, nine.edges)
    assert (calls.count(), calls.where("unresolved").count(), calls.where("sink").count()) == (2, 1, 1)


def test_audit_sections(nine):
    assert ids(audit.silent_changes(nine.nodes, nine.edges), "label") == ["W"]
    assert audit.access_gaps(nine.nodes, nine.edges).count() == 0
    assert ids(audit.dead_code(nine.nodes, nine.edges), "kind", "label") == [("direct_entry_point", "W")]
    assert {(r["label"], r["score"]) for r in rules.hotspots(nine.nodes, nine.edges).collect()} == {("A", 3), ("W", 3)}


def test_reports(nine):
    report = tools.audit(nine, top=1)
    assert report["sections"]["taint_paths"] == {"total": 2, "shown": 1, "truncated": True}
    assert tools.sink_report(nine)["sinks"][0]["callers_total"] == 4
    assert tools.lookup(nine, "A")["profile"]["m.sol::K.A"]["callees"]["total"] == 2
    assert len(tools.lookup(nine, "A")["profile"]["m.sol::K.A"]["callees"]["items"]) == 1
    assert tools.cross(nine, summary_only=True)["summary"]["total"] == {"": 2}
    assert tools.hotspots(nine, top=0)["hotspots"] == [] and tools.hotspots(nine)["total"] == 2
    assert [v["label"] for v in tools.trace(nine, "X")["variables"]] == ["X"]
    assert tools.overview(nine, attack_surface=True)["attack_surface"][0]["state_writes"] == 1
    assert set(tools.guide()["reports"]) > {"audit", "lookup"}


def test_false_like_attributes(spark):
    calls = ['{"unresolved": true}', '{"unresolved": "true"}', '{"unresolved": 1}', '{"unresolved": [0]}', '{"unresolved": "yes"}', '{"sink": "broadcast"}', '{"unresolved": "no"}', '{"unresolved": false}', '{"unresolved": 0.0}', '{"unresolved": null}', '{"unresolved": " False "}', '{"unresolved": {}}', "broken", '{"unresolved": true, "internal_candidate": true}', '{"unresolved": "0.0"}']
    df = spark.createDataFrame([(c,) for c in calls], "a string")
    assert [r[0] for r in df.select(p.boundary("a")).collect()] == [True] * 6 + [False] * 8 + [True]
    assert [r[0] for r in spark.createDataFrame([('{"k": "false"}',), ('{"k": false}',), ('{"k": ""}',), ('{"k": [1]}',), ("{}",)], "a string").select(p.truthy("a", "k")).collect()] == [True, False, False, True, False]


def test_staged_match_counts_before_the_scope(spark):
    g = Graph.from_rows(spark, [{"id": "s::run", "label": "run", "type": "function", "file": "s", "metadata": '{"source_kind": "research"}'}, {"id": "p::rerun", "label": "rerun", "type": "function", "file": "p"}])
    assert ids(match.staged_match(g.nodes, "run")) == ["s::run"]
    assert match.staged_match(g.nodes, "run", production_only=True).count() == 0
    assert ids(match.staged_match(g.nodes, "RERUN")) == ["p::rerun"]


def test_shared_functions_count_once(spark):
    nodes = [{"id": x, "label": x, "type": "function", "file": "f", "metadata": '{"is_sink": true, "sink_type": "fund_transfer"}' if x.startswith("sink") else "{}"} for x in ("entry", "route", "sinkA", "sinkB")]
    edges = [{"source": a, "target": b, "relation": "calls"} for a, b in (("entry", "route"), ("route", "sinkA"), ("route", "sinkB"))]
    g = Graph.from_rows(spark, nodes, edges)
    assert [tuple(r) for r in sinks.reachability(g.nodes, g.edges).collect()] == [("fund_transfer", 2, 4)]


def test_toggle_once(spark):
    moves = [{"entity": "V", "from_state": "Active", "to_state": "Paused", "function_id": "a", "conditions": "[]"}, {"entity": "V", "from_state": "Paused", "to_state": "Active", "function_id": "b", "conditions": '["onlyOwner"]'}]
    g = Graph.from_rows(spark, [], [], moves)
    assert ids(states.warnings(g.transitions), "warning", "state", "other") == [("TOGGLE", "Active", "Paused")]


def test_scanner_caps(spark):
    nodes = [{"id": f"n{i}", "label": f"n{i}", "type": "function", "file": "f.sol", "line_start": i, "metadata": '{"oracle_risk": ["a", "b", "c"], "unchecked_erc20": []}'} for i in range(4)]
    g = Graph.from_rows(spark, nodes)
    out = tools.scan(g, "defi", max_per_category=2, max_details=1)
    assert [f["risks"] for f in out["oracle_manipulation"]] == [["a"], ["a"]] and "unchecked_erc20" not in out
    assert out["summary"]["category_totals"] == {"oracle_manipulation": 4} and out["summary"]["detail_truncated_items"] == 4
    assert scanners.findings(g.nodes, scanners.defi_keys("erc20")).count() == 0


def test_store(spark, nine, tmp_path):
    nine.facts = {"n": 1}
    nine.save(str(tmp_path / "g"))
    again = Graph.load(spark, str(tmp_path / "g"))
    assert ids(again.nodes) == ids(nine.nodes) and again.edges.count() == 10 and again.facts == {"n": 1}
    with pytest.raises(MissingGraph):
        Graph.load(spark, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    assert tools.run(spark, str(tmp_path / "none"), "audit")["error"] == "missing graph"
    assert tools.run(spark, str(tmp_path / "g"), "hotspots")["total"] == 2


def test_passes(spark):
    nodes = [
        {"id": "a.sol::Base.f(uint)", "label": "f", "type": "function", "file": "a.sol"},
        {"id": "a.sol::Base", "label": "Base", "type": "contract", "file": "a.sol"},
        {"id": "b.sol::Child", "label": "Child", "type": "contract", "file": "b.sol"},
        {"id": "b.sol::Child.g()", "label": "g", "type": "function", "file": "b.sol", "visibility": "external"},
        {"id": "c.sol::Lib.h()", "label": "h", "type": "function", "file": "c.sol"},
    ]
    edges = [
        {"source": "b.sol::Child", "target": "_::Base", "relation": "inherits"},
        {"source": "b.sol::Child.g()", "target": "a.sol::Base.f", "relation": "calls"},
        {"source": "b.sol::Child.g()", "target": "_::h", "relation": "calls", "attributes": '{"unresolved": true, "call_name": "h"}'},
    ]
    g = postpass.annotate(Graph.from_rows(spark, nodes, edges))
    assert ids(g.edges, "source", "target", "relation") == [("b.sol::Child", "a.sol::Base", "inherits"), ("b.sol::Child.g()", "a.sol::Base.f(uint)", "calls"), ("b.sol::Child.g()", "c.sol::Lib.h()", "calls")]
    assert g.edges.where(F.col("attributes") == postpass.RESOLVED).count() == 1
    late = postpass.resolve_bare_calls(g.nodes, g.edges.where("relation = 'inherits'").union(spark.createDataFrame([("x", "b.sol::Child.f", "calls", "{}", 9)], g.edges.schema)))
    assert ("x", "a.sol::Base.f(uint)", "calls") in ids(late, "source", "target", "relation")
    assert postpass.confidence(10, 10, 10, 0) == {"score": 100.0, "tier": "high"} and postpass.confidence(10, 5, 5, 5)["tier"] == "low"


def test_flows(spark, tmp_path):
    place = lambda f, n: {"location": {"physicalLocation": {"artifactLocation": {"uri": f}, "region": {"startLine": n}}}}
    import json

    threads = [{"locations": [place("./a.c", 12), place("a.c", 35)]}, {"locations": [place("gone.c", 1), place("a.c", 12)]}, {"locations": [place("a.c", 12), place("a.c", 13)]}]
    (tmp_path / "s.sarif").write_text(json.dumps({"runs": [{"results": [{"ruleId": "r", "codeFlows": [{"threadFlows": threads}]}]}]}))
    g = Graph.from_rows(spark, [{"id": "one", "label": "one", "type": "function", "file": "a.c", "line_start": 10, "line_end": 20}, {"id": "two", "label": "two", "type": "function", "file": "a.c", "line_start": 30, "line_end": 40}])
    made, lost = flows.flow_edges(flows.read_sarif(spark, str(tmp_path / "s.sarif")), g.nodes)
    assert ids(made, "source", "target") == [("one", "two")] and lost.count() == 1
    near = flows.resolve(spark.createDataFrame([(1, "a.c", 27), (2, "a.c", 26), (3, "b.c", 1)], "probe int, file string, line int"), g.nodes)
    assert ids(near, "probe", "id") == [(1, "two"), (2, None), (3, None)]
