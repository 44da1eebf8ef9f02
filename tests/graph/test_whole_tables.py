"""Queries against plain versions over whole tables, without the cuts of their SQL."""

import json
import random
from collections import defaultdict

import duckdb

from graphloom.operators import traverse

SF = "/root/testdata/sf0.001"


def walked(edges):
    """{(start, node): least number of edges, one at least}."""
    on = defaultdict(set)
    for a, b in edges:
        on[a].add(b)
    out = {}
    for start in list(on):
        front, hops = on[start], 1
        while front:
            out |= {(start, n): hops for n in front}
            front, hops = {m for n in front for m in on[n] if (start, m) not in out}, hops + 1
    return out


def test_closure_goes_round_cycles_to_its_end(spark):
    rng = random.Random(3)
    ring = [(f"r{i}", f"r{(i + 1) % 23}") for i in range(23)] + [("loop", "loop"), ("loop", "r0")]
    loose = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(40)]
    edges = sorted(set(ring + loose))
    want = walked(edges)
    assert want["r0", "r0"] == 23 and want["loop", "loop"] == 1
    got = traverse.cyclic_closure(spark.createDataFrame(edges, "source string, target string")).collect()
    assert len(got) == len(want) and {(r.start, r.node): r.distance for r in got} == want


def test_closure_by_bits_is_that_by_joins(spark, monkeypatch):
    from graphloom.operators import bits

    monkeypatch.setattr(bits, "WIDTH", 2)
    rng = random.Random(5)
    dense = {(f"d{rng.randrange(300)}", f"d{rng.randrange(300)}") for _ in range(2500)}
    edges = sorted(dense | {(f"c{i}", f"c{i + 1}") for i in range(150)} | {("c150", "d0"), ("c9", "c9")})
    want = walked(edges)
    frame = spark.createDataFrame([*edges, *edges[:9], ("d1", None), (None, "d1")], "source string, target string")
    plan = traverse.cyclic_closure(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # a join makes a row for each pair and edge on
    got = traverse.cyclic_closure(frame).collect()
    assert len(got) == len(want) and {(r.start, r.node): r.distance for r in got} == want
    monkeypatch.setattr(traverse, "FEW_EDGES", 10)
    got = traverse.cyclic_closure(frame).collect()
    assert len(got) == len(want) and {(r.start, r.node): r.distance for r in got} == want
    assert bits.all_reached(frame.where("false")).count() == 0


def test_closure_of_millions_of_edges_goes_by_bits(spark):
    n = 1600
    frame = spark.range(n * n).selectExpr(f"'a' || id % {n} AS source", f"'b' || id DIV {n} AS target")
    got = traverse.cyclic_closure(frame)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # joins store all pairs, time and again
    assert got.selectExpr("count(*)", "count(DISTINCT start, node)", "min(distance)", "max(distance)").first()[:] == (n * n, n * n, 1, 1)


def test_closure_numbers_nodes_in_tasks(spark, monkeypatch):
    from graphloom.operators import bits

    rng = random.Random(7)
    dense = {(f"d{rng.randrange(200)}", f"d{rng.randrange(200)}") for _ in range(700)}
    edges = sorted(dense | {(f"c{i}", f"c{i + 1}") for i in range(90)} | {(f"x{i}", f"y{i}") for i in range(80)} | {("d7", "c5")})
    want = walked(edges)
    monkeypatch.setattr(bits, "AT_ONCE", 0)
    for roots in (64, 3):  # 3: most starts have no place in the order
        monkeypatch.setattr(bits, "ROOTS", roots)
        got = bits.all_reached(spark.createDataFrame(edges, "source string, target string")).collect()
        assert len(got) == len(want) and {(r.start, r.node): r.distance for r in got} == want
    assert bits.all_reached(spark.createDataFrame(edges, "source string, target string").where("false")).count() == 0


def test_cyclic_closure_has_users_that_reach_themselves(spark):
    from graphloom.plans import projection, queries

    want = walked([tuple(r) for r in projection.users(spark, SF).select("source", "target").collect()])
    got = queries.QUERIES["cyclic_closure"](spark, SF).collect()
    assert len(got) == len(want) and {(r.start, r.node): r.distance for r in got} == want


def test_users_are_linked_by_all_events(spark):
    from graphloom.plans import projection

    events = spark.read.parquet(f"{SF}/events.parquet").select("ts", "event_id", "user_id").collect()
    by = [str(r.user_id) for r in sorted(events)]
    got = [tuple(r) for r in projection.users(spark, SF).select("source", "target").collect()]
    assert sorted(got) == sorted({(a, b) for a, b in zip(by, by[1:], strict=False) if a != b})


def test_every_line_is_located(spark):
    from graphloom.plans import projection, queries

    db = duckdb.connect()
    for t in ("orders", "part", "supplier"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    nodes = db.execute(projection.sql(" SELECT file, type, line_start, line_end, id, seq FROM nodes", "nodes")).fetchall()
    home = {seq: file for file, kind, _, _, _, seq in nodes if kind == "function" and seq < 1_000_000_000}
    by_file = defaultdict(list)
    for file, kind, *rest in nodes:
        by_file[file].append(({"function": 0, "modifier": 1}.get(kind, 2), *rest))
    want = {}
    for key, quantity in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_quantity").collect():
        line, own = int(quantity * 20), by_file[home[key]]
        inside = min(((r, e - s, s, i) for r, s, e, i, _ in own if s <= line <= e), default=None)
        near = min((r, abs(s - line), s, i) for r, s, _, i, _ in own)
        want[f"{key}-{int(quantity)}"] = inside[3] if inside else near[3] if near[1] <= 3 else None
    got = queries.QUERIES["located_lines"](spark, SF).collect()
    assert len(got) == len(want) and {r.probe: r.id for r in got} == want


def raw_edges(spark):
    """{(source, target): its (seq, attributes) in order} of all order keys."""
    out = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        seq = r.l_orderkey * 100_000_000 + r.l_linenumber * 10_000_000 + r.l_partkey
        out[f"n{r.l_partkey % 300}", f"m{r.l_suppkey % 10}"].append((seq, f'{{"k{r.l_linenumber}":{int(r.l_quantity)},"last":"{r.l_returnflag}"}}'))
    return {k: sorted(v) for k, v in out.items()}


def test_edges_of_all_orders_are_inserted(spark):
    from graphloom.plans import queries

    want = {k: (*v[0], *v[-1]) for k, v in raw_edges(spark).items()}
    got = queries.QUERIES["inserted_edges"](spark, SF).collect()
    assert len(got) == len(want)
    assert {(r.source, r.target): (r.first_seq, r.first_attributes, r.last_seq, r.last_attributes) for r in got} == want


def test_edges_of_all_orders_are_merged(spark):
    from graphloom.plans import queries

    want = {}
    for key, rows in raw_edges(spark).items():
        merged = {}
        for _, attributes in rows:
            merged |= json.loads(attributes)
        want[key] = merged
    got = queries.QUERIES["merged_edges"](spark, SF).collect()
    assert len(got) == len(want) and {(r.source, r.target): json.loads(r.attributes) for r in got} == want


def test_closure_in_parts(spark, monkeypatch):
    rng = random.Random(6)
    edges = sorted({(f"p{rng.randrange(40)}", f"p{rng.randrange(40)}") for _ in range(60)})
    frame = spark.createDataFrame(edges, "source string, target string")
    starts = frame.select("source")
    want = sorted(map(tuple, traverse.closure(starts, frame).collect()))
    monkeypatch.setattr(traverse, "PART", 12)
    assert sorted(map(tuple, traverse.closure_in_parts(starts, frame, lambda pairs: pairs).collect())) == want


def test_surface_and_taint_store_no_whole_graph(spark, monkeypatch):
    from graphloom.operators import sinks
    from graphloom.plans import projection, queries

    tables = "/root/testdata/sf0.01"  # the smallest that has sinks
    db = duckdb.connect()
    for t in ("orders", "part", "supplier", "lineitem"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    monkeypatch.setattr(projection, "_stored", {})
    for together in (False, True):
        for name in ("tainted_entries", "attack_surface"):
            found = queries.QUERIES[name](spark, tables)
            want = db.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.SQL[name]})").fetchall()
            assert want and sorted(map(tuple, found.collect())) == sorted(want)
        monkeypatch.setattr(sinks, "hashes_tell_apart", lambda ids: False)  # as if two ids had one hash
    assert not projection._stored
