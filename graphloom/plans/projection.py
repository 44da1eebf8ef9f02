"""A property graph made from the star-schema tables, by SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphloom.operators.traverse import cut
from graphloom.sources.store import Graph

#: Which functions have which metadata: (modulus of the order key, JSON member).
FLAGS = (
    (11, '"reentrancy_risk":true'),
    (13, '"cross_reentrancy":[{"via":"g1","stale_vars":["a","b"]},{"via":"g2","stale_vars":["c"]}]'),
    (17, '"unchecked_erc20":["transfer","approve"]'),
    (7, '"timestamp_dependence":["block.timestamp"]'),
    (19, '"view":true'),
    (23, '"modifiers":["onlyOwner"]'),
    (29, '"role_guards":[]'),
    (31, '"oracle_risk":["getReserves"]'),
    (37, '"signature_risk":"no_nonce"'),
    (41, '"dos_risk":[{"type":"unbounded_loop","line":3},{"type":"external_call_in_loop","line":4},{"type":"unbounded_loop","line":9}]'),
    (43, '"slippage_risk":["no_min_out","no_deadline"]'),
    (47, '"anchor_risks":[{"type":"missing_signer"},{"type":"weak_pda_seeds"}]'),
    (53, '"buffer_overflow_risk":["strcpy"]'),
    (59, '"command_injection_risk":["system","popen"]'),
    (61, '"no_input_validation":"false"'),
    (67, '"has_assembly":0'),
    (71, '"unsafe_blocks":2'),
    (73, '"private_key_material":true'),
    (79, '"language":"go","unsafe_type_assertions":["x.(T)"]'),
    (83, '"cross_contract_calls":[]'),
    (89, '"is_sink":"no","sink_type":"decoy"'),
    (97, '"panic_paths":["unwrap"],"weak_crypto":["md5"]'),
)

_JSON = "'{' || concat_ws(',', " + "CASE WHEN substr(o_orderpriority, 1, 1) = '5' THEN '\"source_kind\":\"research\",\"source_context\":\"script\"' END, " + ", ".join(f"CASE WHEN o_orderkey % {m} = 0 THEN '{j}' END" for m, j in FLAGS) + ") || '}'"

FUNCTIONS = f"""
SELECT o_orderkey, o_custkey, o_orderdate, o_orderstatus, file, home,
  home || '.' || label || '(uint' || CAST(o_orderkey AS STRING) || ')' AS id, label,
  {_JSON} AS metadata
FROM (
  SELECT *, file || '::C' || CAST(o_custkey % 50 AS STRING) AS home,
    CASE WHEN o_orderkey % 101 = 0 THEN 'transfer' WHEN o_orderkey % 103 = 0 THEN 'constructor' ELSE 'f' || CAST(o_orderkey % 997 AS STRING) END AS label
  FROM (
    SELECT *, CASE substr(o_orderpriority, 1, 1)
      WHEN '1' THEN 'contracts/vault' || CAST(o_custkey % 20 AS STRING) || '.sol'
      WHEN '2' THEN 'src/keeper' || CAST(o_custkey % 20 AS STRING) || '.go'
      WHEN '3' THEN 'programs/pool' || CAST(o_custkey % 20 AS STRING) || '.rs'
      WHEN '4' THEN 'native/codec' || CAST(o_custkey % 20 AS STRING) || '.c'
      ELSE 'scripts/task' || CAST(o_custkey % 20 AS STRING) || '.sol' END AS file
    FROM $orders) a) b
"""

NODES = """
SELECT id, label, 'function' AS type, CASE o_orderstatus WHEN 'O' THEN 'external' WHEN 'P' THEN 'public' ELSE 'internal' END AS visibility,
  file, CAST(o_orderkey % 1000 AS INT) AS line_start, CAST(o_orderkey % 1000 + o_orderkey % 7 AS INT) AS line_end,
  'function ' || label || CASE WHEN o_orderkey % 3 = 0 THEN '()' ELSE '(uint a)' END AS signature, metadata, CAST(o_orderkey AS BIGINT) AS seq FROM $functions
UNION ALL
SELECT home, 'C' || CAST(o_custkey % 50 AS STRING), CASE WHEN o_custkey % 50 % 10 = 0 THEN 'library' ELSE 'contract' END, '', file, 0, 0, '', '{}', 1000000000 + min(o_custkey)
FROM $functions GROUP BY home, file, o_custkey % 50
UNION ALL
SELECT 'contracts/state.sol::S' || CAST(p_size AS STRING) || '.v' || CAST(p_partkey AS STRING), p_brand, 'state_var', 'internal', 'contracts/state.sol', CAST(p_size AS INT), CAST(p_size + 0 AS INT), p_type, '{}', 2000000000 + p_partkey FROM $part
UNION ALL
SELECT CASE WHEN s_suppkey % 10 = 0 THEN '_sink_s' ELSE 's:' END || CAST(s_suppkey AS STRING), CASE WHEN s_suppkey % 10 = 0 THEN 'send' || CAST(s_suppkey AS STRING) ELSE s_name END,
  CASE WHEN s_suppkey % 10 = 0 THEN 'function' ELSE 'modifier' END, 'internal', 'contracts/base.sol', CAST(s_suppkey % 100 AS INT), CAST(s_suppkey % 100 AS INT), '',
  CASE WHEN s_suppkey % 10 > 0 THEN '{}' WHEN s_suppkey % 50 = 0 THEN '{"is_sink":"false","sink_type":"delegate"}' WHEN s_suppkey % 20 = 0 THEN '{"is_sink":true,"sink_type":"fund_transfer"}'
    WHEN s_suppkey % 30 = 0 THEN '{"is_sink":1}' ELSE '{"is_sink":true,"sink_type":"unsafe_ffi"}' END, 3000000000 + s_suppkey FROM $supplier
"""

EDGES = """
SELECT source, target, 'calls' AS relation, '{' || concat_ws(',', '"order":' || CAST(k % 40 AS STRING), CASE WHEN k % 5 = 0 THEN '"unresolved":true' END,
    CASE WHEN k % 10 = 0 THEN '"internal_candidate":"yes"' END, CASE WHEN k % 17 = 0 THEN '"sink":"broadcast"' END, CASE WHEN k % 23 = 0 THEN '"cross_boundary":"False "' END) || '}' AS attributes, k AS seq
FROM (SELECT id AS source, o_orderkey AS k, lead(id) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS target FROM $functions) c WHERE target IS NOT NULL
UNION ALL
SELECT f.id, '_sink_s' || CAST(l_suppkey AS STRING), 'calls', '{"order":1,"sink":true}', min(1000000000 + l_orderkey * 10 + l_linenumber)
FROM $lineitem JOIN $functions f ON l_orderkey = o_orderkey WHERE l_suppkey % 10 = 0 AND l_linenumber = 2 GROUP BY f.id, l_suppkey
UNION ALL
SELECT id, '_::ext' || CAST(o_orderkey % 40 AS STRING), 'calls', '{"unresolved":true,"call_name":"f' || CAST(o_orderkey % 200 AS STRING) || '"}', 20000000000 + o_orderkey FROM $functions WHERE o_orderkey % 29 = 0
UNION ALL
SELECT f.id, 'contracts/state.sol::S' || CAST(p_size AS STRING) || '.v' || CAST(p_partkey AS STRING), CASE l_linestatus WHEN 'O' THEN 'writes_state' ELSE 'reads_state' END,
  '{"order":' || CAST(min(l_linenumber) AS STRING) || '}', min(30000000000 + l_orderkey * 10 + l_linenumber)
FROM $lineitem JOIN $functions f ON l_orderkey = o_orderkey JOIN $part ON l_partkey = p_partkey GROUP BY f.id, p_size, p_partkey, l_linestatus
UNION ALL
SELECT 's:' || CAST(l_suppkey AS STRING), f.id, 'guards', '{}', 60000000000 + l_orderkey FROM $lineitem JOIN $functions f ON l_orderkey = o_orderkey WHERE l_linenumber = 1 AND l_suppkey % 10 > 5
UNION ALL
SELECT id, 'event:' || CAST(o_orderkey % 9 AS STRING), 'emits_event', '{}', 70000000000 + o_orderkey FROM $functions WHERE o_orderkey % 4 = 0
UNION ALL
SELECT home, id, 'contains', '{}', 80000000000 + o_orderkey FROM $functions
UNION ALL
SELECT home, file || '::C' || CAST(CAST(floor((o_custkey % 50) / 2) AS INT) AS STRING), 'inherits', '{}', 90000000000 + min(o_custkey) FROM $functions WHERE o_custkey % 50 > 1 GROUP BY home, file, o_custkey % 50
"""

TRANSITIONS = """
SELECT entity, from_state, to_state, function_id, conditions, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY entity, from_state, to_state, function_id ORDER BY seq) AS n FROM (
    SELECT 'user' || CAST(user_id % 20 AS STRING) AS entity, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), '*') AS from_state,
      CASE WHEN user_id % 20 < 4 AND event_type = 'purchase' THEN 'exists' WHEN user_id % 20 = 3 AND event_type = 'error' THEN 'deleted' ELSE event_type END AS to_state,
      'e:' || CAST(user_id AS STRING) AS function_id, CASE WHEN event_id % 2 = 0 THEN '[]' WHEN event_id % 5 = 0 THEN '["no_validation"]' WHEN event_id % 3 = 0 THEN '["read"]' ELSE '["k"]' END AS conditions, event_id AS seq
    FROM $events) a) b WHERE n = 1
"""

#: A strongly cyclic graph of users by successive events.
USERS = """
SELECT DISTINCT CAST(a AS STRING) AS source, CAST(b AS STRING) AS target FROM (SELECT user_id AS a, lead(user_id) OVER (ORDER BY ts, event_id) AS b FROM $events) x WHERE b IS NOT NULL AND a <> b
"""

def _spark(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    text = text.replace("{", "{{").replace("}", "}}")
    for name in frames:
        text = text.replace(f"${name}", f"{{{name}}}")
    return spark.sql(text, **frames)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def built(spark: SparkSession, sf_dir: str, keep: Callable[[DataFrame], DataFrame] = lambda functions: functions) -> Graph:
    """The graph as plans over the tables. keep() may store the functions, of which most of it is made."""
    t = tables(spark, sf_dir, "orders", "part", "supplier", "lineitem", "events")
    functions = keep(_spark(spark, FUNCTIONS, orders=t["orders"]))
    nodes = _spark(spark, NODES, functions=functions, part=t["part"], supplier=t["supplier"])
    edges = _spark(spark, EDGES, functions=functions, part=t["part"], lineitem=t["lineitem"])
    return Graph(nodes, edges, _spark(spark, TRANSITIONS, events=t["events"]))


_stored: dict[tuple[str, str], str] = {}


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph, which a session writes once, by type and relation, into its checkpoint folder; queries read what they need of it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        cut(spark.range(0))  # sets the folder where it is unset
        path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/graph-{len(_stored)}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:12]}"
        g = built(spark, sf_dir, cut)
        Graph(cut(g.nodes), cut(g.edges), cut(g.transitions)).save(path)
        _stored[key] = path
    return Graph.load(spark, _stored[key])


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark(spark, USERS, **tables(spark, sf_dir, "events"))


def sql(query: str, *uses: str) -> str:
    """A DuckDB query with the graph's tables as common table expressions."""
    texts = {"functions": FUNCTIONS, "nodes": NODES, "edges": EDGES, "state_transitions": TRANSITIONS, "users": USERS}
    plain = {k: v.replace("$", "") for k, v in texts.items()}
    needed = [k for k in texts if k in uses or k == "functions" and {"nodes", "edges"} & set(uses)]
    return "WITH RECURSIVE " + ",\n".join([f"{k} AS MATERIALIZED ({plain[k]})" for k in needed]) + query
