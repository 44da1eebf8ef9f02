"""The sections of an audit, each as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import payload as p
from graphloom.functions.names import SPECIAL, is_entry, parent_id, short_variable

#: Metadata keys that are tallied.
DETECTIONS = (
    "reentrancy_risk", "cross_reentrancy", "unchecked_calls", "no_input_validation", "proxy_risk", "unchecked_arithmetic",
    "upgrade_surface", "privileged_operations", "unguarded_privileged_operation", "timestamp_dependence", "unchecked_erc20",
    "oracle_risk", "signature_risk", "dos_risk", "precision_risk", "frontrun_risk", "unsafe_downcast", "flash_loan_risk",
    "slippage_risk", "dead_params", "erc_callback_risk", "anchor_risks", "cpi_reentrancy_risk", "unsafe_type_assertions",
    "sql_injection_risk", "unsafe_blocks", "panic_paths", "uses_tx_origin", "has_assembly", "potential_race", "no_error_check",
    "unchecked_errors", "transfer_sinks", "cross_contract_calls", "private_key_material", "command_injection_risk",
    "deserialization_sinks", "injection_sinks", "weak_crypto", "move_entry", "ton_accept_message", "ton_validation",
    "ignored_bounce", "streaming_rpc", "auth_boundary",
)
#: Which of them the two summaries show.
DEFI_SUMMARY = (
    "timestamp_dependence", "unchecked_erc20", "oracle_risk", "signature_risk", "precision_risk", "dos_risk", "frontrun_risk",
    "unsafe_downcast", "flash_loan_risk", "slippage_risk", "erc_callback_risk", "anchor_risks", "cpi_reentrancy_risk",
    "upgrade_surface", "unguarded_privileged_operation", "transfer_sinks", "cross_contract_calls", "ignored_bounce",
)
UNSAFE_SUMMARY = (
    "unsafe_blocks", "panic_paths", "potential_race", "unsafe_type_assertions", "sql_injection_risk", "no_error_check",
    "unchecked_errors", "command_injection_risk", "deserialization_sinks", "injection_sinks", "weak_crypto", "private_key_material",
)
#: Names of functions that anyone may call, and parts of the paths of tests.
USER_FACING = (
    "transfer", "approve", "transferFrom", "increaseAllowance", "decreaseAllowance", "deposit", "withdraw", "mint", "burn",
    "wrap", "unwrap", "stake", "unstake", "submit", "claim", "redeem", "swap", "permit", "safeTransfer", "safeTransferFrom",
    "setApprovalForAll",
)
TEST_PATHS = ("test/", "tests/", "test_", "forge-test/", "mock/", "mocks/", "fixture/", "script/", "scripts/")


def written(edges: DataFrame) -> DataFrame:
    """(id, state_writes, variables): writes of each function and the names of the first five variables in the order of insertion."""
    w = edges.where("relation = 'writes_state'").groupBy(F.col("source").alias("id"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("seq", "target"))), 1, 5)
    return w.agg(F.count("*").alias("state_writes"), F.transform(first, lambda x: short_variable(x["target"])).alias("variables"))


def guarded(edges: DataFrame) -> DataFrame:
    return edges.where("relation = 'guards'").select(F.col("target").alias("id")).distinct()


def _changing():
    return ~p.truthy("metadata", "view") & ~p.truthy("metadata", "pure")


def access_gaps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Entry points that write state with nothing to protect them: id, label, file, visibility, state_writes (names)."""
    rows = nodes.where((F.col("type") == "function") & is_entry() & _changing())
    rows = rows.where(~F.col("label").isin(*SPECIAL, *USER_FACING) & ~p.truthy("metadata", "modifiers") & ~p.truthy("metadata", "role_guards"))
    for part in TEST_PATHS:
        rows = rows.where(~F.contains("file", F.lit(part)))
    rows = rows.join(guarded(edges), "id", "left_anti").join(written(edges), "id")
    return rows.select("id", "label", "file", p.source_context("metadata").alias("source_context"), "visibility", F.col("variables").alias("state_writes"), "seq")


def silent_changes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Entry points that write state and emit no event: id, label, file, state_writes."""
    emitters = edges.where("relation = 'emits_event'").select(F.col("source").alias("id")).distinct()
    rows = nodes.where((F.col("type") == "function") & is_entry() & _changing() & (F.col("label") != "constructor"))
    rows = rows.join(written(edges), "id").join(emitters, "id", "left_anti")
    return rows.select("id", "label", "file", p.source_context("metadata").alias("source_context"), "state_writes", "seq")


def dead_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions that nothing calls: internal ones outside libraries (kind dead_internal), and entry points that write state (kind direct_entry_point)."""
    called = edges.where("relation = 'calls'").select(F.col("target").alias("id")).distinct()
    rows = nodes.where((F.col("type") == "function") & ~F.col("label").isin(*SPECIAL)).join(called, "id", "left_anti")
    libraries = nodes.where("type = 'library'").select(F.col("id").alias("parent"))
    inside = rows.where(F.col("visibility").isin("internal", "private")).withColumn("parent", parent_id("id")).join(libraries, "parent", "left_anti")
    direct = rows.where(is_entry() & _changing()).join(written(edges), "id", "left_semi")
    columns = ["id", "label", "file", "visibility", p.source_context("metadata").alias("source_context"), "seq"]
    return inside.select(F.lit("dead_internal").alias("kind"), *columns).unionByName(direct.select(F.lit("direct_entry_point").alias("kind"), *columns))


def reentrancy(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each function with a reentrancy of its own, and one for each other function it can be entered by."""
    labels = nodes.select(F.col("id").alias("source"), F.col("label").alias("guard"))
    marks = edges.where("relation = 'guards'").join(labels, "source").groupBy(F.col("target").alias("id")).agg(F.array_sort(F.collect_list("guard")).alias("modifiers"))
    functions = nodes.where("type = 'function'")
    context = p.source_context("metadata").alias("source_context")
    none = F.array().cast("array<string>")
    own = functions.where(p.truthy("metadata", "reentrancy_risk")).join(marks, "id", "left")
    own = own.select("id", "label", "file", "line_start", context, F.lit("single_function").alias("kind"), F.coalesce(p.value("metadata", "reentrancy_details"), F.lit("")).alias("details"), F.coalesce("modifiers", none).alias("modifiers"), F.lit(None).cast("string").alias("via"), none.alias("stale_vars"))
    items = F.from_json(p.value("metadata", "cross_reentrancy"), "array<struct<via:string,stale_vars:array<string>>>")
    cross = functions.withColumn("x", F.explode(items))
    cross = cross.select("id", "label", "file", "line_start", context, F.lit("cross_function").alias("kind"), F.lit("").alias("details"), none.alias("modifiers"), F.col("x.via").alias("via"), F.col("x.stale_vars").alias("stale_vars"))
    return own.unionByName(cross)
