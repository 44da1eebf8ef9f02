"""Scanners by category: functions that have a finding under a metadata key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import payload as p
from graphloom.operators.caps import cap_per_key

#: Category, metadata key, result name and (output field, metadata key) of the details.
DEFI = (
    ("timestamp", "timestamp_dependence", "timestamp_dependence", "risks"),
    ("erc20", "unchecked_erc20", "unchecked_erc20", "unchecked_calls"),
    ("oracle", "oracle_risk", "oracle_manipulation", "risks"),
    ("signature", "signature_risk", "signature_replay", "risks"),
    ("precision", "precision_risk", "precision_loss", "risks"),
    ("dos", "dos_risk", "dos_risks", "risks"),
    ("frontrun", "frontrun_risk", "frontrunning", "risks"),
    ("downcast", "unsafe_downcast", "unsafe_downcasts", "casts"),
    ("flashloan", "flash_loan_risk", "flash_loan_risks", "risks"),
    ("slippage", "slippage_risk", "slippage_missing", "risks"),
    ("callback", "erc_callback_risk", "erc_callback_reentrancy", "risks"),
    ("anchor", "anchor_risks", "anchor_risks", "risks"),
    ("cpi_reentrancy", "cpi_reentrancy_risk", "cpi_reentrancy", ""),
    ("transfer", "transfer_sinks", "transfer_sinks", "sinks"),
    ("crosscontract", "cross_contract_calls", "cross_contract_calls", "calls"),
)
#: The categories that select it, metadata key, result name, output field of the details.
UNSAFE = (
    (("unsafe",), "unsafe_blocks", "unsafe_blocks", "unsafe_blocks"),
    (("panic",), "panic_paths", "panic_sinks", "panic_calls"),
    (("race",), "potential_race", "race_conditions", "race"),
    (("validation",), "no_input_validation", "missing_validation", ""),
    (("unsafe",), "wrapping_arithmetic", "wrapping_arithmetic", "operations"),
    (("go", "type_assert"), "unsafe_type_assertions", "unsafe_type_assertions", "assertions"),
    (("go", "sql"), "sql_injection_risk", "sql_injection", "risks"),
    (("java", "python", "js", "deser"), "deserialization_sinks", "deserialization", "sinks"),
    (("java", "reflection"), "reflection_usage", "reflection", "operations"),
    (("java", "injection"), "injection_sinks", "injection", "sinks"),
    (("java", "python", "js", "crypto"), "weak_crypto", "weak_crypto", "patterns"),
    (("python", "command"), "command_injection_risk", "command_execution", "risks"),
    (("python", "js", "keys"), "private_key_material", "private_key_material", ""),
    (("java",), "swallowed_exceptions", "swallowed_exceptions", "empty_catches"),
    (("java",), "resource_leaks", "resource_leaks", "types"),
    (("downcast",), "unsafe_downcast", "unsafe_downcasts", "casts"),
    (("dead_params",), "dead_params", "dead_params", "unused_params"),
)


def defi_keys(category: str = "all") -> dict[str, tuple[str, str]]:
    """{metadata key: (result name, output field)} of a category."""
    return {key: (name, field) for cat, key, name, field in DEFI if category in ("", "all", cat)}


def unsafe_keys(category: str = "all") -> dict[str, tuple[str, str]]:
    return {key: (name, field) for cats, key, name, field in UNSAFE if category in ("", "all") or category in cats}


def findings(nodes: DataFrame, keys: dict[str, tuple[str, str]]) -> DataFrame:
    """One row for each function and key with a true value: key, category, id, label, file, line_start, visibility, details (JSON), language, source_context."""
    functions = nodes.where("type = 'function'")
    rows = functions.withColumn("f", F.explode(_found(keys)))
    category = F.element_at(F.create_map(*(F.lit(x) for k, (name, _) in keys.items() for x in (k, name))), F.col("f.key")) if keys else F.lit("")
    return rows.select("f.key", category.alias("category"), "id", "label", "file", "line_start", "visibility", F.call_function("get_json_object", "metadata", F.concat(F.lit("$."), F.col("f.key"))).alias("details"), F.coalesce(p.value("metadata", "language"), F.lit("")).alias("language"), p.source_context("metadata").alias("source_context"), "metadata")


def _found(keys) -> Column:
    """The keys with a true value."""
    empty = F.array().cast("array<struct<key:string>>")
    if not keys:
        return empty
    return p.with_parsed("metadata", lambda m: F.coalesce(F.array_compact(F.array(*(F.when(p.map_truthy(m, k), F.struct(F.lit(k).alias("key"))) for k in keys))), empty))


def scan(nodes: DataFrame, keys: dict[str, tuple[str, str]], max_per_category: int = 25) -> DataFrame:
    """The first findings of each category by file, line and id, with the number of all of them in `total`."""
    return cap_per_key(findings(nodes, keys), ["category"], [F.col("file"), F.col("line_start"), F.col("id")], max_per_category)


def foreign_calls(nodes: DataFrame) -> DataFrame:
    """Sinks of foreign functions: operation, file, source_context."""
    rows = nodes.where(p.value("metadata", "sink_type") == "unsafe_ffi")
    return rows.select(F.col("label").alias("operation"), "file", p.source_context("metadata").alias("source_context"), "id").orderBy("file", "operation")


def tallies(nodes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(key, functions): how many functions have a true value under each key."""
    return nodes.where("type = 'function'").select(F.explode(_found(keys)).alias("f")).groupBy("f.key").agg(F.count("*").alias("functions"))
