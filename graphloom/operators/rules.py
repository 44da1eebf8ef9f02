"""Risk scoring: rules as rows of a table, folded into one score and one list of reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import payload as p
from graphloom.functions.names import SPECIAL, is_c_file, is_entry
from graphloom.functions.payload import attr_enabled

#: Fixed values: (key, weight, name of the reason, how its argument is made) for C and C++ files.
C_RULES = (
    ("command_injection_risk", 5, "cmd_injection", "count"),
    ("buffer_overflow_risk", 4, "buffer_overflow", "count"),
    ("format_string_risk", 4, "format_string", "count"),
    ("use_after_free_risk", 4, "use_after_free", "count"),
    ("double_free_risk", 3, "double_free", "count"),
    ("integer_overflow_risk", 3, "int_overflow", "count"),
    ("toctou_risk", 3, "toctou", "count"),
    ("path_traversal_risk", 3, "path_traversal", "count"),
    ("null_deref_risk", 2, "null_deref", "count"),
    ("uninitialized_use", 2, "uninit_use", "count"),
)
#: The same for all other files, in the order of the reasons. dos_risk and anchor_risks score by the types of their items.
RULES = (
    ("no_input_validation", 2, "no_validation", ""),
    ("reentrancy_risk", 5, "reentrancy", ""),
    ("cross_reentrancy", 4, "cross_reentrancy", ""),
    ("unchecked_erc20", 3, "unchecked_erc20", "count"),
    ("oracle_risk", 2, "oracle", "count"),
    ("timestamp_dependence", 1, "timestamp", ""),
    ("signature_risk", 3, "sig_risk", "value"),
    ("precision_risk", 2, "precision", ""),
    ("unchecked_calls", 3, "unchecked_calls", "count"),
    ("proxy_risk", 2, "proxy", "value"),
    ("upgrade_surface", 3, "upgrade_surface", ""),
    ("privileged_operations", 2, "privileged", "count"),
    ("unguarded_privileged_operation", 4, "unguarded_privileged", ""),
    ("unchecked_arithmetic", 2, "unchecked_arith", ""),
    ("has_assembly", 1, "assembly", ""),
    ("dos_risk:unbounded_loop", 3, "unbounded_loop", "typed"),
    ("dos_risk:external_call_in_loop", 2, "ext_call_in_loop", "typed"),
    ("frontrun_risk", 2, "frontrun", "count"),
    ("unsafe_type_assertions", 2, "unsafe_assert", "count"),
    ("sql_injection_risk", 4, "sqli", "count"),
    ("command_injection_risk", 5, "cmd_injection", "count"),
    ("deserialization_sinks", 4, "deser", "count"),
    ("injection_sinks", 4, "injection", "count"),
    ("weak_crypto", 2, "weak_crypto", "count"),
    ("private_key_material", 4, "private_key_material", ""),
    ("transfer_sinks", 3, "transfer_sink", "count"),
    ("cross_contract_calls", 2, "cross_contract", "count"),
    ("ignored_bounce", 3, "ignored_bounce", ""),
    ("auth_boundary", 2, "auth_boundary", ""),
    ("unsafe_downcast", 2, "unsafe_downcast", "count"),
    ("flash_loan_risk", 4, "flash_loan", "list"),
    ("slippage_risk", 3, "slippage", "list"),
    ("dead_params", 1, "dead_params", "list"),
    ("erc_callback_risk", 4, "erc_callback", "list"),
    ("anchor_risks:missing_signer", 4, "missing_signer", "any"),
    ("anchor_risks:weak_pda_seeds", 3, "weak_pda", "any"),
    ("anchor_risks:unchecked_no_owner", 3, "unchecked_account", "any"),
    ("cpi_reentrancy_risk", 4, "cpi_reentrancy", ""),
)


def _of_type(m: Column, key: str, kind: str) -> Column:
    items = F.from_json(m[key]["text"], "array<struct<type:string>>")
    return F.coalesce(F.size(F.filter(items, lambda x: x["type"] == kind)), F.lit(0))


def _rule(m: Column, key: str, name: str, argument: str) -> tuple[Column, Column]:
    """(whether it holds, its reason)."""
    key, _, kind = key.partition(":")
    if argument in ("typed", "any"):
        n = _of_type(m, key, kind)
        return p.map_truthy(m, key) & (n > 0), F.concat(F.lit(f"{name}("), n.cast("string"), F.lit(")")) if argument == "typed" else F.lit(name)
    text = m[key]["text"]
    made = {"count": p.map_length(m, key).cast("string"), "value": text, "list": F.array_join(F.from_json(text, "array<string>"), ",")}.get(argument)
    return p.map_truthy(m, key), F.lit(name) if made is None else F.concat(F.lit(f"{name}("), made, F.lit(")"))


def scored(functions: DataFrame, meta: str = "metadata") -> DataFrame:
    """functions with score and reasons. They need visibility, file, metadata and the counts writes, ext_calls and guards."""
    entry_writes = is_entry() & (F.col("writes") > 0)
    c_file = is_c_file("file")

    def judge(m: Column) -> Column:
        rows = [
            (entry_writes, 3, F.concat(F.lit("entry+writes("), F.col("writes").cast("string"), F.lit(")"))),
            (F.col("ext_calls") > 0, 3, F.concat(F.lit("ext_calls("), F.col("ext_calls").cast("string"), F.lit(")"))),
        ]
        for table, here in ((C_RULES, c_file), (RULES, ~c_file)):
            for key, weight, name, argument in table:
                holds, reason = _rule(m, key, name, argument)
                rows.append((here & holds, weight, reason))
        guarded = (F.col("guards") > 0) | p.map_truthy(m, "modifiers") | p.map_truthy(m, "role_guards") | p.map_truthy(m, "access_controls")
        mutable = ~p.map_truthy(m, "view") & ~p.map_truthy(m, "pure")
        rows.append((entry_writes & ~guarded & (c_file | mutable), 2, F.lit("no_access_control")))
        found = F.array(*(F.when(holds, F.struct(F.lit(weight).alias("weight"), reason.alias("reason"))) for holds, weight, reason in rows))
        return F.array_compact(found)

    out = functions.withColumn("__found", p.with_parsed(meta, judge))
    score = F.aggregate("__found", F.lit(0), lambda a, x: a + x["weight"])
    return out.withColumns({"score": score, "reasons": F.transform("__found", lambda x: x["reason"])}).drop("__found")


def with_counts(nodes: DataFrame, edges: DataFrame, cpi: bool = False) -> DataFrame:
    """Function nodes with writes, ext_calls and guards counted from the edges.

    ext_calls are calls that stay unresolved and are no internal candidates; with cpi also calls marked so.
    """
    outside = p.unresolved("attributes") | attr_enabled("attributes", "cpi") if cpi else p.unresolved("attributes")
    used = edges.where(F.col("relation").isin("writes_state", "calls"))
    out = used.groupBy(F.col("source").alias("id")).agg(F.count_if(F.col("relation") == "writes_state").alias("writes"), F.count_if((F.col("relation") == "calls") & outside).alias("ext_calls"))
    guards = edges.where("relation = 'guards'").groupBy(F.col("target").alias("id")).agg(F.count("*").alias("guards"))
    both = nodes.where("type = 'function'").join(out, "id", "left").join(guards, "id", "left")
    return both.fillna(0, ["writes", "ext_calls", "guards"])


def hotspots(nodes: DataFrame, edges: DataFrame, floor: int = 3, cpi: bool = False) -> DataFrame:
    """Functions with a name of their own that score `floor` or more: id, label, file, line_start, score, reasons, bucket, source_context."""
    rows = scored(with_counts(nodes, edges, cpi).where(~F.col("label").isin(*SPECIAL))).where(F.col("score") >= floor)
    bucket = F.when(F.col("score") >= 8, "critical").when(F.col("score") >= 5, "high").otherwise("medium")
    return rows.select("id", "label", "file", "line_start", "score", "reasons", bucket.alias("bucket"), p.source_context("metadata").alias("source_context"), "seq")
