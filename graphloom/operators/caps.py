"""Bounded results that tell what they leave out."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a capped payload keeps.
METADATA_KEPT = ("source_context", "source_kind", "language", "contract", "modifiers", "role_guards")
ATTRIBUTES_KEPT = ("call_name", "cross_boundary", "hint", "internal_candidate", "language", "order", "sink", "unresolved")


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows; none for 0."""
    return df.orderBy(*order).limit(n)


def capped(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows; all for 0."""
    return df.orderBy(*order).limit(n) if n else df.orderBy(*order)


def cap_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key (all for 0) with the number of all of them in `total`."""
    w = Window.partitionBy(*keys)
    out = df.withColumn("total", F.count("*").over(w))
    if not n:
        return out
    return out.withColumn("_n", F.row_number().over(w.orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def section(total: int, shown: int) -> dict:
    return {"total": total, "shown": shown, "truncated": shown < total}


def count_map(df: DataFrame, key: str, n: int = 0) -> tuple[dict, dict]:
    """Counts by key, the most frequent first and by key among equals, n of them at most (0: all), and what that leaves out."""
    counts = df.groupBy(key).count().orderBy(F.desc("count"), key).collect()
    shown = counts[:n] if n else counts
    return {r[0]: r[1] for r in shown}, section(len(counts), len(shown))


def cap_json(text: str | None, most: int, kept: tuple[str, ...] = METADATA_KEPT) -> tuple[dict, dict]:
    """A payload as a dict, cut down to the kept keys if it has more than `most` characters (0: never)."""
    try:
        whole = json.loads(text or "{}")
    except ValueError:
        whole = {}
    if not isinstance(whole, dict):
        whole = {}
    size = len(json.dumps(whole))
    if not most or size <= most:
        return whole, {"truncated": False, "original_bytes": size}
    out = {k: whole[k] for k in kept if k in whole} | {"_truncated": True, "_original_bytes": size, "_keys": sorted(whole)[:50]}
    return out, {"truncated": True, "original_bytes": size}


def cap_list(values: list, n: int) -> tuple[list, int]:
    """The first n values (all for 0) and the number left out."""
    return (values[:n], len(values) - n) if n and len(values) > n else (values, 0)
