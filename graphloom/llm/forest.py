"""Near-duplicate vectors by a forest of random-projection trees with spill overlap.

Each tree halves the unit sphere again and again by the projection on a random direction at the median; vectors
close to a cut go to both sides. Vectors are compared only within leaves, exactly, and links are united.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint, in_blocks, key_groups, local_roots
from graphloom.llm.components import connected_components

THRESHOLD = 0.9
TREES = 6
SPILL = 0.025
#: Vectors in a leaf, about; larger leaves are dealt into blocks of as many.
LEAF = 1000
#: The cuts of the trees are medians over so many vectors at most, the first by a hash of their ids. All vectors are indexed.
SAMPLE = 16384
SEED = 20


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows /= np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _direction(tree: int, node: int, dim: int) -> np.ndarray:
    r = np.random.default_rng([SEED, tree, node, dim]).standard_normal(dim)
    return r / np.linalg.norm(r)


def fit_cuts(sample: np.ndarray, trees: int, depth: int) -> list[dict[int, float]]:
    """For each tree the cut of each node (the root is 1, the children of n are 2n and 2n + 1). Below few sample vectors cuts are left out and count as 0."""
    out = []
    for tree in range(trees):
        cuts, level = {}, {1: np.arange(len(sample))}
        for _ in range(depth):
            below = {}
            for node, rows in level.items():
                if len(rows) < 16:
                    continue
                p = sample[rows] @ _direction(tree, node, sample.shape[1])
                cuts[node] = cut = float(np.median(p))
                below |= {2 * node: rows[p < cut], 2 * node + 1: rows[p >= cut]}
            level = below
        out.append(cuts)
    return out


def _leaves(v: np.ndarray, tree: int, depth: int, cuts: dict[int, float], spill: float) -> list[tuple[int, np.ndarray]]:
    level = {1: np.arange(len(v))}
    for _ in range(depth):
        below = {}
        for node, rows in level.items():
            p = v[rows] @ _direction(tree, node, v.shape[1]) - cuts.get(node, 0.0)
            for child, side in ((2 * node, p < spill), (2 * node + 1, p >= -spill)):
                if side.any():
                    below[child] = rows[side]
        level = below
    return list(level.items())


def _route(depth: int, fitted: dict[int, list[dict[int, float]]], trees: int, spill: float):
    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists, sizes = batch.column(0).to_numpy(), batch.column(1), batch.column(2).to_numpy()
            values, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy())
            dims = lists.value_lengths().to_numpy()
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                raw = np.stack([values[ends[i] - dim : ends[i]] for i in at])
                v = unit(raw)
                cuts = fitted.get(int(dim), [{}] * trees)
                found = [(t, leaf, rows) for t in range(trees) for leaf, rows in _leaves(v, t, depth, cuts[t], spill)]
                mine: list[list[int]] = [[] for _ in at]
                for t, leaf, rows in found:
                    for r in rows.tolist():
                        mine[r].append((t << 40) + leaf)
                for t, leaf, rows in found:
                    yield pa.RecordBatch.from_pydict(
                        {
                            "dim": pa.array(np.full(len(rows), dim), pa.int32()), "leaf": pa.array(np.full(len(rows), (t << 40) + leaf), pa.int64()), "cid": pa.array(ids[at[rows]], pa.int64()),
                            "size": pa.array(sizes[at[rows]], pa.int64()), "vector": pa.array([raw[r].tobytes() for r in rows], pa.binary()), "leaves": pa.array([mine[r] for r in rows], pa.list_(pa.int64())),
                        }
                    )

    return route


def _incidence(leaves: list[list[int]], below: int) -> np.ndarray:
    """[vector, leaf] over the leaves that come before `below`."""
    known: dict[int, int] = {}
    pairs = [(i, known.setdefault(x, len(known))) for i, own in enumerate(leaves) for x in own if x < below]
    out = np.zeros((len(leaves), max(1, len(known))), np.float32)
    if pairs:
        out[tuple(np.array(pairs).T)] = 1
    return out


def _compare(threshold: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (dim, leaf, lo, hi), t in key_groups(batches, ["dim", "leaf", "lo", "hi"]):
            n = t.num_rows
            if n < 2:
                continue
            ids, sizes, block = t.column("cid").to_numpy(), t.column("size").to_numpy(), t.column("block").to_numpy()
            data = b"".join(t.column("vector").to_pylist())
            v = unit(np.frombuffer(data, f"<f{len(data) // (n * dim)}").reshape(n, dim))
            order = np.argsort(ids, kind="stable")
            ids, sizes, block, v = ids[order], sizes[order], block[order], v[order]
            linked = v @ v.T >= threshold
            np.fill_diagonal(linked, False)
            if lo != hi:
                linked &= block[:, None] != block[None, :]
            if not linked.any():
                continue
            root = local_roots(linked)
            held = _incidence([t.column("leaves")[int(i)].as_py() for i in order], leaf)
            linked &= held @ held.T == 0  # a pair counts in the first leaf that holds it
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(linked @ sizes), pa.array(ids[root])], ["cid", "links", "root"])

    return compare


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD, trees: int = TREES, spill: float = SPILL, leaf: int = LEAF, sample: int = SAMPLE) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept (it is the first of its component).

    Vectors that are null, empty, zero or have null or non-finite components link with nothing, nor do vectors of
    different lengths, nor rows with a null vec_id (component null, not kept). Equal vectors are compared once and
    link with each other; their number counts in n_links. An empty table gives no rows.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    finite = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fits = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("embedding", F.when(fits, F.col("embedding")))
    classes = rows.where("embedding is not null").groupBy("embedding").agg(F.min("vec_id").alias("cid"), F.count("*").alias("size"))
    classes = checkpoint(classes.select("cid", "embedding", "size"))
    n = classes.count()
    depth = max(0, math.ceil(math.log2(max(1, n) / leaf)))
    drawn = classes.select("cid", "embedding").orderBy(F.xxhash64("cid"), "cid").limit(sample).collect()
    by_dim: dict[int, list] = {}
    for r in drawn:
        by_dim.setdefault(len(r[1]), []).append(r[1])
    fitted = {dim: fit_cuts(unit(np.array(own)), trees, depth) for dim, own in by_dim.items()}
    routed = classes.mapInArrow(_route(depth, fitted, trees, spill), "dim int, leaf long, cid long, size long, vector binary, leaves array<long>")
    keys = ["dim", "leaf"]
    blocks = in_blocks(checkpoint(routed), keys, "cid", 2 * leaf)
    keys += ["lo", "hi"]
    found = blocks.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compare(threshold), "cid long, links long, root long")
    found = checkpoint(found)
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    roots = connected_components(found, "cid", "root")
    known = classes.join(counts, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left")
    known = known.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "cid").alias("component_id"))
    out = rows.join(known, "embedding", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
