"""Reachability between all nodes of a graph, by bits: a word holds 64 starts, and one step takes all of them over an edge.

The edges go to every task, as numbers; starts are dealt out in blocks. Work follows edges and rounds, not pairs, so dense
graphs, where a join would make a row for each pair and edge on, cost little more than their result. Nothing is stored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that one step gathers at most, if a block is more than one word wide, and rows of a batch of results, roughly.
STEP, BATCH = 1 << 22, 1 << 18
#: Words of a block at most, and pairs of it that are enough for a task: in narrow blocks starts take fewer bits in a file.
WIDTH, ENOUGH = 16, 1 << 21
#: Edges that the driver takes with the names of their ends; of more it takes the numbers only.
AT_ONCE = 2_000_000
#: Roots, and rounds from them, by which starts are put in order.
ROOTS, ROUNDS = 64, 4096


class Steps(NamedTuple):
    """Edges in both orders: target[ptr[i] : ptr[i + 1]] are the ends of those of node i; come has the sources by targets, where those of ends[j] begin at at[j]."""

    ptr: np.ndarray
    target: np.ndarray
    come: np.ndarray
    ends: np.ndarray
    at: np.ndarray


def _steps(source: np.ndarray, target: np.ndarray, n: int) -> Steps:
    out = np.sort(source.astype(np.int64) * n + target)
    ptr = np.searchsorted(out, np.arange(n + 1) * n)
    back = np.sort(target.astype(np.int64) * n + source)
    ends = back // n
    at = np.flatnonzero(np.diff(ends, prepend=-1))
    return Steps(ptr, (out % n).astype(np.int32), (back % n).astype(np.int32), ends[at], at)


def _joined(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rows from each of at to the next as one, by or."""
    if bits.shape[1] == 1:  # by far faster in one dimension
        return np.bitwise_or.reduceat(bits[:, 0], at)[:, None]
    return np.bitwise_or.reduceat(bits, at, axis=0)


def _walk(first: int, n_starts: int, width: int, steps: Steps) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(distance, nodes, bits): the nodes that starts first, first + 1 and so on reach in so many edges and no fewer."""
    ptr, target, come, ends, at = steps
    n = len(ptr) - 1
    k = np.arange(min(64 * width, n_starts - first))
    nodes, bits = first + k, np.zeros((len(k), width), np.uint64)
    bits[k, k // 64] = np.left_shift(np.uint64(1), (k % 64).astype(np.uint64))
    seen, distance = np.zeros((n, width), np.uint64), 0
    while len(nodes):
        distance += 1
        out = ptr[nodes + 1] - ptr[nodes]
        total = int(out.sum())
        if 4 * total > len(target):  # most edges are taken: all are, in the order they are kept in
            front = np.zeros((n, width), np.uint64)
            front[nodes] = bits
            to, got = ends, _joined(front.take(come, axis=0), at)
        else:
            row = np.repeat(np.arange(len(nodes)), out)
            to = target[np.arange(total) - np.repeat(np.cumsum(out) - out, out) + ptr[nodes][row]]
            order = np.argsort(to, kind="stable")
            to, row = to[order], row[order]
            starts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if total else np.empty(0, int)
            to, got = to[starts], _joined(bits[row], starts) if total else bits[:0]
        got &= ~seen[to]
        new = got.any(axis=1)
        nodes, bits = to[new], got[new]
        seen[nodes] |= bits
        if len(nodes):
            yield distance, nodes, bits


def _near(source: np.ndarray, target: np.ndarray, n: int, n_starts: int) -> np.ndarray:
    """The starts by their distance to a root: those of a block then reach a node at about the same distance, which makes for few nodes a round and long runs in files."""
    back, level, depth = _steps(target, source, n), np.full(n_starts, -1), 0
    for _ in range(ROOTS):
        left = np.flatnonzero(level < 0)
        if not len(left) or depth > ROUNDS:
            break
        root = int(left[0])
        level[root] = depth
        for distance, nodes, _bits in _walk(root, root + 1, 1, back):
            nodes = nodes[nodes < n_starts]
            level[nodes[level[nodes] < 0]] = depth + distance
            if depth + distance > ROUNDS:
                break
        depth = int(level.max()) + 1
    level[level < 0] = depth
    return np.argsort(level, kind="stable")


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks or [pa.array([], pa.string())]).cast(pa.string())


def _numbered(edges: DataFrame) -> tuple[pa.Array, int, np.ndarray, np.ndarray]:
    """Names of nodes, of which so many are sources and come first; sources and targets of the edges by their numbers."""
    both = edges.select("source", "target")
    if both.count() <= AT_ONCE:
        held = both.toArrow()
        ends = [_whole(held.column(c)) for c in ("source", "target")]
        sources = ends[0].unique()
        names = pa.concat_arrays([sources, ends[1]]).unique()
        return names, len(sources), *(pc.index_in(x, value_set=names).to_numpy(zero_copy_only=False).astype(np.int32) for x in ends)
    found = both.select(F.col("source").alias("id"), F.lit(1).alias("out")).unionByName(both.select(F.col("target").alias("id"), F.lit(0).alias("out")))
    found = found.groupBy("id").agg(F.max("out").alias("out")).toArrow()
    out = found.column("out").to_numpy()
    names = _whole(found.column("id")).take(pa.array(np.argsort(-out, kind="stable")))
    shared = edges.sparkSession.sparkContext.broadcast(names)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if batches := list(batches):
            rows = pa.Table.from_batches(batches)
            yield pa.RecordBatch.from_arrays([pc.index_in(_whole(rows.column(c)), value_set=shared.value) for c in ("source", "target")], ["source", "target"])

    held = both.mapInArrow(numbered, "source int, target int").toArrow()
    shared.destroy()
    return names, int(out.sum()), *(held.column(c).to_numpy().astype(np.int32) for c in ("source", "target"))


def all_reached(edges: DataFrame) -> DataFrame:
    """(start, node, distance) of all that each source reaches over one edge or more, by the least number of them; a start itself by its shortest cycle. edges: (source, target) without nulls, held by the driver and every task."""
    spark = edges.sparkSession
    names, n_starts, source, target = _numbered(edges)
    n = len(names)
    order = np.r_[_near(source, target, n, n_starts), np.arange(n_starts, n)]
    number = np.empty(n, np.int64)
    number[order] = np.arange(n)
    shared = spark.sparkContext.broadcast((names.take(pa.array(order)), _steps(number[source], number[target], n)))
    width = int(max(1, min(WIDTH, STEP // max(1, len(source)), ENOUGH // (64 * max(1, n)))))
    blocks = -(-n_starts // (64 * width))

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, steps = shared.value
        for batch in batches:
            for block in batch.column(0).to_pylist():
                first = 64 * width * block
                for distance, nodes, bits in _walk(first, n_starts, width, steps):
                    row, column = np.nonzero(bits)
                    words = bits[row, column]
                    for s in range(0, len(words), BATCH // 64):
                        bit = np.flatnonzero(np.unpackbits(words[s : s + BATCH // 64].view(np.uint8), bitorder="little").view(bool))
                        word = s + (bit >> 6)
                        start, node = pa.array(first + 64 * column[word] + (bit & 63)), pa.array(nodes[row[word]])
                        yield pa.RecordBatch.from_arrays([names.take(start), names.take(node), pa.array(np.full(len(bit), distance, np.int32))], ["start", "node", "distance"])

    return spark.range(0, blocks, 1, max(1, min(blocks, 4096))).mapInArrow(walked, "start string, node string, distance int")
