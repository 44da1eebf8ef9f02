"""Packing into fixed-length sequences: first-fit decreasing over a tournament tree of bin capacities.

Every document is cut at multiples of the length; pieces are dealt at random (by a hash of document and place) to
groups of a bounded expected size, and each group is packed by itself, so that groups run in parallel. Pieces are a few
numbers, so they are stored once: their number tells the groups, and texts are tokenized once.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint, key_groups
from graphloom.llm.tokens import default_path, load

LENGTH = 1024
#: Pieces in a group, about. The padding of a group is less than a sequence or two.
GROUP = 4096
SEPARATOR = 0


class Capacities:
    """A tournament tree: each inner node has the larger capacity below it, so the first bin that fits is found in log time."""

    def __init__(self, n: int, capacity: int):
        self.size = 1 << max(0, n - 1).bit_length()
        self.best = [0] * (2 * self.size)
        for i in range(self.size, self.size + n):
            self.best[i] = capacity
        for i in range(self.size - 1, 0, -1):
            self.best[i] = max(self.best[2 * i], self.best[2 * i + 1])

    def first_fit(self, need: int) -> tuple[int, int]:
        """Takes `need` from the first bin that has it; (the bin, its capacity before)."""
        best, i = self.best, 1
        while i < self.size:
            i *= 2
            if best[i] < need:
                i += 1
        before = best[i]
        best[i] -= need
        leaf = i
        while i := i // 2:
            best[i] = max(best[2 * i], best[2 * i + 1])
        return leaf - self.size, before


def first_fit_decreasing(lengths: list[int], capacity: int = LENGTH) -> list[tuple[int, int]]:
    """(bin, offset) of each length, which lie in 1..capacity; ties go by place in the list."""
    tree = Capacities(len(lengths), capacity)
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        b, before = tree.first_fit(lengths[i])
        out[i] = (b, capacity - before)
    return out


def _pieces(path: str, length: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(bpe.encode(text or ""), SEPARATOR).astype("<u4")
                whole = zlib.crc32(ids.tobytes())
                rows += [(doc_id, s, len(p), zlib.crc32(p.tobytes()), len(ids), whole) for s in range(0, len(ids), length) for p in [ids[s : s + length]]]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "whole"])

    return cut


def _packed(length: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (group,), t in key_groups(batches, ["group"]):
            placed = first_fit_decreasing(t.column("length").to_pylist(), length)
            t = t.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            t = t.append_column("sequence_id", pa.array([(group << 32) + b for b, _ in placed], pa.int64()))
            yield from t.append_column("offset", pa.array([o for _, o in placed], pa.int64())).combine_chunks().to_batches()

    return pack


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the separator alone. Repeated rows are packed as often as they occur; a null doc_id
    stays null; an empty table gives no rows. doc_id is read as a long integer.
    """
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = named.mapInArrow(_pieces(path or default_path(), length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, whole long")
    pieces = checkpoint(pieces)
    groups = max(1, -(-pieces.count() // group))
    order = ["group", "length", "doc_id", "start", "whole"]
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "whole", "start"), F.lit(groups)))
    dealt = dealt.repartition("group").sortWithinPartitions(*order)
    return dealt.mapInArrow(_packed(length), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
