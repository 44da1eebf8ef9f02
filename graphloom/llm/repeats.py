"""Removal of long byte strings that occurred before.

Every window of 100 bytes is owned by the place in it whose 20 bytes have the least hash, so equal windows have
owners with equal bytes at equal distance, and owners are a fortieth of all places. Owners whose 20 bytes occur but
once own no repeated window; a bitmap of fixed size drops nearly all of them. The rest are brought together by hash with
the bytes of their windows, and each window is compared there, so that the removed bytes are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import key_groups
from graphloom.llm.rolling import Bitmap, bitmap_of, prefix_sums, window_hashes

WIDTH = 100
GRAM = 20
#: Bits of the bitmap of repeated owners (8 MB). When it fills up, more owners are compared in vain; no result changes.
BITS = 1 << 26
#: Bytes hashed at once, and the most of one document in that; owners held until equal ones are sorted out.
CHUNK, SEGMENT, HELD = 1 << 20, 1 << 19, 100_000
_SEEN = "doc_id long, hash long, runs binary"


def _chunks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple]]]:
    """(bytes, document by byte, where each segment's place 0 is, segments' first bytes in their documents, documents) of whole windows."""
    docs, parts, size = [], [], 0

    def out():
        data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        lengths = np.array([len(p[2]) for p in parts])
        return data, np.array([p[0] for p in parts]), lengths, np.array([p[1] for p in parts]), docs

    for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        data = (text or "").encode()
        if len(data) < width:
            continue
        docs.append((doc_id, xxhash.xxh64_intdigest(data, 42)))
        for at in range(0, len(data) - width + 1, SEGMENT):
            parts.append((len(docs) - 1, at, data[at : at + SEGMENT + width - 1]))
            size += len(parts[-1][2])
            if size >= CHUNK:
                yield out()
                docs, parts, size = [docs[-1]], [], 0
    if parts:
        yield out()


def owners(data: np.ndarray, lengths: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner's hash, its place, its first and last window, sums) over segments laid end to end; windows lie within a segment."""
    sums = prefix_sums(data)
    n = len(data) - gram + 1
    at = np.arange(n)
    h = window_hashes(sums, at, at + gram)
    # the least of each run of grams, the last among equals, by doubling
    low = np.uint64((1 << 24) - 1)
    key = (h & ~low) | (low - at.astype(np.uint64))
    span, grams = 1, width - gram + 1
    while 2 * span <= grams:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    if span < grams:
        key = np.minimum(key[: len(key) - (grams - span)], key[grams - span :])
    owner = (low - (key & low)).astype(np.int64)
    ends = np.cumsum(lengths)
    valid = np.ones(len(owner), bool)
    for e in ends[:-1]:
        valid[max(0, e - width + 1) : e] = False
    places = np.flatnonzero(valid)
    owner = owner[places]
    new = np.ones(len(places), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (places[1:] != places[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(places)) - 1
    return h[owner[first]], owner[first], places[first], places[last], sums


def _count(width: int, gram: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int32))], ["h", "n"])

        for batch in batches:
            for data, _, lengths, _, _ in _chunks(batch, width):
                held.append(owners(data, lengths, width, gram)[0])
                if sum(map(len, held)) > 4 * HELD:
                    yield out()
        if held:
            yield out()

    return count


def _bytes_of(ranges: np.ndarray) -> bytes:
    return np.ascontiguousarray(ranges, "<i8").tobytes()


def _by_document(doc: np.ndarray, docs: list[tuple], start: np.ndarray, end: np.ndarray) -> pa.RecordBatch | None:
    """Runs of removed bytes by document, as rows of _SEEN."""
    if not len(doc):
        return None
    order = np.lexsort((start, doc))
    doc, ranges = doc[order], np.stack([start[order], end[order]], 1)
    cuts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    groups = [merge(r) for r in np.split(ranges, cuts[1:])]
    mine = [docs[d] for d in doc[cuts]]
    return pa.RecordBatch.from_arrays([pa.array([m[0] for m in mine], pa.int64()), pa.array(np.array([m[1] for m in mine], np.uint64).view(np.int64)), pa.array([_bytes_of(g) for g in groups], pa.binary())], ["doc_id", "hash", "runs"])


def merge(ranges: np.ndarray) -> np.ndarray:
    """Ranges (start, end), sorted by start, that touch or overlap made one."""
    if len(ranges) < 2:
        return ranges
    reach = np.maximum.accumulate(ranges[:, 1])
    first = np.flatnonzero(np.append(True, ranges[1:, 0] > reach[:-1]))
    return np.stack([ranges[first, 0], reach[np.append(first[1:], len(ranges)) - 1]], 1)


_LEAD = "h long, doc_id long, hash long, place long, before int, after int, bytes binary, runs binary"


def _lead(shared: Bitmap, width: int, gram: int):
    """Of equal owners (same windows) in one task only the first goes on; all windows of the others are known to be removed."""

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        docs: list[tuple] = []

        def out() -> Iterator[pa.RecordBatch]:
            h, region, doc, place, first, last = (np.concatenate(c) for c in list(zip(*held, strict=True))[:6])
            text = [b for part in held for b in part[6]]
            rank = {d: i for i, d in enumerate(sorted(set(docs), key=_order))}
            by = np.array([rank[d] for d in docs])[doc]
            order = np.lexsort((place, by, last - place, first - place, region, h))
            keys = [c[order] for c in (h, region, first - place, last - place)]
            new = np.ones(len(order), bool)
            new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
            go = order[new]
            leader = go[np.cumsum(new) - 1]
            # a repeated document is one document: it is not earlier than itself
            sure = order[~new & ((by[order] != by[leader]) | (place[order] != place[leader]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[go].view(np.int64)), pa.array([docs[d][0] for d in doc[go]], pa.int64()), pa.array(np.array([docs[d][1] for d in doc[go]], np.uint64).view(np.int64)), pa.array(place[go])]
                + [pa.array((place - first)[go].astype(np.int32)), pa.array((last - place)[go].astype(np.int32)), pa.array([text[i] for i in go], pa.binary()), pa.nulls(len(go), pa.binary())],
                ["h", "doc_id", "hash", "place", "before", "after", "bytes", "runs"],
            )
            if (known := _by_document(doc[sure], docs, first[sure], last[sure] + width)) is not None:
                n = known.num_rows
                yield pa.RecordBatch.from_arrays(
                    [known.column(1), known.column(0), known.column(1), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), known.column(2)],
                    ["h", "doc_id", "hash", "place", "before", "after", "bytes", "runs"],
                )
            held.clear()
            docs.clear()

        for batch in batches:
            for data, of, lengths, at, own in _chunks(batch, width):
                h, place, first, last, sums = owners(data, lengths, width, gram)
                keep = shared.has(h)
                if not keep.any():
                    continue
                h, place, first, last = (c[keep] for c in (h, place, first, last))
                ends = np.cumsum(lengths)
                segment = np.searchsorted(ends, first, side="right")
                shift = at[segment] - (ends - lengths)[segment]
                raw = data.tobytes()
                texts = [raw[s : e + width] for s, e in zip(first.tolist(), last.tolist(), strict=True)]
                region = window_hashes(sums, first, last + width)
                held.append((h, region, of[segment] + len(docs), place + shift, first + shift, last + shift, texts))
                docs += own
                if sum(len(p[0]) for p in held) >= HELD:
                    yield from out()
        if held:
            yield from out()

    return lead


def _order(doc: tuple) -> tuple:
    return (doc[0] is None, doc[0] or 0, doc[1])


def repeated(h: np.ndarray, rank: np.ndarray, before: np.ndarray, after: np.ndarray, texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, distance) of the windows that an earlier row has too: same h, same distance of window and owner, same bytes. Rows go by rank."""
    lengths = np.array([len(t) for t in texts])
    sums = prefix_sums(np.frombuffer(b"".join(texts), np.uint8))
    base = np.cumsum(lengths) - lengths + before  # where the window that starts at the owner stands
    rows, far = [], []
    for d in range(-int(after.max()), int(before.max()) + 1):
        at = np.flatnonzero((before >= d) & (-after <= d))
        if len(at) < 2:
            continue
        w = window_hashes(sums, base[at] - d, base[at] - d + width)
        order = np.lexsort((rank[at], w, h[at]))
        at, w = at[order], w[order]
        later = at[1:][(h[at][1:] == h[at][:-1]) & (w[1:] == w[:-1])]
        rows.append(later)
        far.append(np.full(len(later), d))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *far])


def _compare(width: int):
    def whole_groups(batches: Iterator[pa.RecordBatch], known: list[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Groups of equal h, many at a time; rows with runs go to known."""

        def leads() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = batch.column("runs").is_valid()
                known.append(batch.filter(done).select(["doc_id", "hash", "runs"]))
                yield batch.filter(pc.invert(done))

        held, n = [], 0
        for _, t in key_groups(leads(), ["h"]):
            if t.num_rows > 1:
                held.append(t)
                n += t.num_rows
                if n > HELD // 10:
                    yield pa.concat_tables(held)
                    held, n = [], 0
        if held:
            yield pa.concat_tables(held)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[pa.RecordBatch] = []
        for t in whole_groups(batches, known):
            while known:
                yield known.pop()
            h, place, before, after = (t.column(c).to_numpy() for c in ("h", "place", "before", "after"))
            docs = list(zip(t.column("doc_id").to_pylist(), t.column("hash").to_numpy().view(np.uint64).tolist(), strict=True))
            distinct = sorted(set(docs), key=_order)
            number = {d: i for i, d in enumerate(distinct)}
            doc = np.array([number[d] for d in docs])
            rank = np.empty(len(doc), np.int64)
            rank[np.lexsort((place, doc))] = np.arange(len(doc))
            # a repeated document is one document: the same place of the same text is not earlier
            same = np.stack([doc, place, before], 1)
            single = np.unique(same, axis=0, return_index=True)[1]
            texts = t.column("bytes").to_pylist()
            row, far = repeated(h[single], rank[single], before[single], after[single], [texts[i] for i in single], width)
            row = single[row]
            start = place[row] - far
            if (found := _by_document(doc[row], distinct, start, start + width)) is not None:
                yield found
        yield from known

    return compare


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, lists in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            data = (text or "").encode()
            runs = np.concatenate([np.frombuffer(b, "<i8") for b in lists or []] or [np.zeros(0, np.int64)]).reshape(-1, 2)
            runs = merge(runs[np.argsort(runs[:, 0], kind="stable")])
            kept, at = [], 0
            for s, e in runs.tolist():
                kept.append(data[at:s])
                at = e
            left = b"".join([*kept, data[at:]])
            out.append((doc_id, len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left))
        columns = list(zip(*out, strict=True)) or [()] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, bits: int = BITS) -> DataFrame:
    """One row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that are left).

    A byte goes if a string of `width` bytes that covers it starts earlier too: in a smaller doc_id, or earlier in
    the same document. A null text is empty; a null doc_id comes after all others; of unequal texts with one doc_id
    that with the smaller hash comes first; repeated rows count as one document and fare alike. Texts shorter than
    `width` stay. An empty table gives no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    seen = rows.mapInArrow(_count(width, gram), "h long, n int").groupBy("h").agg(F.sum("n").alias("n"))
    shared = bitmap_of(seen.where("n > 1"), "h", bits)
    leads = rows.mapInArrow(_lead(shared, width, gram), _LEAD)
    found = leads.repartition("h").sortWithinPartitions("h").mapInArrow(_compare(width), _SEEN)
    runs = found.groupBy("doc_id", "hash").agg(F.collect_list("runs").alias("runs")).withColumnRenamed("doc_id", "of")
    joined = rows.join(runs, F.col("doc_id").eqNullSafe(F.col("of")) & (F.xxhash64("text") == F.col("hash")), "left")
    return joined.select("doc_id", "text", "runs").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
