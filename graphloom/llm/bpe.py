"""BPE encoding and decoding with reuse of content-defined chunks.

Texts are cut where a rolling hash of the bytes before says so, hence alike in all documents that share a passage.
Chunks found twice or more in the corpus are encoded once and sent to their documents; chunks of one document only
are encoded in place, and a document without shared chunks moves nowhere. Where a cut may lie inside a pre-token, the
tokens around it are encoded again, from the last place before it to the first place after it where a pre-token
surely begins: there the tokens of the chunks and those of the whole text agree exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import checkpoint
from graphloom.llm.rolling import Bitmap, bitmap_of, prefix_sums, window_hashes
from graphloom.llm.tokens import ByteBpe, default_path, load

#: Bytes that a cut depends on; one place in so many is a cut; the least and the most bytes of a chunk.
WINDOW, EVERY, LEAST, MOST = 32, 512, 128, 8192
#: A cut moves to the next sure pre-token boundary if there is one within so many bytes.
SNAP = 256
#: Bits of the bitmap of shared chunks (8 MB). When it fills up, more chunks are sent in vain; no result changes.
BITS = 1 << 26
#: A single space between two other ASCII characters that are printed: a pre-token begins with it, whatever stands around.
SURE = re.compile(rb"(?<=[!-~]) (?=[!-~])")


def cuts_of(data: bytes) -> list[int]:
    """Where chunks begin, 0 first; each cut lies between two characters."""
    n = len(data)
    if n <= LEAST:
        return [0]
    raw = np.frombuffer(data, np.uint8)
    at = np.arange(LEAST, n)
    wanted = at[window_hashes(prefix_sums(raw), at - WINDOW, at) % np.uint64(EVERY) == 0]
    cuts = [0]
    for c in [*wanted.tolist(), n]:
        while c - cuts[-1] > MOST:
            cuts.append(_snap(data, cuts[-1] + MOST))
        if c - cuts[-1] >= LEAST:
            cuts.append(_snap(data, c))
    while len(cuts) > 1 and cuts[-1] >= n:
        cuts.pop()
    return cuts


def _snap(data: bytes, at: int) -> int:
    """The next sure boundary if it is near, else the next character."""
    if m := SURE.search(data, at, at + SNAP):
        return m.start()
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def repairs(data: bytes, cuts: list[int]) -> list[tuple[int, int]]:
    """The stretches to encode again: around each cut that is no sure boundary, to the nearest sure ones or the ends of the text."""
    out: list[tuple[int, int]] = []
    for c in cuts[1:]:
        low = out[-1][1] if out else 0
        if c < low or SURE.match(data, c):
            continue
        after, reach, before = SURE.search(data, c), 64, None
        while before is None:
            start = max(low, c - reach)
            found = [m.start() for m in SURE.finditer(data, start, c + 1) if m.start() < c]
            before = found[-1] if found else low if start == low else None
            reach *= 4
        out.append((before, after.start() if after else len(data)))
    return out


def stitch(data: bytes, cuts: list[int], tokens_of, encode) -> np.ndarray:
    """The tokens of data from those of its chunks, tokens_of(i), and of the stretches that are encoded again.

    A stretch covers the cut it was made for, so it takes a head, a tail or all of a chunk; both its ends are sure
    boundaries, so the rest of the chunk's own tokens is what the whole text has there.
    """
    fixes = repairs(data, cuts)
    parts = [(a, encode(data[a:b])) for a, b in fixes]
    k = 0
    for i, (s, e) in enumerate(zip(cuts, [*cuts[1:], len(data)], strict=True)):
        while k < len(fixes) and fixes[k][1] <= s:
            k += 1
        start, end = s, e
        for a, b in fixes[k : k + 2]:
            if a < s < b:
                start = min(b, e)
            elif s <= a < e:
                end = min(end, a)
        if start < end:
            ids = tokens_of(i)
            head = len(encode(data[s:start])) if start > s else 0
            tail = len(encode(data[end:e])) if end < e else 0
            parts.append((start, ids[head : len(ids) - tail]))
    parts.sort(key=lambda p: p[0])
    return np.concatenate([p[1] for p in parts]) if parts else np.zeros(0, "<u4")


def digest(chunk: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(chunk)
    return h & (1 << 64) - 1, h >> 64


def chunks_of(data: bytes) -> tuple[list[int], list[tuple[int, int]]]:
    cuts = cuts_of(data)
    return cuts, [digest(data[s:e]) for s, e in zip(cuts, [*cuts[1:], len(data)], strict=True)]


def _signed(values) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


#: Entries held in a task until they are handed on.
HELD = 100_000


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[int, int], int] = {}

    def out():
        keys = list(held)
        batch = pa.RecordBatch.from_arrays([_signed([k[0] for k in keys]), _signed([k[1] for k in keys]), pa.array(list(held.values()), pa.int32())], ["h1", "h2", "n"])
        held.clear()
        return batch

    for batch in batches:
        for text in batch.column(0).to_pylist():
            for h in set(chunks_of((text or "").encode())[1]):
                held[h] = min(2, held.get(h, 0) + 1)
        if len(held) > HELD:
            yield out()
    if held:
        yield out()


def _result(ids: np.ndarray, bpe: ByteBpe) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(np.ascontiguousarray(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()


_ROWS = "kind int, doc_id long, u1 long, u2 long, w1 array<long>, w2 array<long>, payload binary, n_tokens long, ids_sha256 string, decoded_sha256 string"
_ROW_TYPE = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("u1", pa.int64()), ("u2", pa.int64()), ("w1", pa.list_(pa.int64())), ("w2", pa.list_(pa.int64())), ("payload", pa.binary()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
#: Finished documents; documents that wait for chunks; chunks to encode.
_DONE, _WAITS, _CHUNK = 0, 1, 2


def _whole(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _split(shared: Bitmap, path: str):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, squeeze, sent = load(path), zstandard.ZstdCompressor(3), set()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                cuts, hashes = chunks_of(data)
                found = shared.has(np.array([h[0] for h in hashes], np.uint64))
                if not found.any():
                    rows.append((_DONE, doc_id, None, None, None, None, None, *_result(bpe.encode(text or ""), bpe)))
                    continue
                wanted = {h for h, f in zip(hashes, found.tolist(), strict=True) if f}
                u = digest(f"{doc_id}|".encode() + data)
                rows.append((_WAITS, doc_id, *map(_whole, u), [_whole(h[0]) for h in wanted], [_whole(h[1]) for h in wanted], squeeze.compress(data), None, None, None))
                for h, s, e in zip(hashes, cuts, [*cuts[1:], len(data)], strict=True):
                    if h in wanted and h not in sent:
                        sent.add(h)
                        rows.append((_CHUNK, None, *map(_whole, h), None, None, squeeze.compress(data[s:e]), None, None, None))
                if len(sent) > HELD:
                    sent.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ROW_TYPE, strict=True)], schema=_ROW_TYPE) if rows else pa.RecordBatch.from_pylist([], _ROW_TYPE)

    return split


def _encode(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, loose = load(path), zstandard.ZstdDecompressor()
        for batch in batches:
            ids = [bpe.encode(loose.decompress(z).decode()).astype(bpe.kind).tobytes() for z in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.binary())], ["h1", "h2", "ids"])

    return encode


def _finish(path: str):
    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, loose = load(path), zstandard.ZstdDecompressor()

        def encode(part: bytes) -> np.ndarray:
            return bpe.encode(part.decode())

        for batch in batches:
            rows = []
            for doc_id, z, got in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = loose.decompress(z)
                cuts, hashes = chunks_of(data)
                ends = [*cuts[1:], len(data)]
                known = {(g["h1"], g["h2"]): g["ids"] for g in got or []}
                signed = [(_whole(a), _whole(b)) for a, b in hashes]

                def tokens_of(i, signed=signed, known=known, data=data, cuts=cuts, ends=ends):
                    ids = known.get(signed[i])
                    return np.frombuffer(ids, bpe.kind).astype("<u4") if ids is not None else encode(data[cuts[i] : ends[i]])

                rows.append((doc_id, *_result(stitch(data, cuts, tokens_of, encode), bpe)))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return finish


_RESULT = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, bits: int = BITS) -> DataFrame:
    """One row for each document: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null or empty text has no tokens. Repeated rows, and rows with a null or repeated doc_id, are each encoded
    and returned. An empty table gives no rows.
    """
    path = path or default_path()
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    seen = rows.select("text").mapInArrow(_count, "h1 long, h2 long, n int").groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    shared = bitmap_of(seen.where("n > 1"), "h1", bits)
    split = checkpoint(rows.mapInArrow(_split(shared, path), _ROWS))
    chunks = split.where(F.col("kind") == _CHUNK).groupBy("u1", "u2").agg(F.first("payload").alias("payload"))
    encoded = chunks.mapInArrow(_encode(path), "h1 long, h2 long, ids binary")
    waiting = split.where(F.col("kind") == _WAITS)
    wanted = waiting.select("u1", "u2", F.explode(F.arrays_zip("w1", "w2")).alias("w")).select("u1", "u2", F.col("w.w1").alias("h1"), F.col("w.w2").alias("h2")).distinct()
    got = wanted.join(encoded, ["h1", "h2"]).groupBy("u1", "u2").agg(F.collect_list(F.struct("h1", "h2", "ids")).alias("got"))
    finished = waiting.select("doc_id", "u1", "u2", "payload").join(got, ["u1", "u2"], "left").select("doc_id", "payload", "got")
    finished = finished.mapInArrow(_finish(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return split.where(F.col("kind") == _DONE).select(*_RESULT).union(finished)
