"""Rolling hashes over bytes, and a bitmap of hashes with a fixed size."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(64).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_tables: dict[int, np.ndarray] = {}


def _powers(n: int, of: int) -> np.ndarray:
    """The first n powers; one table of each base is kept, as long as the longest asked for."""
    if len(_tables.get(of, ())) < n:
        out = np.full(1 << max(12, (n - 1).bit_length()), of, np.uint64)
        out[0] = 1
        _tables[of] = np.cumprod(out, dtype=np.uint64)
    return _tables[of][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of the hashed bytes times growing powers, modulo 2 ** 64; one more than there are bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _powers(len(data), _BASE), out=out[1:])
    return out


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def window_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes in each [start, end), the same wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _powers(len(sums), _INVERSE)[starts])


class Bitmap:
    """A Bloom filter with one hash and a fixed number of bits: hashes that were put in are always found; of others, the share of set bits."""

    def __init__(self, bits: int):
        self.bits, self.words = bits, np.zeros(bits >> 6, np.uint64)

    def __reduce__(self):
        return _unpacked, (self.bits, zlib.compress(self.words.tobytes(), 1))

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h & np.uint64(self.bits - 1)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def _unpacked(bits: int, data: bytes) -> Bitmap:
    out = Bitmap.__new__(Bitmap)
    out.bits, out.words = bits, np.frombuffer(zlib.decompress(data), np.uint64)
    return out


def bitmap_of(rows: DataFrame, column: str, bits: int) -> Bitmap:
    """Of the hashes in a long column. The driver gets bits / 64 words at most, however many rows there are."""
    at = F.col(column).bitwiseAND(F.lit(bits - 1))
    word = F.shiftright(at, 6).alias("word")
    mask = F.expr(f"shiftleft(1L, cast({column} & 63 as int))")
    found = rows.select(word, mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = Bitmap(bits)
    out.words[found.column("word").to_numpy()] = found.column("mask").to_numpy().view(np.uint64)
    return out
