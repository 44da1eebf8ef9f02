"""Byte-level BPE from a tokenizers file, encoded as the tokenizers library does."""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import tiktoken

#: The pre-tokenizer of byte-level BPE files (fixed).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """Byte-level files write a byte as itself if printable, else as a character from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder; special tokens in a text are found as the tokenizers library finds them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or pre != pre | {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True} or model["type"] != "BPE":
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        byte_of = _byte_of()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if t not in special}
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ids = [model["vocab"][m] for m in merges]
        if ids != sorted(ids):
            raise ValueError(f"{path}: ids do not follow the order of merges")
        #: The narrowest type that holds every id.
        self.kind = "<u2" if max(*ranks.values(), *special.values(), 0) < 1 << 16 else "<u4"
        self.codec = tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        return self.codec.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)

    def decode(self, ids: np.ndarray) -> str:
        return self.codec.decode_bytes(ids.tolist()).decode("utf-8", "replace")


@lru_cache(4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)
