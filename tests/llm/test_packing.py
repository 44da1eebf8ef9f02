import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from graphloom.llm import packing
from graphloom.llm.queries import op9_packing
from tests.llm.helpers import SF, empty_docs, odd_docs, texts

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def whole(rows, docs):
    """Every id of every document lies in one piece; sequences are gapless."""
    want = defaultdict(list)
    for doc_id, text in docs:
        ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]
        want[doc_id, len(ids)].append(ids)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert {k: sorted(v) for k, v in pieces.items()} == {k: sorted((s, len(ids[s : s + 1024]), zlib.crc32(np.array(ids[s : s + 1024], "<u4").tobytes())) for ids in v for s in range(0, len(ids), 1024)) for k, v in want.items()}
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    return sequences


def test_whole_tables(spark):
    docs = texts(spark)
    rows = op9_packing(spark, SF).collect()
    sequences = whole(rows, docs)
    total = sum(r.length for r in rows)
    assert total > 0.99 * 1024 * len(sequences)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    whole(packing.pack(docs, group=4).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert packing.pack(empty_docs(spark)).count() == 0


def test_groups_are_sized_by_pieces(spark):
    docs = spark.createDataFrame([(i, "a b c d " * 2000) for i in range(40)], "doc_id long, text string")
    rows = whole(packing.pack(docs, group=50).collect(), [tuple(r) for r in docs.collect()])
    sizes = {}
    for sequence, pieces in rows.items():
        sizes[sequence >> 32] = sizes.get(sequence >> 32, 0) + len(pieces)
    assert sum(sizes.values()) == 40 * 8 and len(sizes) >= 5 and max(sizes.values()) < 100


def test_first_fit_decreasing_against_plain():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 101, 500).tolist()
    bins, want = [], {}
    for i in sorted(range(500), key=lambda i: (-lengths[i], i)):
        b = next((k for k, used in enumerate(bins) if used + lengths[i] <= 100), len(bins))
        if b == len(bins):
            bins.append(0)
        want[i] = (b, bins[b])
        bins[b] += lengths[i]
    assert packing.first_fit_decreasing(lengths, 100) == [want[i] for i in range(500)]
