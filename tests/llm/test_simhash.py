import itertools

import numpy as np
import pytest
import xxhash

from graphloom.llm import simhash
from graphloom.llm.queries import op10_simhash_near_dedup
from tests.llm.helpers import SF, WORDS, components, empty_docs, odd_docs, texts


def fingerprint(text, width=3):
    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(docs, width=3):
    fp = [fingerprint(t, width) for _, t in docs]
    links = [(a, b) for a in range(len(docs)) for b in range(a) if (fp[a] ^ fp[b]).bit_count() <= 3]
    roots = components(range(len(docs)), links)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[roots[k]] = min(i, least.get(roots[k], i))
    return [(i, f"{fp[k]:016x}", least.get(roots[k])) for k, (i, _) in enumerate(docs)]


def key(r):
    return tuple(-1 if x is None else x for x in r)


def test_against_all_pairs(spark):
    assert sorted(map(tuple, op10_simhash_near_dedup(spark, SF).collect())) == sorted(brute(texts(spark)))


def test_odd_rows(spark):
    docs = odd_docs(spark)
    plain = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=key) == sorted(brute(plain), key=key)
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 4, 5, 7, 8, 8]
    assert simhash.keep_first(empty_docs(spark)).count() == 0


def test_every_pair_within_the_radius_meets():
    masks = simhash.covering_masks()
    assert len(masks) == 15
    assert all(any(not m & (1 << a | 1 << b | 1 << c) for m in masks) for a, b, c in itertools.combinations(range(64), 3))


@pytest.mark.parametrize("limit", [8, 1500])
def test_large_buckets(spark, limit):
    rng = np.random.default_rng(1)
    near = {int(sum(1 << int(b) for b in rng.choice(20, 2))) for _ in range(150)}
    far = {int(x) for x in rng.integers(-(1 << 63), 1 << 63, 100)}
    df = spark.createDataFrame([(x,) for x in near | far], "fp long")
    links = simhash.link_fingerprints(df, limit=limit).collect()
    values = sorted(near | far)
    want = components(values, [(a, b) for a in values for b in values if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= 3])
    assert components(values, [tuple(r) for r in links]) == want
