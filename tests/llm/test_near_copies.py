"""The pipeline's SimHash stage against brute-force Jaccard similarity of five-word shingles."""

import random

from graphloom.llm import simhash
from tests.llm import test_simhash
from tests.llm.helpers import SF, WORDS, components, texts

IDS = "doc_id long, text string"


def shingles(text):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4))


def alike(a, b):
    return bool(a) and 5 * len(a & b) >= 4 * len(a | b)


def later(docs):
    """Ids of (doc_id, text) rows, in order, that an earlier row is like."""
    by_token, out, sets = {}, set(), []
    for k, (i, t) in enumerate(docs):
        s = shingles(t)
        if any(alike(s, sets[m]) for m in {m for x in s for m in by_token.get(x, ())}):
            out.add(i)
        sets.append(s)
        for x in s:
            by_token.setdefault(x, []).append(k)
    return out


def by_fingerprint(docs):
    """The rows that have the least id of their component within radius 3."""
    docs = sorted(docs)
    fp = [test_simhash.fingerprint(t, 5) for _, t in docs]
    values = sorted(set(fp))
    roots = components(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3])
    first = {}
    for k in range(len(docs)):
        first.setdefault(roots[fp[k]], k)
    return [docs[k] for k in sorted(first.values())]


def check(spark, docs):
    firsts = by_fingerprint(docs)
    gone = later(firsts)
    kept = simhash.keep_first(spark.createDataFrame(docs, IDS)).collect()
    assert sorted(r.doc_id for r in kept) == [i for i, _ in firsts if i not in gone]
    return gone


def test_edited_copies_go(spark):
    rng = random.Random(4)
    docs = []
    for k in range(60):
        own = [f"W{rng.randrange(3000)}" for _ in range(rng.randrange(8, 200))]
        docs.append((len(docs), " ".join(own)))
        for edits in (1, 2, 4, 8):
            other = list(own)
            for _ in range(edits):
                other[rng.randrange(len(other))] = f"x{rng.randrange(3000)}"
            docs.append((len(docs), "\n".join(other).lower()))
    assert len(check(spark, docs)) > 60


def test_whole_table(spark):
    assert check(spark, texts(spark))
