import random

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from graphloom.llm import repeats
from graphloom.llm.queries import op8_repeat_removal
from tests.llm.helpers import SF, empty_docs, odd_docs, sha, texts


def brute(docs, width):
    """docs: (doc_id, text); repeated rows are one document."""
    order = sorted({((i is None, i or 0), repeats.xxhash.xxh64_intdigest((t or "").encode(), 42), i, (t or "").encode()) for i, t in docs}, key=lambda d: d[:2])
    seen, out = set(), {}
    for _, _, i, data in order:
        gone = bytearray(len(data))
        for s in range(len(data) - width + 1):
            w = data[s : s + width]
            if w in seen:
                gone[s : s + width] = b"\1" * width
            seen.add(w)
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out[i, data] = (len(data), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), sha(left))
    return sorted((i if i is not None else -1, *out[i, (t or "").encode()]) for i, t in docs)


def got(df):
    return sorted((r[0] if r[0] is not None else -1, *tuple(r)[1:5]) for r in df.collect())


def test_against_brute_force(spark):
    rows = [(i, t) for i, t in texts(spark) if i < 500]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(repeats.remove_repeats(df)) == brute(rows, 100)


def test_whole_table(spark):
    got_ = {r[0]: r for r in op8_repeat_removal(spark, SF).collect()}
    docs = texts(spark)
    assert {i: len((t or "").encode()) for i, t in docs} == {i: r.n_bytes for i, r in got_.items()}
    assert got(op8_repeat_removal(spark, SF)) == brute(docs, 100)


@pytest.mark.parametrize("bits", [64, 1 << 16])
def test_short_windows_and_full_bitmap(spark, bits, monkeypatch):
    rng = random.Random(4)
    words = ["alpha", "beta", "été", "gamma delta", "x"]
    rows = [(i % 37, " ".join(rng.choice(words) for _ in range(rng.randrange(30)))) for i in range(80)] + [(None, "alpha beta gamma delta x x x"), (3, None), (5, "alpha " * 40), (5, "alpha " * 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(repeats.remove_repeats(df, width=12, gram=4, bits=bits)) == brute(rows, 12)


def test_odd_rows(spark):
    docs = odd_docs(spark)
    assert got(repeats.remove_repeats(docs)) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()], 100)
    assert repeats.remove_repeats(empty_docs(spark)).count() == 0


def test_owners_of_long_documents_in_segments(monkeypatch):
    data = np.random.default_rng(0).integers(0, 4, 5000).astype(np.uint8)
    h, place, first, last, _ = repeats.owners(data, np.array([5000]))
    assert first[0] == 0 and last[-1] == 4900 and (first[1:] == last[:-1] + 1).all()
    assert ((place >= last) & (place <= first + 80)).all()


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 9)), max_size=12))
def test_merge(pairs):
    ranges = np.array(sorted((s, s + n) for s, n in pairs), np.int64).reshape(-1, 2)
    covered = {x for s, e in ranges.tolist() for x in range(s, e)}
    out = repeats.merge(ranges).tolist()
    assert {x for s, e in out for x in range(s, e)} == covered and all(a[1] < b[0] for a, b in zip(out, out[1:], strict=False))
