import numpy as np
import pytest

from graphloom.llm import forest
from graphloom.llm.queries import op3_embedding_near_dedup
from tests.llm.helpers import SF, components


def brute(rows):
    fit = [(i, forest.unit(np.array([v]))[0]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for k, (a, x) in enumerate(fit) for b, y in fit[:k] if len(x) == len(y) and x @ y >= 0.9]
    n = {i: 0 for i, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    roots = components([i for i, _ in rows if i is not None], links)
    return {i: (n[i] if i is not None else 0, roots.get(i), i is not None and roots[i] == i) for i, _ in rows}


def test_against_all_pairs(spark):
    rows = [tuple(r)[:2] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert {r[0]: tuple(r)[1:] for r in op3_embedding_near_dedup(spark, SF).collect()} == brute(rows)


@pytest.mark.parametrize("leaf", [20, 1000])
def test_small_leaves_blocks_and_large_groups(spark, leaf):
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(16)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(300)] + [(300 + i, (centre + 0.02 * rng.standard_normal(16)).tolist()) for i in range(150)] + [(450 + i, centre.tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r[0]: tuple(r)[1:] for r in forest.near_duplicates(df, leaf=leaf, trees=8).collect()}
    assert got == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [1.0, inf]), (6, [1.0, None]), (None, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [2.0, 0.0]), (10, [1.0, 0.0]), (11, [1e300, 0.0]), (12, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS cid", "2 AS size")
    got = {r[0]: tuple(r)[1:] for r in forest.near_duplicates(df).collect()}
    assert got == brute(rows)
    assert forest.near_duplicates(df.where("vec_id < 0")).count() == 0


def test_recall_of_deep_trees(spark):
    """20,000 vectors in leaves of some 300, so trees are 6 or 7 levels deep; planted pairs have a cosine of 0.9 to 0.92."""
    rng = np.random.default_rng(8)
    dim, n = 64, 20_000
    v = forest.unit(rng.standard_normal((n, dim)))
    pairs = np.arange(0, 2000, 2)
    side = rng.standard_normal((len(pairs), dim))
    side = forest.unit(side - (side * v[pairs]).sum(1, keepdims=True) * v[pairs])
    cosine = rng.uniform(0.9005, 0.92, (len(pairs), 1))
    v[pairs + 1] = cosine * v[pairs] + np.sqrt(1 - cosine**2) * side
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in forest.near_duplicates(df, leaf=300).collect()}
    found = sum(got[i + 1] == got[i] for i in pairs.tolist())
    assert found >= 0.9 * len(pairs), found
    assert sum(k != c for k, c in got.items()) <= len(pairs)  # no links but the planted ones
