import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import knn


def brute(rows, k=10, least=0.8):
    ok = {}
    for i, d, m in rows:
        if i is None or d is None or m is None or len(m) != d or any(x is None for x in m):
            continue
        a = np.array(m, np.float32).astype(float)
        if np.isfinite(a).all() and a.any():
            ok[i] = a / np.linalg.norm(a)
    ids = sorted(ok)
    out = {}
    for i in ids:
        s = sorted((-round(float(ok[i] @ ok[j]), 6), j) for j in ids if j != i and len(ok[j]) == len(ok[i]))
        near = [j for v, j in s if v <= -least][:k]
        if near:
            out[i] = near
    return out


def vectors(n, dim, seed):
    r = np.random.default_rng(seed)
    c = r.normal(size=(max(1, n // 25), dim))
    x = c[r.integers(len(c), size=n)] + r.normal(size=(n, dim)) * r.choice([0.1, 0.25, 0.6], size=(n, 1))
    return (x * r.uniform(0.3, 30, size=(n, 1))).astype(np.float32)


SCHEMA = "vec_id bigint, embedding_dim int, matrix array<float>"


def test_recall_against_brute_force(spark):
    x = vectors(3000, 16, 1)
    rows = [(int(i) * 7 % 10007, 16, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).withColumns({"shard": F.lit(1), "vec": F.lit("a"), "ids": F.lit(2)})
    got = {r.vec_id: r.ids for r in knn.neighbours(df).collect()}
    want = brute(rows)
    hit = sum(len(set(v) & set(got.get(i, []))) for i, v in want.items())
    assert hit / sum(map(len, want.values())) >= 0.95
    pairs = {(min(i, j), max(i, j)) for i, v in want.items() for j in v}
    found = {tuple(r) for r in knn.neighbour_pairs(knn.neighbours(df)).collect()}
    assert len(found & pairs) / len(pairs) >= 0.95 and all(a < b for a, b in found)


@pytest.mark.parametrize("copies", [3, 40, knn.COPY_LIMIT + 60])
def test_copies_and_ties(spark, copies):
    """Copies are neighbours like others, ties go to the smaller id, large groups are answered whole."""
    x = vectors(150, 8, 2)
    rows = [(i, 8, v.tolist()) for i, v in enumerate(x)] + [(10_000 - j, 8, x[5].tolist()) for j in range(copies)] + [(20_000, 8, (x[5] * 4).tolist())]
    got = {r.vec_id: r.ids for r in knn.neighbours(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert sum(got[i] == v for i, v in want.items()) / len(want) > 0.97
    assert got[10_000] == want[10_000] and got[5] == want[5]


def test_unusable_and_empty(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 2, [1.0, 0.0]), (2, 2, [0.9, 0.1]), (3, 2, None), (4, 2, []), (5, 2, [1.0]), (6, None, [1.0, 0.0]), (7, 2, [nan, 1.0]), (8, 2, [inf, 1.0]), (9, 2, [0.0, 0.0]), (10, 2, [1.0, None]), (None, 2, [1.0, 0.0]),
            (11, 3, [1.0, 0.0, 0.0]), (12, 3, [1.0, 0.01, 0.0]), (13, 2, [-1.0, 0.0]), (14, 2, [1e-38, 0.0]), (15, 2, [3e38, 0.0])]
    got = {r.vec_id: r.ids for r in knn.neighbours(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: [14, 15, 2], 14: [1, 15, 2], 15: [1, 14, 2], 2: [1, 14, 15], 11: [12], 12: [11]}
    assert knn.neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    assert knn.neighbour_pairs(knn.neighbours(spark.createDataFrame([(3, 2, None)], SCHEMA))).count() == 0


def test_heads_are_found():
    x = knn._unit(vectors(4000, 32, 3).astype(float)).astype(np.float32)
    ix = knn.fit(x[:2000], 40_000)
    ids, sims = knn.nearest_heads(ix, x, 5)
    best = (x @ ix.heads.T).max(axis=1)
    near = best > 0.8
    assert (np.abs(sims[near, 0] - best[near]) < 1e-5).mean() > 0.9
    assert ix.shard.min() == 0 and (np.diff(ix.shard) >= 0).all() and ids.max() < len(ix.heads)
