import numpy as np

from tideline.llm import knn

from test_knn import SCHEMA, brute, vectors


def test_many_scaled_copies_tie(spark):
    """All copies of one direction tie at 6 decimals: the smaller ids win, whatever the scale of a copy."""
    r = np.random.default_rng(5)
    x = vectors(60, 24, 4)
    near = [x[5] * s for s in r.uniform(0.3, 30, 60).astype(np.float32)]
    noise = [x[6] + x[6] * r.normal(size=24).astype(np.float32) * 1e-6 for _ in range(60)]
    rows = [(i, 24, v.tolist()) for i, v in enumerate(x)] + [(9000 - i, 24, v.tolist()) for i, v in enumerate([*near, *noise])]
    got = {q.vec_id: q.ids for q in knn.neighbours(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    want = brute(rows)
    ties = [5, 6, *range(8881, 9001)]
    assert {i: got[i] for i in ties} == {i: want[i] for i in ties}


def test_scaled_group_over_the_limit(spark):
    x = vectors(60, 8, 2)
    rows = [(i, 8, v.tolist()) for i, v in enumerate(x)] + [(9000 - j, 8, (x[5] * 2.0 ** (j % 20 - 10)).tolist()) for j in range(knn.COPY_LIMIT + 44)]
    df = spark.createDataFrame(rows, SCHEMA)
    keys = df.mapInArrow(knn._counted(8), "h1 bigint, h2 bigint, n bigint").groupBy("h1", "h2").agg({"n": "sum"})
    assert keys.agg({"sum(n)": "max"}).first()[0] == knn.COPY_LIMIT + 45
    got = {q.vec_id: q.ids for q in knn.neighbours(df.repartition(3)).collect()}
    want = brute(rows)
    assert all(got[i] == want[i] for i in [5, 9000, 8999, 8701])


def test_float_noise_over_the_limit(spark):
    """A large group of copies with odd scale factors is found by the rounded direction and answered as one."""
    r = np.random.default_rng(8)
    x = vectors(60, 24, 4)
    many = [x[5] * s for s in r.uniform(0.3, 30, 6 * knn.COPY_LIMIT).astype(np.float32)]
    rows = [(i, 24, v.tolist()) for i, v in enumerate(x)] + [(9000 - i, 24, v.tolist()) for i, v in enumerate(many)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    n, travel, hot = knn._hot_groups(df, 24, 10)
    assert n == len(rows) and travel < n - 3 * knn.COPY_LIMIT and len(hot.value.h1) < 8
    got = {q.vec_id: q.ids for q in knn.neighbours(df).collect()}
    want = brute(rows)
    assert got.keys() == want.keys()
    assert sum(len(set(got[i]) & set(v)) for i, v in want.items()) / sum(map(len, want.values())) > 0.99


def test_long_lists_are_split():
    """A list over the limit is searched by an index of its own, with much less than all pairs compared."""
    x = knn._unit(vectors(6000, 24, 7).astype(float)).astype(np.float32)
    one = np.zeros(len(x), np.int32), np.arange(len(x))
    work = sum(len(o) * len(q) for o, q in knn._searches(x, one, one))
    assert work < len(x) ** 2 / 4
    q, o, s = knn.search_shard(x, one, one, 10, 0.8, x, np.arange(len(x)))
    found = set(zip(q.tolist(), o.tolist()))
    sim = x[:300] @ x.T
    sim[np.arange(300), np.arange(300)] = -1
    true = {(i, j) for i in range(300) for j in np.argsort(-sim[i])[:10].tolist() if sim[i, j] >= 0.8}
    assert len(true & found) / len(true) > 0.95


def test_exact_and_recall(spark):
    x = vectors(900, 12, 9)
    rows = [(i, 12, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert {q.vec_id: q.ids for q in knn.neighbours(df, exact=True).collect()} == want
    one = knn.recall(df, knn.neighbours(df), every=10).first()
    assert one.queries == sum(i % 10 == 0 for i in want) and one.recall > 0.95


def test_block_search(spark, monkeypatch):
    """More queries than are broadcast: blocks of queries against blocks of rows give the same answers."""
    from tideline.operators import vector

    for name, size in (("BLOCK", 50), ("QUERY_BLOCK", 300), ("ROW_BLOCK", 350)):
        monkeypatch.setattr(vector, name, size)
    x = vectors(900, 12, 9)
    rows = [(i, 12, v.tolist()) for i, v in enumerate(x)]
    assert {q.vec_id: q.ids for q in knn.neighbours(spark.createDataFrame(rows, SCHEMA), exact=True).collect()} == brute(rows)
