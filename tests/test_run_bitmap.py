import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tideline.operators.run_bitmap import FANOUT, blocks_of, clear_runs, merge_runs, pack_runs, periods_and_gaps, spans_of, unpack_runs

SCHEMA = "owner_kind string, owner_key string, s bigint, e bigint"


def brute(spans):
    out = set()
    by = {}
    for k, o, s, e in spans:
        if k is not None and o is not None and s is not None and e is not None and e > s:
            by.setdefault((k, o), []).append((s, e))
    for (k, o), xs in by.items():
        runs = []
        for s, e in sorted(xs):
            if runs and s <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], e)
            else:
                runs.append([s, e])
        out |= {(k, o, "period", s, e) for s, e in runs}
        out |= {(k, o, "gap", a[1], b[0]) for a, b in zip(runs, runs[1:])}
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-50, 50), st.integers(1, 20)), max_size=40))
def test_merge_runs(rows):
    g, s, e = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    got = merge_runs(g, s, s + e)
    want = {(int(o), s, t) for _, o, p, s, t in brute([("k", str(a), b, b + c) for a, b, c in rows]) if p == "period"}
    assert set(zip(*(x.tolist() for x in got))) == want


def test_container_round_trip():
    s, e = np.array([1, 9, 20]), np.array([4, 12, 21])
    a, b = unpack_runs(pack_runs(s, e))
    assert a.tolist() == s.tolist() and b.tolist() == e.tolist()
    assert [x.tolist() for x in clear_runs(a, b)] == [[4, 12], [9, 20]]


@pytest.mark.parametrize("width", [7, 64, 1 << 20])
def test_against_brute_force(spark, width):
    rng = random.Random(width)
    rows = [("store" if rng.random() < 0.5 else "entity", str(rng.choice([1, 1, 1, 2, 3])), s := rng.randint(-500, 3000), s + rng.choice([0, 1, 5, 40, 300])) for _ in range(600)]
    rows += rows[:50] + [(None, "1", 0, 5), ("store", None, 0, 5), ("store", "9", None, 5), ("store", "9", 5, None), ("store", "8", 7, 3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumns({"shard": F.lit("x"), "piece": F.lit(1), "runs": F.lit(0)})
    got = [tuple(r) for r in periods_and_gaps(df, width).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_empty_and_very_long(spark):
    assert periods_and_gaps(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [("k", "a", 0, 10**13), ("k", "a", 10**13, 10**13 + 5), ("k", "b", 5, 6)]
    assert {tuple(r) for r in periods_and_gaps(spark.createDataFrame(rows, SCHEMA)).collect()} == brute(rows)


def test_bridges(spark):
    """Spans over very many shards leave the shards of other spans and owners as they are."""
    rng = random.Random(5)
    rows = [("k", rng.choice("ab"), s := rng.randint(0, 4000), s + rng.randint(1, 9)) for _ in range(400)]
    rows += [("k", "a", 100, 1500), ("k", "a", 1400, 2300), ("k", "a", 3000, 3000 + 7 * 70), ("k", "b", 5000, 10**9), ("k", "b", 10**9 + 3, 10**9 + 4), ("k", "b", -(10**12), -100)]
    got = [tuple(r) for r in periods_and_gaps(spark.createDataFrame(rows, SCHEMA).repartition(3), 7).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


@settings(max_examples=200, deadline=None)
@given(st.integers(-(10**6), 10**6), st.integers(0, 10**6))
def test_blocks(a, n):
    got = sorted((x * FANOUT**k, (x + 1) * FANOUT**k) for k, x in blocks_of(a, a + n))
    assert all(p[1] == q[0] for p, q in zip(got, got[1:]))
    assert not n and not got or (got[0][0], got[-1][1]) == (a, a + n)


def test_unusable_spans(spark):
    rows = [(1, [1.0, 2.0005]), (1, [2.0004, 3.0]), (1, None), (1, [4.0]), (1, [5.0, None]), (1, [6.0, float("nan")]), (1, [7.0, float("inf")]), (1, [8.0, 8.0001]), (1, [1.0, 2.0, 3.0]), (1, [])]
    df = spark.createDataFrame(rows, "k int, d array<double>").select(*spans_of("store", F.col("k"), F.col("d")))
    assert {tuple(r) for r in periods_and_gaps(df).collect()} == {("store", "1", "period", 1000, 3000)}
