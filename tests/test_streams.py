"""Streams in append mode: the watermark drops late rows and closes windows; update mode keeps the last of a key."""

import time

import pytest

from tideline.streaming import streams as W

HOUR = 3_600_000
SCHEMA = "store_no bigint, pos bigint, ms bigint, me bigint"


def written(spark, path, *files):
    for rows in files:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # a stream reads files in order of their age
    return W.source(spark, path, 1)


@pytest.mark.parametrize("late, want", [(8 * HOUR, {(1, 0): 1, (1, 10 * HOUR): 2}), (10 * HOUR - 1800_000, {(1, 0): 1, (1, 10 * HOUR): 2, (1, 10 * HOUR - 1800_000): 1})])
def test_late_rows(spark, tmp_path, late, want):
    """A row that comes more than an hour after the latest one is left out; one within the hour counts."""
    s = written(spark, str(tmp_path / "in"), [(1, 0, 0, 1000), (1, 1, 10 * HOUR, 10 * HOUR + 1000)], [(1, 2, 10 * HOUR + 500, 10 * HOUR + 2000)], [(1, 3, late, late + 1000)])
    got = W.windows_of(s, lambda e: W.gap_clusters(e, 30_000), "late").collect()
    assert {(r.store_no, r.s): r.n for r in got} == want
    assert next(r.e for r in got if r.s == 10 * HOUR) == 10 * HOUR + 2000


def test_sliding_chunks_and_empty_input(spark, tmp_path):
    s = written(spark, str(tmp_path / "in"), [(1, 0, 5_000, 6_000), (1, 1, 25_000, 26_000)])
    got = {(r.s, r.n) for r in W.windows_of(s, lambda e: W.sliding_counts(e, "30 seconds", "20 seconds"), "slide").collect()}
    assert got == {(-20_000, 1), (0, 2), (20_000, 1)}
    none = W.source(spark, _empty(spark, tmp_path))
    assert W.windows_of(none, lambda e: W.gap_clusters(e, 30_000), "none").count() == 0


def _empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "empty"))
    return str(tmp_path / "empty")


def test_running_aggregates(spark, tmp_path):
    path = str(tmp_path / "tracks")
    for rows in ([(1, "a", 5), (1, "b", 7)], [(1, "a", 2)], [(1, "a", 9), (2, "c", 1)]):
        spark.createDataFrame(rows, "store_no bigint, entity_id string, frame bigint").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    got = W.drained(W.running_tracks(W.source(spark, path, 1)), "update", "tracks", ["store_no", "entity_id"]).collect()
    assert {tuple(r) for r in got} == {(1, "a", 2, 9, 3), (1, "b", 7, 7, 1), (2, "c", 1, 1, 1)}


def test_state_goes_on(spark, tmp_path):
    """Queries of a store that arrive in two files are answered as in one."""
    rows = [(1, q, None, f"e{q}", 0, 10.0 * (q % 3), 10.0 * (q % 3) + 20, True) for q in range(6)]
    schema = "store_no bigint, question_id bigint, seed_id string, event_id string, rnk bigint, s double, e double, ok boolean"
    path = str(tmp_path / "rows")
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    got = {r.question_id: (r.n_reused, r.cache_size, r.a) for r in W.drained_cache(W.source(spark, path, 1)).collect()}
    from tideline.operators.cache import cross_cache

    assert got == {r.question_id: (r.n_reused, r.cache_size, r.a) for r in cross_cache(spark.createDataFrame(rows, schema)).collect()}
