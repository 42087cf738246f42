"""Every registered query with an SQL twin agrees with it on the smallest tables; the others run."""

import datetime
import decimal
import math
import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def oracle():
    import duckdb

    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else round(float(v), 5) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, DATA)
    rows = sorted((tuple(plain(v) for v in r) for r in df.collect()), key=repr)
    if name in SQL:
        r = oracle.execute(SQL[name])
        cols = [d[0] for d in r.description]
        assert sorted(cols) == sorted(df.columns)
        at = [cols.index(c) for c in df.columns]
        assert rows == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)


def test_stream_equals_batch(spark):
    cols = ["store_no", "question_id", "n_seeds", "n_reused", "n_covered", "cache_size"]
    get = lambda n: sorted(tuple(r) for r in QUERIES[n](spark, DATA).select(*cols).collect())
    assert get("stream_cache") == get("crosscache_sequential")


def test_entry(spark):
    assert entry.entry(spark).columns[:2] == ["store_no", "question_id"]
