import random

from pyspark.sql import functions as F

from tideline.functions.intervals import overlaps_closed
from tideline.operators.intervals import LEVELS, LONG, _cells, overlap_join


def _spans(spark, rows, side):
    return spark.createDataFrame(rows, f"k bigint, {side}i bigint, {side}s double, {side}e double")


def test_equals_all_pairs_over_all_classes(spark):
    r = random.Random(5)
    make = lambda n: [(i % 2, i, s, s + r.choice([0, 3, 70, 5000, 300000, 2e7])) for i in range(n) for s in [r.uniform(-1e5, 3e5)]]
    a, b = make(150), make(130)
    got = sorted((x.li, x.ri) for x in overlap_join(_spans(spark, a, "l"), _spans(spark, b, "r"), ["k"], overlaps_closed).collect())
    assert got == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] <= y[3] and x[3] >= y[2])


def test_short_rows_of_a_key_do_not_all_meet(spark):
    """Short intervals meet in buckets of their own class alone, not in the one bucket of the longest."""
    n = 3000
    rows = lambda side: spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias(f"{side}i"), (F.col("id") * 100.0).alias(f"{side}s"), (F.col("id") * 100.0 + 5).alias(f"{side}e"))
    assert _cells(rows("l"), "ls", "le", 64).where(F.col("_w") == LEVELS - 1).select("_c").distinct().count() == 1 and n * 100 < 64 * LONG ** (LEVELS - 1)
    met = overlap_join(rows("l"), rows("r"), ["k"], overlaps_closed)
    join = next(x for x in met._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x)
    assert "(_o#" in join and met.count() == n
