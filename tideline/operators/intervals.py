"""Interval joins, merging, lengths and coverage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.run_bitmap import SHARD_WIDTH, periods_and_gaps

#: Width of a join bucket in the unit of the intervals; near the median length is best. An interval over
#: more than LONG buckets is put into buckets LONG times as wide, and so on,
#: in LEVELS classes: an interval has at most LONG + 1 rows in each up to a length of BUCKET * LONG ** LEVELS
#: (with buckets of 64 s, 34 years), beyond it one more for every 194 days.
BUCKET, LONG, LEVELS = 64, 64, 4


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], on: Callable[[Column, Column, Column, Column], Column], width: float = BUCKET) -> DataFrame:
    """Inner join of intervals ``(ls, le)`` with ``(rs, re)`` of the same keys under a convention.

    Both sides are put into time buckets of the width class of their length and joined on (keys, class,
    bucket), so a key with many rows is spread over its buckets. An interval also looks into the buckets
    of the other classes: of a longer class it touches one or two, of a shorter one those of its ends and
    between. So that this stays bounded, each side is written in its own class and asks only the longer
    ones; a pair meets in the class of the longer of the two, in the bucket of the later start.

    Two rows that both only ask a class never meet in it: ``_o`` says whose own class it is, the left side's (with every
    right row) or only the right side's. Else all rows of a key would meet in the one bucket of the longest class."""
    a, b = _cells(left, "ls", "le", width), _cells(right, "rs", "re", width)
    a = a.withColumn("_o", F.col("_w") == F.col("_lw"))
    b = b.withColumn("_o", F.explode(F.when(F.col("_w") == F.col("_rw"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    met = a.join(b, [*keys, "_w", "_c", "_o"])
    later = F.floor(F.greatest("ls", "rs") / (F.lit(float(width)) * F.pow(F.lit(float(LONG)), F.col("_w")))).cast("bigint")
    return met.where((F.col("_c") == later) & on(F.col("ls"), F.col("le"), F.col("rs"), F.col("re"))).drop("_c", "_w", "_o", "_lw", "_rw")


def _cells(df: DataFrame, s: str, e: str, width: float) -> DataFrame:
    """Rows by (class, bucket): the own class and every longer one, in which an interval has one or two buckets."""
    mine = f"_{s[0]}w"
    span = F.greatest(F.col(e) - F.col(s), F.lit(0)) / width
    klass = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        klass = F.when(span <= float(LONG) ** (k + 1), F.lit(k)).otherwise(klass)
    rows = df.withColumn(mine, klass).withColumn("_w", F.explode(F.sequence(F.col(mine), F.lit(LEVELS - 1))))
    size = F.lit(float(width)) * F.pow(F.lit(float(LONG)), F.col("_w"))
    cell = lambda c: F.floor(F.col(c) / size).cast("bigint")
    return rows.withColumn("_c", F.explode(F.sequence(cell(s), F.greatest(cell(s), cell(e)))))


def merged(df: DataFrame, key: str, gap: int = 0, shard: int = SHARD_WIDTH) -> DataFrame:
    """Intervals (``key``, ``s``, ``e`` in whole units) merged when they touch or stand at most
    ``gap`` apart. Built on run bitmaps with the ends moved out by ``gap``, so a key with many rows is
    spread over time shards of ``shard`` units. With a gap, empty intervals count; without, they are
    dropped (C9)."""
    spans = df.select(F.lit("k").alias("owner_kind"), F.col(key).cast("string").alias("owner_key"), F.col("s").cast("bigint").alias("s"), (F.col("e") + gap).cast("bigint").alias("e"))
    out = periods_and_gaps(spans, shard).where("piece = 'period'")
    return out.select(F.col("owner_key").cast(df.schema[key].dataType).alias(key), F.col("start_ms").alias("s"), (F.col("end_ms") - gap).alias("e"))


def total_length(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.sum(F.col("e") - F.col("s")).cast("bigint").alias("length"))


def union_length(df: DataFrame, key: str) -> DataFrame:
    return total_length(merged(df, key), key)


def intersection(a: DataFrame, b: DataFrame, key: str, width: float = BUCKET) -> DataFrame:
    """Shared pieces of two interval sets that are each merged already."""
    from tideline.functions.intervals import overlaps_strict

    left = a.select(key, F.col("s").alias("ls"), F.col("e").alias("le"))
    right = b.select(key, F.col("s").alias("rs"), F.col("e").alias("re"))
    return overlap_join(left, right, [key], overlaps_strict, width).select(key, F.greatest("ls", "rs").alias("s"), F.least("le", "re").alias("e"))


def hits_reference(s, e, rs, re):
    """An event hits a reference: a point (equal ends) by C4, a range by C3; an inverted one never."""
    from tideline.functions.intervals import holds_half_open, overlaps_strict

    return F.when(rs == re, holds_half_open(s, e, rs)).otherwise(overlaps_strict(s, e, rs, re))


def coverage(runs: DataFrame, refs: DataFrame, key: str, width: float = BUCKET) -> DataFrame:
    """Adds to every reference (``key``, ``s``, ``e`` and further columns) the share of it that the merged
    ``runs`` (``key``, ``s``, ``e``) cover; a point has 1 or 0 (C4), an inverted reference 0."""
    rest = [c for c in refs.columns if c not in (key, "s", "e")]
    r = refs.select(key, *rest, F.col("s").alias("rs"), F.col("e").alias("re"))
    met = overlap_join(runs.select(key, F.col("s").alias("ls"), F.col("e").alias("le")), r, [key], hits_reference, width)
    part = F.when(F.col("rs") == F.col("re"), F.lit(1.0)).otherwise((F.least("le", "re") - F.greatest("ls", "rs")) / (F.col("re") - F.col("rs")))
    share = met.groupBy(key, *rest, "rs", "re").agg(F.least(F.lit(1.0), F.sum(part)).alias("coverage"))
    return r.join(share, [key, *rest, "rs", "re"], "left").select(key, *rest, F.col("rs").alias("s"), F.col("re").alias("e"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))


def clusters(df: DataFrame, key: str, gap: int, width: float = BUCKET) -> DataFrame:
    """Rows with the cluster (its start and end) that they belong to, under :func:`merged` with ``gap``."""
    from tideline.functions.intervals import overlaps_closed

    found = merged(df, key, gap).select(key, F.col("s").alias("rs"), F.col("e").alias("re"))
    rows = df.withColumns({"ls": F.col("s"), "le": F.col("e")})
    return overlap_join(rows, found, [key], overlaps_closed, width).drop("ls", "le").withColumnsRenamed({"rs": "cluster_s", "re": "cluster_e"})
