"""Order-dependent operators that never put a whole group into one task.

Rows of a group are cut into blocks of their numeric order key; windows run inside a block, and one
summary row per block carries what crosses its borders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def prev_next(df: DataFrame, key: str, order: str, value: str, block: int = BLOCK) -> DataFrame:
    """Add ``prev_<value>`` and ``next_<value>``: the neighbour's value in order of ``order`` (unique
    within a key). Rows with a null key or order are left out."""
    df = df.where(F.col(key).isNotNull() & F.col(order).isNotNull()).withColumn("_b", F.floor(F.col(order) / block))
    w = Window.partitionBy(key, "_b").orderBy(order)
    inner = df.withColumns({"_p": F.lag(value).over(w), "_n": F.lead(value).over(w), "_lo": F.lag(order).over(w).isNull(), "_hi": F.lead(order).over(w).isNull()})
    ends = df.groupBy(key, "_b").agg(F.min_by(value, order).alias("_first"), F.max_by(value, order).alias("_last"))
    wb = Window.partitionBy(key).orderBy("_b")
    around = ends.select(key, "_b", F.lag("_last").over(wb).alias("_before"), F.lead("_first").over(wb).alias("_after"))
    out = inner.join(around, [key, "_b"])
    return out.withColumns({f"prev_{value}": F.when(F.col("_lo"), F.col("_before")).otherwise(F.col("_p")), f"next_{value}": F.when(F.col("_hi"), F.col("_after")).otherwise(F.col("_n"))}).drop(
        "_b", "_p", "_n", "_lo", "_hi", "_before", "_after"
    )


def numbered(df: DataFrame, keys: list[str], order: str, into: str = "rank0", size: str = "group_size", block: int = BLOCK, then: tuple[str, ...] = ()) -> DataFrame:
    """Add the 0-based place in order of ``order``, then of the columns ``then`` (unique together within the keys), and the
    group's size. Blocks are of ``order`` alone."""
    df = df.withColumn("_b", F.floor(F.col(order) / block))
    counts = df.groupBy(*keys, "_b").agg(F.count("*").alias("_c"))
    wk = Window.partitionBy(*keys)
    base = counts.select(
        *keys, "_b", (F.sum("_c").over(wk.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).alias("_base"), F.sum("_c").over(wk).alias(size)
    )
    inner = df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(order, *then)) - 1)
    return inner.join(base, [*keys, "_b"]).withColumn(into, (F.col("_base") + F.col("_r")).cast("bigint")).drop("_b", "_r", "_base")
