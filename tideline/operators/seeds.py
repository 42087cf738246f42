"""Seed selection: top-k per query with the three meanings of a null score, fills, caps, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.ordering import numbered

Q = ["store_no", "question_id"]


def first_per_event(seeds: DataFrame) -> DataFrame:
    """First row per event of a query, in order of ``ord``."""
    w = Window.partitionBy(*Q, "event_id").orderBy("ord")
    return seeds.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _top(df: DataFrame, k: int, *order) -> DataFrame:
    return df.withColumn("rnk", F.row_number().over(Window.partitionBy(*Q).orderBy(*order))).where(F.col("rnk") <= k)


def topk_nulls_first(seeds: DataFrame, k: int) -> DataFrame:
    """A null score came from a time match and ranks above all scores."""
    return _top(first_per_event(seeds), k, F.desc_nulls_first("score"), "ord")


def topk_scored(seeds: DataFrame, k: int) -> DataFrame:
    """Null scores are left out."""
    return _top(first_per_event(seeds.where("score is not null")), k, F.desc("score"), "ord")


def topk_fill(seeds: DataFrame, k: int, filled: float = 1_000_000.0) -> DataFrame:
    """A null score counts as a very large one; output in order of start."""
    best = _top(first_per_event(seeds).withColumn("score", F.coalesce("score", F.lit(filled))), k, F.desc("score"), "s", "ord")
    return best.withColumn("place", F.row_number().over(Window.partitionBy(*Q).orderBy("s", "ord")))


def temporal_only(seeds: DataFrame) -> DataFrame:
    return seeds.where("score is null").select(*Q, "event_id").distinct()


def embedding_only(seeds: DataFrame, k: int) -> DataFrame:
    """Scored events that no time match of the query names, top k afterwards."""
    return topk_scored(seeds.join(temporal_only(seeds), [*Q, "event_id"], "left_anti"), k)


def base_and_temporal(seeds: DataFrame, k: int) -> DataFrame:
    return topk_scored(seeds, k).select(*Q, "event_id").unionByName(temporal_only(seeds)).distinct()


def budget_cap(seeds: DataFrame, extras: DataFrame, budget: int) -> DataFrame:
    """Seeds in their order, then extras by id, the first ``budget`` of each query. An extra that is
    a seed counts once, as a seed."""
    rows = seeds.select(*Q, "event_id", F.lit(0).alias("extra"), F.col("rnk").cast("bigint").alias("place")).unionByName(
        extras.join(seeds, [*Q, "event_id"], "left_anti").select(*Q, "event_id", F.lit(1).alias("extra"), F.lit(0).cast("bigint").alias("place")).distinct()
    )
    return rows.withColumn("slot", F.row_number().over(Window.partitionBy(*Q).orderBy("extra", "place", "event_id"))).where(F.col("slot") <= budget)


def uniform_sample(df: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """``k`` rows of each key at the places ``i * n div k``; all rows if there are no more than ``k``."""
    rows = numbered(df, [key], order)
    i = F.ceil(F.col("rank0") * k / F.col("group_size")).cast("bigint")
    hit = (i < k) & (F.floor(i * F.col("group_size") / k).cast("bigint") == F.col("rank0"))
    return rows.where((F.col("group_size") <= k) | hit)
