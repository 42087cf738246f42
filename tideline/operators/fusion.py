"""Fusion of several ranked views of events into one score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["qid", "store_no", "event_id"]


def view_share(view: DataFrame, how: str = "sum", zero_as_one: bool = False) -> DataFrame:
    """Scores of a view (qid, store_no, event_id, sim) per event, divided by the view's total."""
    per = view.groupBy(*KEY).agg((F.max if how == "max" else F.sum)("sim").alias("score"))
    total = F.sum("score").over(Window.partitionBy("qid"))
    if zero_as_one:
        total = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return per.withColumn("score", F.try_divide(F.col("score"), total))


def fuse(views: list[DataFrame], weights: list[float] | None = None) -> DataFrame:
    """Weighted sum of the views' shares per event; events of any view are kept."""
    out = None
    for v, w in zip(views, weights or [1.0] * len(views)):
        part = v.withColumn("score", F.col("score") * w)
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*KEY).agg(F.sum("score").alias("score"))
