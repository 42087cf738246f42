"""Retrieval accuracy of event sets against true segments, per query and overall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.intervals import f1, overlaps_strict, truncated_ends
from tideline.operators.intervals import coverage, intersection, merged, overlap_join, total_length
from tideline.session import checkpointed

Q = ["store_no", "question_id"]
INF = float("inf")


def ratio(a, b):
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def noise_ratio(signal, noise):
    """Signal over noise; infinite without noise, 0 without either."""
    return F.when(noise > 0, signal.cast("double") / noise).when(signal > 0, F.lit(INF)).otherwise(F.lit(0.0))


def retrieval_accuracy(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row per query of ``truth``. ``found``: store_no, question_id, event_id, ord, s, e.
    ``truth``: store_no, question_id, seg, gs, ge (whole seconds), and point where some are times, kept as ``[gs, gs + 1)``.

    Events are cut to whole seconds, the first row of an id counts, empty spans are rejected (C10); an
    event is right if it shares more than a point with a segment (C3). ``hit`` and ``coverage`` look at the
    reference itself: a point, or a range of equal ends, is hit from an event's start to before its end
    (C4); coverage is the mean over the segments of a question. Lengths are of unions. Zero denominators
    give 0; the noise ratios are infinite where there is signal and no noise. The small tables that several
    measures share are written once to the shared checkpoint folder."""
    a, b = truncated_ends(F.col("s"), F.col("e"))
    ev = found.where("e > s").groupBy(*Q, "event_id").agg(F.min_by(F.struct("s", "e"), "ord").alias("x"))
    key = F.concat_ws(":", *Q)
    ev = checkpointed(ev.select(*Q, "event_id", F.col("x.s").alias("s"), F.col("x.e").alias("e")).select(*Q, "event_id", a.alias("s"), b.alias("e")).withColumn("k", key))
    truth = truth if "point" in truth.columns else truth.withColumn("point", F.lit(False))
    truth = checkpointed(truth.select(*Q, "seg", "gs", "ge", "point").withColumn("k", key))
    hits = overlap_join(ev.withColumnsRenamed({"s": "ls", "e": "le"}).drop("k"), truth.select(*Q, "seg", F.col("gs").alias("rs"), F.col("ge").alias("re")), Q, overlaps_strict)
    n_ev = ev.groupBy(*Q).agg(F.count("*").alias("n_events"), F.sum(F.col("e") - F.col("s")).alias("total_s"))
    n_gt = truth.groupBy(*Q).agg(F.count("*").alias("n_segments"))
    n_hit = hits.groupBy(*Q).agg(F.count_distinct("event_id").alias("tp_evt"), F.count_distinct("seg").alias("tp_seg"))
    r, g = checkpointed(merged(ev.select("k", "s", "e"), "k")), merged(truth.select("k", F.col("gs").alias("s"), F.col("ge").alias("e")), "k")
    g = checkpointed(g)
    refs = truth.select("k", "seg", F.col("gs").alias("s"), F.when(F.col("point"), F.col("gs")).otherwise(F.col("ge")).alias("e"))
    cover = coverage(r, refs, "k").groupBy("k").agg(F.avg("coverage").alias("coverage"), F.max(F.col("coverage") > 0).alias("hit"))
    shared = intersection(r, g, "k").groupBy("k").agg(F.sum(F.col("e") - F.col("s")).alias("both_s"))
    out = n_gt.join(n_ev, Q, "left").join(n_hit, Q, "left").withColumn("k", key)
    out = out.join(total_length(r, "k").withColumnRenamed("length", "found_s"), "k", "left").join(total_length(g, "k").withColumnRenamed("length", "true_s"), "k", "left").join(shared, "k", "left").join(cover, "k", "left")
    out = out.fillna(0, ["n_events", "total_s", "tp_evt", "tp_seg", "found_s", "true_s", "both_s", "coverage"])
    fp, fn = F.col("n_events") - F.col("tp_evt"), F.col("n_segments") - F.col("tp_seg")
    p, q = ratio(F.col("tp_evt"), F.col("n_events")), ratio(F.col("tp_seg"), F.col("n_segments"))
    ps, qs = ratio(F.col("both_s"), F.col("found_s")), ratio(F.col("both_s"), F.col("true_s"))
    return out.select(
        *Q, "n_events", "n_segments", "tp_evt", "tp_seg", "total_s", F.coalesce("hit", F.lit(False)).alias("hit"), "coverage",
        p.alias("precision_evt"), q.alias("recall_evt"), f1(p, q).alias("f1_evt"), ratio(F.col("tp_seg"), F.col("tp_seg") + fn + fp).alias("iou_evt"), noise_ratio(F.col("tp_evt"), fp).alias("snr_evt"),
        ps.alias("precision_sec"), qs.alias("recall_sec"), f1(ps, qs).alias("f1_sec"), ratio(F.col("both_s"), F.col("found_s") + F.col("true_s") - F.col("both_s")).alias("iou_sec"),
        noise_ratio(F.col("both_s"), F.col("found_s") - F.col("both_s")).alias("snr_sec"),
    )


MEASURES = ["coverage", "precision_evt", "recall_evt", "f1_evt", "iou_evt", "snr_evt", "precision_sec", "recall_sec", "f1_sec", "iou_sec", "snr_sec"]


def averaged(per_query: DataFrame, by: list[str]) -> DataFrame:
    """Means of the measures; infinite values are left out and counted."""
    finite = lambda m: F.when(F.col(m) < INF, F.col(m))
    return per_query.groupBy(*by).agg(
        F.count("*").alias("n_queries"), F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"), F.sum("total_s").cast("bigint").alias("total_s"),
        *(F.round(F.avg(finite(m)), 6).alias(m) for m in MEASURES), F.count_if(F.col("snr_evt") == INF).alias("inf_evt"), F.count_if(F.col("snr_sec") == INF).alias("inf_sec"),
    )
