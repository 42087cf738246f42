"""Tracked objects: histories from detections, statistics, clipping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(detections: DataFrame, keys: list[str], lo: int | None = None, hi: int | None = None) -> DataFrame:
    """Histories of each track from detections (keys, frame, event_id), limited to frames ``lo..hi`` first;
    tracks without a frame there have no row. Event ids are distinct, in order of first frame."""
    d = detections if lo is None else detections.where(F.col("frame").between(lo, hi))
    ev = F.array_distinct(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("frame", "event_id"))), lambda x: x["event_id"]), lambda x: x.isNotNull()))
    return d.groupBy(*keys).agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("frame").alias("total_frames"), F.array_sort(F.collect_list("frame")).alias("frames"), ev.alias("event_ids"))


def clipped(frames, lo, hi):
    """Frames of a history in a window; the whole history if none is in it."""
    got = F.filter(frames, lambda x: x.between(lo, hi))
    return F.when(F.size(got) == 0, frames).otherwise(got)


def frame_filter(frame, lo, hi):
    """Frame numbers of a closed range."""
    return frame.between(lo, hi)
