"""Frame arithmetic: which frames stand for an interval, a list of intervals or a timeline. All are columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def frame_at(second: Column, fps: Column) -> Column:
    """Frame of a second, at a rate that need not be whole."""
    return F.floor(second * fps).cast("bigint")


def at_rate(s: Column, e: Column, fps: Column, target: float) -> Column:
    """frames from ``s`` up to before ``e``, every int(fps / target)-th; an instant has one frame."""
    lo, hi = frame_at(s, fps), frame_at(e, fps)
    step = F.greatest(F.lit(1), F.floor(fps / target)).cast("bigint")
    return F.when(s == e, F.array(lo)).when(lo < hi, F.sequence(lo, hi - 1, step)).otherwise(F.array().cast("array<bigint>"))


def instants(s: Column, e: Column, n: Column) -> Column:
    """``n`` instants of an interval: its middle, both ends, or evenly spaced with both ends. An instant
    is widened by one second first."""
    e = F.when(s == e, e + 1).otherwise(e)
    spread = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(2)).cast("int") - 1), lambda i: s + i * (e - s) / (F.greatest(n, F.lit(2)) - 1))
    return F.when(n == 1, F.array((s + e) / 2)).otherwise(spread)


def per_seconds(s: Column, e: Column, seconds: float) -> Column:
    """number of frames of an interval at one per ``seconds``, at least one."""
    return F.greatest(F.lit(1), F.ceil((e - s) / seconds)).cast("bigint")


def video_second(display: Column, ref_video: Column, ref_display: Column, jump_after: Column | None = None, jump_video: Column | None = None, jump_display: Column | None = None, wraps: Column | None = None) -> Column:
    """second of a video at which its clock shows ``display`` (seconds of the day), not before 0.

    A reference pair tells what the clock shows at one second. If the clock jumps, times after
    ``jump_after`` have a pair of their own (nulls: no jump). Where the clock goes over midnight
    (``wraps``), a time of the first half of the day after a reference of the second half is of the next day."""
    if jump_after is not None:
        later = jump_after.isNotNull() & (display > jump_after)
        ref_video, ref_display = F.when(later, jump_video).otherwise(ref_video), F.when(later, jump_display).otherwise(ref_display)
    half, day = 12 * 3600, 24 * 3600
    if wraps is not None:
        display = F.when(wraps & (ref_display > half) & (display < half), display + day).otherwise(display)
    return F.greatest(F.lit(0), (ref_video + display - ref_display).cast("bigint")).cast("bigint")


def normalised_box(box: Column, width: Column, height: Column) -> Column:
    """(x0, y0, x1, y1) on a scale of 0 to 1000."""
    at = lambda i, size: F.round(F.get(box, F.lit(i)) * 1000.0 / size).cast("bigint")
    return F.array(at(0, width), at(1, height), at(2, width), at(3, height))


def clamped_box(box: Column, width: Column, height: Column) -> Column:
    """F16: a box cut to the picture; null if nothing of it is left."""
    at = lambda i, size: F.greatest(F.lit(0.0), F.least(size.cast("double"), F.get(box, F.lit(i))))
    out = F.array(at(0, width), at(1, height), at(2, width), at(3, height))
    return F.when((at(2, width) > at(0, width)) & (at(3, height) > at(1, height)), out)
