"""Time text: clock strings, time references, frame and display arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds_of(text: Column) -> Column:
    """Seconds of ``S``, ``M:S`` or ``H:M:S`` split at ``:`` and ``.``; only digit parts count, and of more
    than three the first three (so ``29:32.120`` is 29 h 32 min 120 s). Null without a digit part."""
    p = F.filter(F.transform(F.split(F.trim(text), "[:.]"), lambda x: F.trim(x)), lambda x: x.rlike("^[0-9]+$"))
    # the parts are bound once: an empty list of them has no sum
    some = F.filter(F.array(F.slice(p, 1, 3)), lambda x: F.size(x) > 0)
    return F.get(F.transform(some, lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda s, y: s * 60 + y.cast("bigint"))), F.lit(0))


def segments_of(ref: Column) -> Column:
    """``array<struct<gs, ge, point>>`` of a time reference: ``a-b`` (an empty side copies the other),
    a comma list of points, or a point; a point lasts one second. Null for N/A, empty, None and inverted
    or unreadable references; an equal pair stays empty (C6/C9)."""
    t = F.trim(ref)
    bad = t.isNull() | t.isin("", "N/A", "None", "None-None")
    a, b = F.trim(F.get(F.split(t, "-", 2), F.lit(0))), F.trim(F.get(F.split(t, "-", 2), F.lit(1)))
    lo, hi = seconds_of(F.when(a == "", b).otherwise(a)), seconds_of(F.when(b == "", a).otherwise(b))
    one = lambda s, e, p: F.struct(s.alias("gs"), e.alias("ge"), F.lit(p).alias("point"))
    span = F.filter(F.array(one(lo, hi, False)), lambda z: z["ge"] >= z["gs"])
    listed = F.transform(F.filter(F.transform(F.split(t, ","), seconds_of), lambda x: x.isNotNull()), lambda x: one(x, x + 1, True))
    got = F.when(bad, None).when(t.contains("-"), span).otherwise(listed)
    return F.get(F.filter(F.array(got), lambda x: F.size(x) > 0), F.lit(0))


def valid_reference(ref: Column) -> Column:
    """A reference that an evaluation counts: not a word for none, both sides of a range there, and every
    time in it readable."""
    t = F.trim(ref)
    sides = F.split(t, "-", 2)
    there = lambda x: ~F.trim(x).isin("", "None") & seconds_of(x).isNotNull()
    points = F.filter(F.split(t, ","), lambda x: F.trim(x) != "")
    ok = F.when(t.contains("-"), F.forall(sides, there)).otherwise((F.size(points) > 0) & F.forall(points, lambda x: seconds_of(x).isNotNull()))
    return F.coalesce(~t.isin("", "N/A", "None", "None-None") & ok, F.lit(False))


def hms(seconds: Column) -> Column:
    s = F.floor(seconds).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("bigint"), F.floor(s % 3600 / 60).cast("bigint"), s % 60)


def linspace_ints(n: Column, k: int) -> Column:
    """Indices of ``k`` of ``n`` rows, evenly spread, both ends included (all if ``k >= n``); the last is
    pinned to ``n - 1``."""
    step = (n - 1).cast("double") / F.lit(float(max(k - 1, 1)))
    some = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.when(i == k - 1, n - 1).otherwise(F.floor(i * step).cast("bigint"))) if k > 1 else F.array(F.lit(0).cast("bigint"))
    return F.when(n <= 0, F.array().cast("array<bigint>")).when(n <= k, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(some)


def clock_seconds(text: Column) -> Column:
    """First clock time of a text in seconds of the day; with PM anywhere in the text hours 1 to 11 are of the
    afternoon, with AM hour 12 is 0. Null if there is none, or if the text is ``none``."""
    pat = r"(\d{1,2}):(\d{1,2})(?::(\d{1,2}))?"
    g = lambda i: F.regexp_extract(text, pat, i).try_cast("bigint")
    h, low = g(1), F.lower(text)
    hour = F.when(low.contains("pm"), F.when(h.between(1, 11), h + 12).otherwise(h)).when(low.contains("am") & (h == 12), F.lit(0)).otherwise(h)
    return hour * 3600 + g(2) * 60 + F.coalesce(g(3), F.lit(0))
