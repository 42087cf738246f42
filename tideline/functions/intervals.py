"""Named interval conventions and scalar interval expressions.

The rules differ on purpose between operators and are kept apart by name. Arguments are columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlaps_closed(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intervals that share at least an end point."""
    return (s1 <= e2) & (e1 >= s2)


def overlaps_strict(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intervals that share more than a point."""
    return F.greatest(s1, s2) < F.least(e1, e2)


def holds_half_open(s: Column, e: Column, t: Column) -> Column:
    """C4: a point in ``[s, e)``."""
    return (s <= t) & (t < e)


def holds_closed(s: Column, e: Column, t: Column) -> Column:
    """A point in ``[s, e]``."""
    return (s <= t) & (t <= e)


def truncated_ends(s: Column, e: Column) -> tuple[Column, Column]:
    """Both ends cut to whole seconds; an interval that becomes empty lasts one second."""
    a, b = s.cast("bigint"), e.cast("bigint")
    return a, F.when(b <= a, a + 1).otherwise(b)


def hull_iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Shared length over the length of the common hull (not of the union)."""
    shared = F.greatest(F.lit(0.0), F.least(e1, e2) - F.greatest(s1, s2))
    return shared / F.greatest(F.lit(1e-9), F.greatest(e1, e2) - F.least(s1, s2))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r <= 0, F.lit(0.0)).otherwise(F.try_divide(2 * p * r, p + r))
