"""Lengths of intervals.  A ray has none: its measure is null, and null is the third truth value of a condition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from relspark.types import Interval, ray_end

WIDE = "decimal(20,0)"


def measure(start: Column, end: Column, t: Interval) -> Column:
    """end - start without overflow; null for a ray."""
    length = (end.cast(WIDE) - start.cast(WIDE)).cast(WIDE)
    return length if t.width is not None else F.when(end < F.lit(ray_end(t)), length)


def checked_sum(value: Column, signed: bool) -> Column:
    """The exact sum; out of the type's range the cast to it fails when it is read."""
    total = F.sum(value.cast(WIDE))
    return total.cast("bigint") if signed else total
