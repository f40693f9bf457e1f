"""Joins of spans that share a point, by buckets: an equi-join in place of a nested loop.

A span's level is the least k for which its length is below 4^k; at that level
it lies in one or two buckets of width 4^k.  Two spans meet at the higher of
their levels, so a row is filed at its own level and at those levels above it
that the other side has.  A pair that shares a point shares the bucket of the
later start, and is taken there alone, so nothing repeats.  Spans longer than
any level, rays among them, are filed in one bucket on top.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Levels have the widths 4^0 .. 4^31; the one on top holds everything.
TOP = 32


@dataclass(frozen=True)
class Side:
    """First and last point of a row's span, and a frame with all values they can have (for the levels)."""

    first: Column
    last: Column
    origin: DataFrame


def _width(k: int, kind) -> Column:
    return F.lit(4**k).cast(kind)


def _level(first: Column, last: Column, kind) -> Column:
    length = F.try_subtract(last, first)  # null where it overflows
    return F.coalesce(reduce(lambda a, b: a + b, [(length >= _width(k, kind)).cast("int") for k in range(TOP)]), F.lit(TOP))


def _bucket(point: Column, k: int, kind) -> Column:
    return F.lit(0).cast(kind) if k == TOP else (point - F.pmod(point, _width(k, kind))).cast(kind)


def levels(side: Side, kind) -> list[int]:
    """The levels that occur: at most 33 numbers."""
    return sorted(r[0] for r in side.origin.select(_level(side.first.cast(kind), side.last.cast(kind), kind)).distinct().collect())


def _filed(df: DataFrame, side: Side, own: list[int], other: list[int], prefix: str, kind) -> DataFrame:
    """A row for each bucket that ``df``'s rows are filed in: level, bucket, whether the level is the row's own, whether its first point is in the bucket."""
    first, last, level = side.first.cast(kind), side.last.cast(kind), F.col(f"{prefix}level")
    df = df.withColumn(f"{prefix}level", _level(first, last, kind))
    entries = []
    for k in sorted({*own, *other}):
        here = (level == k) if other[0] <= k else F.lit(False)
        if k in other:
            here |= level < k
        a, b = _bucket(first, k, kind), _bucket(last, k, kind)

        def entry(bucket, starts, k=k):
            return F.struct(F.lit(k).alias("at"), bucket.alias("bucket"), (level == k).alias("own"), F.lit(starts).alias("starts"))

        entries += [F.when(here, entry(a, True)), F.when(here & (a != b), entry(b, False))]
    df = df.withColumn(f"{prefix}in", F.explode(F.array_compact(F.array(*entries))))
    return df.select(*(c for c in df.columns if not c.startswith(prefix)), *(F.col(f"{prefix}in.{c}").alias(f"{prefix}{c}") for c in ("at", "bucket", "own", "starts")))


def overlap_join(left: DataFrame, right: DataFrame, a: Side, b: Side, on: Column) -> DataFrame:
    """Inner join of rows whose spans share a point and that meet ``on``; column names of the two are distinct."""
    kinds = [d.select(c).schema[0].dataType for d, c in ((left, a.first), (right, b.first))]
    kind = next((t for t in kinds if isinstance(t, T.DecimalType)), T.LongType())
    of_a, of_b = levels(a, kind), levels(b, kind)
    if not of_a or not of_b:  # one side is empty
        return left.join(right, on, "inner")
    left, right = _filed(left, a, of_a, of_b, "oa_", kind), _filed(right, b, of_b, of_a, "ob_", kind)
    later = F.when(a.first >= b.first, F.col("oa_starts")).otherwise(F.col("ob_starts"))
    met = (F.col("oa_at") == F.col("ob_at")) & (F.col("oa_bucket") == F.col("ob_bucket")) & (F.col("oa_own") | F.col("ob_own")) & later
    return left.join(right, met & on, "inner").drop(*(f"{p}{c}" for p in ("oa_", "ob_") for c in ("at", "bucket", "own", "starts")))


__all__ = ["TOP", "Side", "levels", "overlap_join"]
