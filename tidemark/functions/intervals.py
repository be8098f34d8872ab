"""Joins of points and ranges by equal bins instead of a nested loop.

The line of points is cut into bins of ``width``. A point lies in one bin; a range is listed once for each bin that it
touches. Both meet by an equality join on keys and bin, which Spark can hash, sort or broadcast, and the exact test
comes after. A range of length n is listed n / width + 2 times at most, and a point meets no range that
ends more than a bin away: choose ``width`` near the usual length of a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

_BIN = "_bin"


def bin_of(x: Column, width: int) -> Column:
    return F.floor(x / F.lit(float(width))).cast("long")


def range_join(points: DataFrame, ranges: DataFrame, point: Column, low: Column, high: Column, width: int, on: Sequence[str] = ()) -> DataFrame:
    """Every point with every range low <= point <= high of its keys ``on``; null ends and points match nothing.

    ``point`` is a whole-numbered expression of ``points``, ``low`` and ``high`` of ``ranges``; the tables share no
    column names but the keys.
    """
    if width < 1:
        raise ValueError("a bin is one wide at least")
    placed = points.withColumn("_at", point.cast("long")).withColumn(_BIN, bin_of(F.col("_at"), width))
    ends = ranges.withColumn("_low", low.cast("long")).withColumn("_high", high.cast("long")).filter("_low <= _high")
    listed = ends.withColumn(_BIN, F.explode(F.sequence(bin_of(F.col("_low"), width), bin_of(F.col("_high"), width))))
    met = placed.join(listed, [*on, _BIN]).filter((F.col("_at") >= F.col("_low")) & (F.col("_at") <= F.col("_high")))
    return met.drop(_BIN, "_at", "_low", "_high")


def day_number(day: Column) -> Column:
    return F.unix_date(day.cast("date"))
