"""Column builders over ordered series. A window of n gives null until it holds n values, and
missing values are null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, Window as W, functions as F

KEY, SEQ = "pair", "seq"


def ordered(key: str = KEY, seq: str = SEQ):
    return W.partitionBy(key).orderBy(seq)


def trailing(n: int, key: str = KEY, seq: str = SEQ):
    return ordered(key, seq).rowsBetween(-(n - 1), 0)


def before(n: int, key: str = KEY, seq: str = SEQ):
    """The n rows before the current one."""
    return ordered(key, seq).rowsBetween(-n, -1)


def full(value: Column, x: Column, n: int, window, need: int | None = None) -> Column:
    return F.when(F.count(x).over(window) >= (n if need is None else need), value)


def lag(x: Column, n: int = 1, key: str = KEY, seq: str = SEQ) -> Column:
    return F.lag(x, n).over(ordered(key, seq))


def mean(x: Column, n: int, key: str = KEY, seq: str = SEQ, need: int | None = None) -> Column:
    w = trailing(n, key, seq)
    return full(F.avg(x).over(w), x, n, w, need)


def std(x: Column, n: int, key: str = KEY, seq: str = SEQ, need: int | None = None) -> Column:
    w = trailing(n, key, seq)
    return full(F.stddev_samp(x).over(w), x, n, w, need)


def total(x: Column, n: int, key: str = KEY, seq: str = SEQ) -> Column:
    w = trailing(n, key, seq)
    return full(F.sum(x).over(w), x, n, w)


def lowest(x: Column, n: int, key: str = KEY, seq: str = SEQ) -> Column:
    w = trailing(n, key, seq)
    return full(F.min(x).over(w), x, n, w)


def highest(x: Column, n: int, key: str = KEY, seq: str = SEQ) -> Column:
    w = trailing(n, key, seq)
    return full(F.max(x).over(w), x, n, w)


def median(x: Column, n: int, key: str = KEY, seq: str = SEQ) -> Column:
    w = trailing(n, key, seq)
    return full(F.percentile(x, 0.5).over(w), x, n, w)


def ratio_or_null(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0.0))


def zscore(x: Column, n: int, key: str = KEY, seq: str = SEQ) -> Column:
    return ratio_or_null(x - mean(x, n, key, seq), std(x, n, key, seq))


def change(x: Column, n: int = 1, key: str = KEY, seq: str = SEQ) -> Column:
    return ratio_or_null(x, lag(x, n, key, seq)) - 1


def next_bar(x: Column, key: str = KEY, seq: str = SEQ) -> Column:
    """A signal acts one bar after it shows; the first bar has none."""
    return F.coalesce(F.lag(F.coalesce(x, F.lit(False))).over(ordered(key, seq)), F.lit(False))
