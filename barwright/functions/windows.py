"""Window expressions over one symbol's ordered bars.

Warm-up is NULL, never NaN: Spark orders NaN above all numbers, so a NaN would pass `> threshold`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Fixed value: the spacing of doubles at 1, used where a divisor may be zero.
EPS = 2.220446049250313e-16


def order():
    return Window.partitionBy("sym").orderBy("bar_ts")


def whole():
    return Window.partitionBy("sym")


def past():
    return order().rowsBetween(Window.unboundedPreceding, 0)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rolling(fn: Callable[[Column], Column], c: str | Column, n: int) -> Column:
    """fn over the last n bars; NULL until n values that aren't NULL are there."""
    w = order().rowsBetween(-(n - 1), 0)
    return F.when(F.count(col(c)).over(w) == n, fn(col(c)).over(w))


def mean(c: str | Column, n: int) -> Column:
    return rolling(F.avg, c, n)


def sd(c: str | Column, n: int) -> Column:
    return rolling(F.stddev_samp, c, n)


def low(c: str | Column, n: int) -> Column:
    return rolling(F.min, c, n)


def high(c: str | Column, n: int) -> Column:
    return rolling(F.max, c, n)


def lag(c: str | Column, n: int = 1) -> Column:
    return F.lag(col(c), n).over(order())


def running(c: str | Column) -> Column:
    return F.sum(col(c)).over(past())


def mean_abs_dev(c: str, n: int) -> Column:
    """Mean distance from the mean, over the last n bars."""
    w = order().rowsBetween(-(n - 1), 0)

    def dev(xs: Column) -> Column:
        return F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.abs(x - F.avg(c).over(w))) / n

    return F.when(F.count(c).over(w) == n, dev(F.collect_list(c).over(w)))


def last_value_ewm(xs: Column, span: int) -> Column:
    """The exponentially weighted mean (first value as start) at the end of an array."""
    a = 2.0 / (span + 1)
    return F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), F.element_at(xs, 1), lambda acc, x: F.lit(a) * x + F.lit(1 - a) * acc)


def clamp(score: Column) -> Column:
    """Score into [-1, 1]; NULL and NaN become 0."""
    return F.coalesce(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.nanvl(score, F.lit(None).cast("double")))), F.lit(0.0))


def steady(c: Column) -> Column:
    """Rounded so that the last bits of a sum don't decide a threshold."""
    return F.round(c, 8)
