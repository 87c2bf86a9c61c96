"""Statistics, ranking and standardisation over one series (whole-series rule of ``roll``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import SERIES, Axis, col, or_zero, ratio, roll, strict_roll

X = Column | str


def mean(x: X, w: int = 0, on: Axis = SERIES) -> Column:
    return roll(F.avg, x, w, on)


def std(x: X, w: int = 0, on: Axis = SERIES) -> Column:
    return roll(F.stddev_samp, x, w, on)


def var(x: X, w: int = 0, on: Axis = SERIES) -> Column:
    return roll(F.var_samp, x, w, on)


def highest(x: X, w: int = 0, on: Axis = SERIES) -> Column:
    return roll(F.max, x, w, on)


def lowest(x: X, w: int = 0, on: Axis = SERIES) -> Column:
    return roll(F.min, x, w, on)


def total(x: X, w: int = 0, on: Axis = SERIES) -> Column:
    """Sum; a whole series without values sums to 0."""
    return or_zero(F.sum(col(x)).over(on.whole)) if w <= 0 else roll(F.sum, x, w, on)


def count(x: X, w: int = 0, on: Axis = SERIES) -> Column:
    return roll(F.count, x, w, on).cast("double")


def median(x: X, w: int = 0, on: Axis = SERIES) -> Column:
    return percentile(x, 50.0, w, on)


def product(x: X, w: int = 0, on: Axis = SERIES) -> Column:
    return roll(F.product, x, w, on)


def percentile(x: X, pct: float, w: int = 0, on: Axis = SERIES) -> Column:
    """Linearly interpolated percentile, ``pct`` in 0..100."""
    return roll(lambda c: F.percentile(c, pct / 100.0), x, w, on)


def rank(x: X, w: int = 0, ascending: bool = True, on: Axis = SERIES) -> Column:
    """Ordinal rank divided by the row count; ties by order, NULLs last.

    With a window: the rank of the window's last row, which comes last among its equals.
    """
    x = col(x)
    n = F.count(F.lit(1)).over(on.whole)
    by = x.asc_nulls_last() if ascending else x.desc_nulls_last()
    overall = F.row_number().over(on.members.orderBy(by, on.order)) / n
    if w <= 0:
        return overall
    inside = lambda v: (v <= x) if ascending else (v >= x)
    frame = on.last(w)
    rolling = F.when(F.count(x).over(frame) == w, F.size(F.filter(F.collect_list(x).over(frame), inside)) / w)
    return F.when(n <= w, overall).otherwise(rolling)


def dense_rank(x: X, w: int = 0, on: Axis = SERIES) -> Column:
    x = col(x)
    overall = F.dense_rank().over(on.members.orderBy(x.asc_nulls_last())).cast("double")
    if w <= 0:
        return overall
    frame = on.last(w)
    seen = F.array_distinct(F.filter(F.collect_list(x).over(frame), lambda v: v <= x))
    rolling = F.when(F.count(x).over(frame) == w, F.size(seen).cast("double"))
    return F.when(F.count(F.lit(1)).over(on.whole) <= w, overall).otherwise(rolling)


def zscore(x: X, w: int = 0, on: Axis = SERIES) -> Column:
    """Distance from the mean in standard deviations; undefined gives 0."""
    return or_zero(ratio(col(x) - mean(x, w, on), std(x, w, on)))


def scale(x: X, a: float = 1.0, b: float = 0.0, on: Axis = SERIES) -> Column:
    """Map the series linearly onto [b, b+a]; a constant series maps to the middle."""
    x = col(x)
    lo, hi = F.min(x).over(on.whole), F.max(x).over(on.whole)
    return F.when(hi == lo, F.lit(b + a / 2)).otherwise(a * ratio(x - lo, hi - lo) + b)


def expanding(agg, x: X, at_least: int, on: Axis = SERIES) -> Column:
    """Aggregate of all values so far, NULL before ``at_least`` of them."""
    x = col(x)
    return F.when(F.count(x).over(on.so_far) >= at_least, agg(x).over(on.so_far))


def rolling_mean(x: X, w: int = 5, on: Axis = SERIES) -> Column:
    """Moving average without the whole-series rule."""
    return strict_roll(F.avg, x, w, on)
