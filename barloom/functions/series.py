"""Time-series steps, windows outside the named library, and two-series statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import SERIES, Axis, col, ratio
from .stats import highest, lowest

X = Column | str

hhv, llv = highest, lowest


def delay(x: X, p: int = 1, on: Axis = SERIES) -> Column:
    """Value ``p`` rows earlier; a negative ``p`` counts as 0."""
    return F.lag(col(x), max(p, 0)).over(on.ordered)


def delta(x: X, p: int = 1, on: Axis = SERIES) -> Column:
    """Relative change against ``p`` rows earlier; a nonzero value over a zero base gives 0."""
    x, past = col(x), delay(x, p, on)
    return F.when((past == 0) & (x != 0), F.lit(0.0)).otherwise(ratio(x - past, past))


def diff(x: X, p: int = 1, on: Axis = SERIES) -> Column:
    return col(x) - delay(x, p, on)


def fill_forward(x: X, on: Axis = SERIES) -> Column:
    return F.last(col(x), ignorenulls=True).over(on.so_far)


def fill_backward(x: X, on: Axis = SERIES) -> Column:
    """Looks ahead: use only for data repair, never for signals."""
    return F.first(col(x), ignorenulls=True).over(on.onward)


def pct_change(x: X, p: int = 1, on: Axis = SERIES) -> Column:
    return ratio(x, delay(x, p, on)) - 1


def running_max(x: X, on: Axis = SERIES) -> Column:
    return F.max(col(x)).over(on.so_far)


def running_product(x: X, on: Axis = SERIES) -> Column:
    return F.product(col(x)).over(on.so_far)


def clip(x: X, lo: float | None = None, hi: float | None = None) -> Column:
    x = col(x)
    out = x if lo is None else F.when(x < lo, F.lit(float(lo))).otherwise(x)
    return out if hi is None else F.when(x > hi, F.lit(float(hi))).otherwise(out)


def _pairwise(value: Column, x: Column, y: Column, w: int, on: Axis) -> Column:
    both = F.count(F.when(x.isNotNull() & y.isNotNull(), 1)).over(on.last(w))
    return F.when(both == w, value)


def corr(x: X, y: X, w: int = 20, on: Axis = SERIES) -> Column:
    """Rolling Pearson correlation; NULL without variance."""
    x, y = col(x), col(y)
    frame = on.last(w)
    spread = F.stddev_pop(x).over(frame) * F.stddev_pop(y).over(frame)
    return _pairwise(ratio(F.covar_pop(x, y).over(frame), spread), x, y, w, on)


def covariance(x: X, y: X, w: int = 20, on: Axis = SERIES) -> Column:
    x, y = col(x), col(y)
    return _pairwise(F.covar_samp(x, y).over(on.last(w)), x, y, w, on)


def beta(x: X, y: X, w: int = 20, on: Axis = SERIES) -> Column:
    """Slope of x on y; 0 where y does not vary."""
    x, y = col(x), col(y)
    slope = ratio(F.covar_samp(x, y).over(on.last(w)), F.var_samp(y).over(on.last(w)))
    return _pairwise(F.coalesce(slope, F.lit(0.0)), x, y, w, on)
