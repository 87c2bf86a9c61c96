"""Technical indicators that windows can express. The order-recursive ones are in
``barloom.operators.recursive``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import SERIES, Axis, col, or_zero, ratio, strict_roll
from .stats import rolling_mean

X = Column | str

ma = rolling_mean


def wma(x: X, w: int = 10, on: Axis = SERIES) -> Column:
    """Linearly weighted average, newest row heaviest; a NULL counts as 0."""
    x = or_zero(col(x))
    weighted = sum((or_zero(F.lag(x, i).over(on.ordered)) * (w - i) for i in range(1, w)), x * w)
    return F.when(F.row_number().over(on.ordered) >= w, weighted / (w * (w + 1) / 2))


def boll(x: X, w: int = 20, k: float = 2.0, on: Axis = SERIES) -> Column:
    """Upper Bollinger band."""
    return strict_roll(F.avg, x, w, on) + k * strict_roll(F.stddev_samp, x, w, on)


def true_range(high: X, low: X, close: X, on: Axis = SERIES) -> Column:
    """Largest of the day's span and its distances from the previous close; NULL on the first row."""
    h, l, prev = col(high), col(low), F.lag(col(close), 1).over(on.ordered)
    known = h.isNotNull() & l.isNotNull() & prev.isNotNull()
    return F.when(known, F.greatest(h - l, F.abs(h - prev), F.abs(l - prev)))


def atr_of(tr: X, w: int = 14, on: Axis = SERIES) -> Column:
    """Mean true range from a true-range column (a window cannot nest in a window)."""
    return strict_roll(F.avg, tr, w, on)


def natr_of(tr: X, close: X, w: int = 14, on: Axis = SERIES) -> Column:
    return ratio(atr_of(tr, w, on), close) * 100


def obv_step(close: X, volume: X, on: Axis = SERIES) -> Column:
    """Signed volume of one row; on-balance volume is its running sum."""
    first = F.row_number().over(on.ordered) == 1
    move = F.signum(col(close) - F.lag(col(close), 1).over(on.ordered))
    return F.when(first, col(volume)).otherwise(or_zero(move) * col(volume))


def obv_of(step: X, on: Axis = SERIES) -> Column:
    return F.sum(col(step)).over(on.so_far)
