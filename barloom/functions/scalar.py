"""Row-wise math, conditions and financial ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import SERIES, Axis, col, no_nan, ratio, truthy

X = Column | str

# Fixed value: the floor that stands in for arguments a logarithm cannot take.
LOG_FLOOR = 1e-10


def absolute(x: X) -> Column:
    return F.abs(col(x))


def sign(x: X) -> Column:
    return F.signum(col(x))


def log(x: X) -> Column:
    """Natural logarithm; missing or non-positive arguments count as the floor."""
    x = col(x)
    return F.log(F.when(x > 0, x).otherwise(F.lit(LOG_FLOOR)))


def log10(x: X) -> Column:
    x = col(x)
    return F.log10(F.when(x > 0, x).otherwise(F.lit(LOG_FLOOR)))


def exp(x: X) -> Column:
    return F.exp(col(x))


def sqrt(x: X) -> Column:
    """Square root; missing or negative arguments count as 0."""
    x = col(x)
    return F.sqrt(F.when(x >= 0, x).otherwise(F.lit(0.0)))


def power(x: X, p: float = 2.0) -> Column:
    return no_nan(F.pow(col(x), F.lit(float(p))))


def sign_pow(x: X, p: float = 0.5) -> Column:
    """Power of the size, keeping the sign."""
    return F.signum(col(x)) * F.pow(F.abs(col(x)), F.lit(float(p)))


def when(cond: X, then: X | float, otherwise: X | float = 0.0) -> Column:
    return F.when(truthy(cond), col(then)).otherwise(col(otherwise))


def keep_between(x: X, low: float | None = None, high: float | None = None) -> Column:
    """Values outside the given bounds become NULL."""
    x = col(x)
    ok = x.isNotNull()
    if low is not None:
        ok = ok & (x >= low)
    if high is not None:
        ok = ok & (x <= high)
    return F.when(ok, x)


def keep_every(x: X, n: int = 1, on: Axis = SERIES) -> Column:
    """Keep rows 0, n, 2n, ... of the series, NULL elsewhere."""
    return F.when((F.row_number().over(on.ordered) - 1) % n == 0, col(x))


def leverage(debt: X, equity: X) -> Column:
    return ratio(debt, equity)


def debt_ratio(debt: X, assets: X) -> Column:
    return ratio(debt, assets)


def growth(x: X, p: int = 4, on: Axis = SERIES) -> Column:
    """Change against the same quarter a year ago."""
    return ratio(x, F.lag(col(x), p).over(on.ordered)) - 1


def roic(profit: X, capital: X) -> Column:
    return ratio(profit, capital)
