"""Missing-value rules and the rolling-window rule that the function library shares.

NULL is the only missing value. A rolling result exists only when every row of its window has a
value. Functions marked "whole-series" also answer with the aggregate of the whole series when the
window is zero or covers the series; there NULLs are skipped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Agg = Callable[[Column], Column]


def col(x: Column | str | float | int) -> Column:
    """Column from a name, a number or a column."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def no_nan(x: Column) -> Column:
    """NaN becomes NULL."""
    return F.nanvl(x, F.lit(None).cast("double"))


def finite(x: Column) -> Column:
    """NaN and the infinities become NULL (apply once when data enters)."""
    return F.when(F.abs(no_nan(x)) < F.lit(float("inf")), x)


def ratio(a: Column | str | float, b: Column | str | float) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def truthy(c: Column | str | float) -> Column:
    """Condition reading of a number: zero is false, all else true, NULL included."""
    return F.coalesce(col(c) != 0, F.lit(True))


@dataclass(frozen=True)
class Axis:
    """Names of the columns that split a panel into ordered series."""

    key: str = "ts_code"
    order: str = "trade_date"

    @property
    def members(self):
        return Window.partitionBy(self.key)

    @property
    def whole(self):
        """All rows of the series. It states the order it does not need so that Spark plans it in
        the same Window operator, over the same sort, as the rolling frames."""
        return self.ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    @property
    def ordered(self):
        return Window.partitionBy(self.key).orderBy(self.order)

    @property
    def so_far(self):
        return self.ordered.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def onward(self):
        return self.ordered.rowsBetween(0, Window.unboundedFollowing)

    def last(self, n: int):
        return self.ordered.rowsBetween(1 - n, 0)


SERIES = Axis()


def by_series(df: DataFrame, on: Axis = SERIES) -> DataFrame:
    """The rows dealt by series over all ``spark.sql.shuffle.partitions`` partitions, for plans that sort series in several orders.

    Without a stated number AQE merges partitions up to a size of compressed bytes, and every sort of a task then holds many times that.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), on.key)


def strict_roll(agg: Agg, x: Column | str, w: int, on: Axis = SERIES) -> Column:
    """Rolling aggregate, NULL unless all ``w`` rows have a value."""
    x = col(x)
    frame = on.last(w)
    return F.when(F.count(x).over(frame) == w, agg(x).over(frame))


def roll(agg: Agg, x: Column | str, w: int, on: Axis = SERIES) -> Column:
    """Rolling aggregate with the whole-series answer for a zero or covering window."""
    x = col(x)
    if w <= 0:
        return agg(x).over(on.whole)
    covers = F.count(F.lit(1)).over(on.whole) <= w
    return F.when(covers, agg(x).over(on.whole)).otherwise(strict_roll(agg, x, w, on))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation aggregate over complete pairs; NULL without variance.

    The built-in ``corr`` raises on zero variance under ANSI mode.
    """
    x, y = col(x), col(y)
    px, py = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return ratio(F.covar_pop(x, y), F.stddev_pop(px) * F.stddev_pop(py))


def pairs(x: Column | str, y: Column | str) -> Column:
    """Number of complete pairs."""
    return F.count(F.when(col(x).isNotNull() & col(y).isNotNull(), 1))
