"""Operators of the factor language as column builders.

Arithmetic that Spark already does alike (``+ - *`` and unary minus) needs no builder; these cover
the ones whose rules for missing values and zero divisors differ from SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import col, no_nan, or_zero, ratio, truthy

X = Column | str | float


def flag(cond: Column) -> Column:
    """Truth value as 1.0 / 0.0, unknown counting as false."""
    return F.coalesce(cond, F.lit(False)).cast("double")


def lit(value: float | bool | str) -> Column:
    """Literal; booleans are numbers in the factor language."""
    return F.lit(float(value)) if isinstance(value, (bool, int, float)) else F.lit(value)


def add(a: X, b: X) -> Column:
    return col(a) + col(b)


def sub(a: X, b: X) -> Column:
    return col(a) - col(b)


def mul(a: X, b: X) -> Column:
    return col(a) * col(b)


def div(a: X, b: X) -> Column:
    """Quotient; a zero divisor or a missing operand gives 0."""
    return or_zero(ratio(a, b))


def mod(a: X, b: X) -> Column:
    """Remainder with the divisor's sign, NULL for a zero divisor."""
    return col(a) - col(b) * F.floor(ratio(a, b))


def power(a: X, b: X) -> Column:
    return no_nan(F.pow(col(a), col(b)))


def gt(a: X, b: X) -> Column:
    return flag(col(a) > col(b))


def ge(a: X, b: X) -> Column:
    return flag(col(a) >= col(b))


def lt(a: X, b: X) -> Column:
    return flag(col(a) < col(b))


def le(a: X, b: X) -> Column:
    return flag(col(a) <= col(b))


def eq(a: X, b: X) -> Column:
    return flag(col(a) == col(b))


def ne(a: X, b: X) -> Column:
    """Differs; a missing operand differs from everything."""
    return F.coalesce(col(a) != col(b), F.lit(True)).cast("double")


def both(a: X, b: X) -> Column:
    return (truthy(a) & truthy(b)).cast("double")


def either(a: X, b: X) -> Column:
    return (truthy(a) | truthy(b)).cast("double")


def negate(a: X) -> Column:
    return (~truthy(a)).cast("double")


def choose(cond: X, then: X, otherwise: X | None = None) -> Column:
    """IF / ternary; without an else branch the answer is NULL."""
    picked = F.when(truthy(cond), col(then))
    return picked if otherwise is None else picked.otherwise(col(otherwise))


def factor_table(df: DataFrame, factors: dict[str, Column], keys: tuple[str, ...] = ("trade_date", "ts_code")) -> DataFrame:
    """Evaluate many expressions in one projection, so they share one exchange and one sort."""
    return df.select(*keys, *(c.alias(name) for name, c in factors.items()))
