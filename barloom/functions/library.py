"""Name -> builder tables of the factor functions, open to user functions.

Most functions are one column expression (``call``). Two-step windows, recursions and cross-sections
work on a table. ``add`` evaluates a function of either kind and adds its result as a column.

A user function is any Python callable that returns a ``Column``; row logic that columns cannot
express goes in as a ``pandas_udf``.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from barloom.operators.recursive import KINDS, Recursive, with_recursive

from . import indicators, scalar, section, series, stats
from .core import SERIES, Axis


class UnknownFunction(KeyError):
    """The name is in neither table."""


class FunctionLibrary:
    """Case-insensitive function names."""

    def __init__(self) -> None:
        self._columns: dict[str, Callable[..., Column]] = dict(COLUMN_FUNCTIONS)
        self._tables: dict[str, Callable[..., DataFrame]] = dict(TABLE_FUNCTIONS)

    def register(self, name: str, func: Callable[..., Column]) -> None:
        self._columns[name.upper()] = func

    def has(self, name: str) -> bool:
        return name.upper() in self._columns or name.upper() in self._tables

    def names(self) -> list[str]:
        return sorted({*self._columns, *self._tables})

    def call(self, name: str, *args, **kwargs) -> Column:
        """Build the column of a function."""
        if name.upper() not in self._columns:
            hint = ": use add(), it works on a table" if name.upper() in self._tables else ""
            raise UnknownFunction(f"no column function {name}{hint}")
        return self._columns[name.upper()](*args, **kwargs)

    def add(self, df: DataFrame, out: str, name: str, *args, on: Axis = SERIES) -> DataFrame:
        """The table with the function's result in column ``out``."""
        if name.upper() in self._tables:
            return self._tables[name.upper()](df, out, *args, on=on)
        func = self._columns.get(name.upper())
        if func is None:
            raise UnknownFunction(f"no function {name}")
        along = {"on": on} if "on" in inspect.signature(func).parameters else {}
        return df.withColumn(out, func(*args, **along))


def _atr(df: DataFrame, out: str, high: str, low: str, close: str, w: int = 14, on: Axis = SERIES) -> DataFrame:
    spans = df.withColumn("_tr", indicators.true_range(high, low, close, on))
    return spans.withColumn(out, indicators.atr_of("_tr", w, on)).drop("_tr")


def _natr(df: DataFrame, out: str, high: str, low: str, close: str, w: int = 14, on: Axis = SERIES) -> DataFrame:
    spans = df.withColumn("_tr", indicators.true_range(high, low, close, on))
    return spans.withColumn(out, indicators.natr_of("_tr", close, w, on)).drop("_tr")


def _obv(df: DataFrame, out: str, close: str, volume: str, on: Axis = SERIES) -> DataFrame:
    steps = df.withColumn("_step", indicators.obv_step(close, volume, on))
    return steps.withColumn(out, indicators.obv_of("_step", on)).drop("_step")


def _recursion(kind: str) -> Callable[..., DataFrame]:
    names = [n for n in inspect.signature(KINDS[kind]).parameters if n not in ("df", "pdf", "out", "on")]

    def add(df: DataFrame, out: str, *args, on: Axis = SERIES) -> DataFrame:
        return with_recursive(df, [Recursive(kind, out, dict(zip(names, args)))], on)

    return add


def _section(func: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    def add(df: DataFrame, out: str, value: str, *args, on: Axis = SERIES) -> DataFrame:
        return func(df, value, out, *args, by=[on.order])

    return add


COLUMN_FUNCTIONS: dict[str, Callable[..., Column]] = {
    "MEAN": stats.mean, "STD": stats.std, "VAR": stats.var, "MAX": stats.highest, "MIN": stats.lowest,
    "SUM": stats.total, "COUNT": stats.count, "MEDIAN": stats.median, "PRODUCT": stats.product,
    "RANK": stats.rank, "ZSCORE": stats.zscore, "SCALE": stats.scale, "DENSE_RANK": stats.dense_rank,
    "PERCENTILE": stats.percentile,
    "DELTA": series.delta, "DELAY": series.delay, "DIFF": series.diff, "HHV": series.hhv, "LLV": series.llv,
    "FORWARD": series.fill_forward, "BACKWARD": series.fill_backward,
    "MA": indicators.ma, "WMA": indicators.wma, "BOLL": indicators.boll,
    "CORR": series.corr, "COVARIANCE": series.covariance, "BETA": series.beta,
    "ABS": scalar.absolute, "SIGN": scalar.sign, "LOG": scalar.log, "LOG10": scalar.log10, "EXP": scalar.exp,
    "SQRT": scalar.sqrt, "POWER": scalar.power, "SIGN_POW": scalar.sign_pow,
    "CS_ABS": scalar.absolute,
    "WHEN": scalar.when, "FILTER": scalar.keep_between, "KEEP": scalar.keep_every,
    "LEVERAGE": scalar.leverage, "DEBT_RATIO": scalar.debt_ratio, "GROWTH": scalar.growth, "ROIC": scalar.roic,
}

TABLE_FUNCTIONS: dict[str, Callable[..., DataFrame]] = {
    "ATR": _atr, "NATR": _natr, "OBV": _obv,
    **{kind: _recursion(kind) for kind in KINDS},
    "CS_RANK": _section(section.ordinal_rank), "CS_ZSCORE": _section(section.zscore),
    "CS_SCALE": _section(section.scale), "CS_MEDIAN": _section(section.demedian),
}
