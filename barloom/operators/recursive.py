"""Order-recursive indicators: each value needs the one before, which no window frame offers.

EMA, MACD, RSI and KDJ are affine recursions e(i) = scale(i) * e(i - 1) + shift(i). A series is cut into blocks of so many rows that the product
of a block's scales is tiny but far from the end of the doubles. Inside a block the recursion is a running sum of shifts divided by
the running product of scales; what a block carries into the next one is its last value, as its own carry has shrunk below
a double's precision by then. So a scan is a few window sums over one exchange by series, in the JVM, and no list of a series is ever built.

SAR is a state machine without such a form: it is walked in ``applyInPandas``, one call per series. A group is one security's bars: after bars
are aggregated to one row per date it cannot outgrow the trading calendar.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from barloom.functions.core import SERIES, Axis, by_series, no_nan, ratio

_REACH = 230.0  # a block's scales multiply to at least exp(-_REACH)
_FLOOR = -300.0  # logarithm that stands for a scale of (nearly) 0


@dataclass(frozen=True)
class Recursive:
    """One requested indicator: kind, output name, parameters (column names and numbers)."""

    kind: str
    out: str
    args: dict = field(default_factory=dict)


def block_rows(decay: float) -> int:
    """Rows of a block for scales of at least ``decay``: a power of four, so that scans of about the same decay share their sorting."""
    most = _REACH / -math.log(decay) if 0.0 < decay < 1.0 else _REACH
    return 4 ** max(0, int(math.log(max(most, 1.0), 4)))


def _placed(df: DataFrame, decay: float, on: Axis) -> tuple[DataFrame, WindowSpec, str]:
    """The rows with their number and block, the series' order stated as (block, order), and the block's name.

    All windows of a scan then need the one sort by (series, block, order).
    """
    block = f"_b{block_rows(decay)}"
    rows = df if "_row" in df.columns else df.withColumn("_row", F.row_number().over(on.ordered))
    if block not in rows.columns:
        rows = rows.withColumn(block, F.floor((F.col("_row") - 1) / block_rows(decay)))
    return rows, Window.partitionBy(on.key).orderBy(block, on.order), block


def affine_scan(df: DataFrame, out: str, scale: Column, shift: Column, decay: float, on: Axis = SERIES) -> DataFrame:
    """Add e(i) = scale(i) * e(i - 1) + shift(i), with e = 0 before the first row of a series.

    Scales lie in [0, 1]; ``decay`` is a lower bound of most of them and sets the length of the blocks. It may be missed by single rows
    (a gap, a restart with scale 0), not by most. Neither may be NULL.
    """
    product, total, own = f"_q_{out}", f"_s_{out}", f"_l_{out}"
    rows, _, block = _placed(df, decay, on)
    inside = Window.partitionBy(on.key, block).orderBy(on.order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(on.key).orderBy(block).rangeBetween(-1, -1)
    rows = rows.withColumn(product, F.sum(F.greatest(F.log(scale), F.lit(_FLOOR))).over(inside))
    rows = rows.withColumn(total, F.sum(shift * F.exp(-F.col(product))).over(inside))
    rows = rows.withColumn(own, F.exp(product) * F.col(total))
    carry = F.coalesce(F.max_by(own, "_row").over(before), F.lit(0.0))
    return rows.withColumn(out, F.exp(product) * (F.col(total) + carry)).drop(product, total, own)


def _average(df: DataFrame, x: str, out: str, a: float, on: Axis) -> DataFrame:
    """Exponential average with weight 1 - ``a`` for the newest value, seeded with the first one. A missing value repeats the
    average, and what lies before it goes on losing weight."""
    if a <= 0.0:
        return df.withColumn(out, F.last(no_nan(F.col(x)), ignorenulls=True).over(on.so_far))
    v = no_nan(F.col(x).cast("double"))
    rows, ordered, _ = _placed(df, a, on)
    seen = F.max(F.when(v.isNotNull(), F.col("_row"))).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_seen", seen).withColumn("_old", F.pow(F.lit(a), F.col("_row") - F.col("_seen")))
    whole = F.col("_old") + (1.0 - a)
    scale = F.when(v.isNull() | F.col("_seen").isNull(), 1.0).otherwise(F.col("_old") / whole)
    shift = F.when(v.isNull(), 0.0).when(F.col("_seen").isNull(), v).otherwise((1.0 - a) * v / whole)
    rows = affine_scan(rows, out, scale, shift, a, on)
    started = v.isNotNull() | F.col("_seen").isNotNull()
    return rows.withColumn(out, F.when(started, F.col(out))).drop("_seen", "_old")


def ema(df: DataFrame, out: str, on: Axis = SERIES, x: str = "close", w: int = 12) -> DataFrame:
    """Exponential average seeded with the first value."""
    return _average(df, x, out, (w - 1.0) / (w + 1.0), on)


def macd(df: DataFrame, out: str, on: Axis = SERIES, x: str = "close", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Signal line: average of the difference of a fast and a slow average."""
    rows = ema(ema(df, "_fast", on, x, fast), "_slow", on, x, slow).withColumn("_dif", F.col("_fast") - F.col("_slow"))
    return ema(rows, out, on, "_dif", signal).drop("_fast", "_slow", "_dif")


def rsi(df: DataFrame, out: str, on: Axis = SERIES, x: str = "close", w: int = 14) -> DataFrame:
    """Relative strength; without losses the strength counts as 100. NULL for a shorter series."""
    v = no_nan(F.col(x).cast("double"))
    place, smooth = F.col("_row"), 1.0 - 1.0 / w
    rows, ordered, _ = _placed(df, smooth, on)
    rows = rows.withColumn("_move", F.coalesce(v - F.lag(v).over(ordered), F.lit(0.0)))
    for name, move in (("_up", F.greatest("_move", F.lit(0.0))), ("_down", F.greatest(-F.col("_move"), F.lit(0.0)))):
        seed = F.sum(move).over(ordered.rowsBetween(1 - w, 0)) / w
        shift = F.when(place < w, 0.0).when(place == w, seed).otherwise(move / w)
        rows = rows.withColumn("_shift", shift)
        # nothing lies before the seed, so the scale up to it is of no account
        rows = affine_scan(rows, name, F.when(place <= w, 1.0).otherwise(smooth), F.col("_shift"), smooth, on).drop("_shift")
    strength = F.coalesce(ratio("_up", "_down"), F.lit(100.0))
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return rows.withColumn(out, F.when(F.col("_n") >= w, 100.0 - 100.0 / (1.0 + strength))).drop("_move", "_up", "_down", "_n")


def kdj(df: DataFrame, out: str, on: Axis = SERIES, high: str = "high", low: str = "low", close: str = "close", n: int = 9, m1: int = 3) -> DataFrame:
    """K line: raw stochastic value smoothed from a start of 50."""
    h, lo = no_nan(F.col(high).cast("double")), no_nan(F.col(low).cast("double"))
    rows, ordered, _ = _placed(df, 1.0 - 1.0 / m1, on)
    last = ordered.rowsBetween(1 - n, 0)
    rows = rows.withColumns({"_top": F.max(h).over(last), "_bottom": F.min(lo).over(last),
                             "_tops": F.count(h).over(last), "_bottoms": F.count(lo).over(last)})
    span = F.when(F.col("_bottoms") == n, F.col("_top") - F.col("_bottom"))
    raw = F.when(span != 0, (no_nan(F.col(close).cast("double")) - F.col("_bottom")) / span * 100.0).otherwise(50.0)
    raw = F.when(F.col("_row") == 1, 50.0).when(F.col("_tops") < n, 0.0).otherwise(raw)
    rows = rows.withColumn("_raw", raw).drop("_top", "_bottom", "_tops", "_bottoms")
    return _average(rows, "_raw", out, 1.0 - 1.0 / m1, on).drop("_raw")


def sar(pdf: pd.DataFrame, high: str = "high", low: str = "low", step: float = 0.02, limit: float = 0.20) -> pd.Series:
    """Parabolic stop-and-reverse; NULL for fewer than two rows.

    A falling trend is the mirror image of a rising one, so the walk keeps a direction of +1 or -1
    and works on prices multiplied by it.
    """
    hi, lo = pdf[high].to_numpy(float), pdf[low].to_numpy(float)
    if len(hi) < 2:
        return pd.Series(math.nan, index=pdf.index)
    side = 1.0 if hi[1] >= hi[0] else -1.0
    # "ahead" is the price the trend pushes, "behind" the one that can break it, both mirrored
    ahead = {1.0: hi, -1.0: -lo}
    behind = {1.0: lo, -1.0: -hi}
    extreme, stop, speed = ahead[side][:2].max(), behind[side][:2].min(), step
    path = [side * stop]
    for i in range(1, len(hi)):
        stop = min(stop + speed * (extreme - stop), behind[side][i - 1], behind[side][i])
        if behind[side][i] < stop:
            side, stop, speed = -side, -extreme, step
            extreme = ahead[side][i]
        elif ahead[side][i] > extreme:
            extreme, speed = ahead[side][i], min(speed + step, limit)
        path.append(side * stop)
    return pd.Series(path, index=pdf.index)


KINDS: dict[str, Callable] = {"EMA": ema, "MACD": macd, "RSI": rsi, "KDJ": kdj, "SAR": sar}


def with_recursive(df: DataFrame, wanted: list[Recursive], on: Axis = SERIES) -> DataFrame:
    """Add the wanted indicator columns: the averages as window columns, then SAR, if asked for, in one Python call per series."""
    out = by_series(df, on) if any(r.kind != "SAR" for r in wanted) else df
    for r in wanted:
        if r.kind != "SAR":
            out = KINDS[r.kind](out, r.out, on, **r.args)
    walked = [r for r in wanted if r.kind == "SAR"]
    out = out.select(*df.columns, *[r.out for r in wanted if r.kind != "SAR"])
    if not walked:
        return out
    schema = T.StructType(out.schema.fields + [T.StructField(r.out, T.DoubleType()) for r in walked])
    order = on.order

    def per_series(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, ignore_index=True)
        return pdf.assign(**{r.out: sar(pdf, **r.args) for r in walked})

    return out.groupBy(on.key).applyInPandas(per_series, schema)
