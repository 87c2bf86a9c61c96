"""Building, reshaping and masking (trade_date, ts_code) panels. Panels stay long; nothing pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.core import SERIES, Axis, by_series, ratio
from barloom.functions.series import pct_change

KEYS = ["trade_date", "ts_code"]
PRICES = ("open", "high", "low", "close")

# Annual trading days, and the daily move that counts as price-limited.
TRADING_DAYS = 252
LIMIT_MOVE = 0.095

# Code prefixes of the listing boards, first match wins.
BOARDS = [
    (("600", "601", "603", "605"), "沪市主板"),
    (("000", "001"), "深市主板"),
    (("002",), "中小板"),
    (("300", "301"), "创业板"),
    (("688",), "科创板"),
    (("430", "8"), "北交所"),
]
UNKNOWN_BOARD = "未知"


def build_panel(raw: DataFrame, date: str = "trade_date", pattern: str = "yyyyMMdd") -> DataFrame:
    """Parse the date text and add back-adjusted prices where an adjustment factor is given."""
    panel = raw.withColumn("trade_date", F.to_date(F.col(date), pattern))
    return adjusted(panel) if "adj_factor" in raw.columns else panel


def adjusted(panel: DataFrame) -> DataFrame:
    """Add ``{price}_adj`` columns."""
    return panel.withColumns({f"{c}_adj": F.col(c) * F.col("adj_factor") for c in PRICES if c in panel.columns})


def price_cells(panel: DataFrame, column: str = "close", use_adjusted: bool = True) -> DataFrame:
    """(trade_date, ts_code, value) of one price, the adjusted one where it exists."""
    c = F.col(column)
    if use_adjusted and f"{column}_adj" in panel.columns:
        c = F.coalesce(F.col(f"{column}_adj"), c)
    return panel.select(*KEYS, c.alias("value"))


def calendar(panel: DataFrame) -> DataFrame:
    """(trade_date, day_no): the distinct dates, numbered from 0. One row per date."""
    dates = panel.select("trade_date").distinct()
    return dates.withColumn("day_no", F.row_number().over(_single("trade_date")) - 1)


def _single(order: str):
    """Window over a table that is already reduced to one row per date."""
    return Window.partitionBy(F.lit(0)).orderBy(order)


def grid(panel: DataFrame) -> DataFrame:
    """Every security on every date, missing cells NULL.

    The dates come from one scalar subquery: an array no longer than the trading calendar, exploded
    next to each security.
    """
    dates = panel.agg(F.sort_array(F.collect_set("trade_date"))).scalar()
    cells = panel.select("ts_code").distinct().select("ts_code", F.explode(dates).alias("trade_date"))
    return cells.join(panel, KEYS, "left")


def stocks(panel: DataFrame) -> DataFrame:
    return panel.select("ts_code").distinct()


def dates(panel: DataFrame) -> DataFrame:
    return panel.select("trade_date").distinct()


def forward_returns(panel: DataFrame, periods: tuple[int, ...] = (1, 5, 10), purge: int = 0, price: str = "close",
                    on: Axis = SERIES) -> DataFrame:
    """``ret_{p}d`` along each security's own rows: the change over p rows, starting ``purge`` rows ahead.

    Rows without any horizon are dropped.
    """
    return dealt_forward_returns(by_series(panel, on), periods, purge, price, on)


def dealt_forward_returns(panel: DataFrame, periods: tuple[int, ...] = (1, 5, 10), purge: int = 0, price: str = "close", on: Axis = SERIES) -> DataFrame:
    """``forward_returns`` of a panel that is dealt by series already (``panel_tables.series_bars``): no further exchange."""
    start = F.col(price) if purge == 0 else F.lead(price, purge).over(on.ordered)
    named = {f"ret_{p}d": ratio(F.lead(price, purge + p).over(on.ordered), start) - 1 for p in periods}
    return panel.withColumns(named).dropna("all", subset=list(named))


def forward_returns_on_calendar(panel: DataFrame, periods: tuple[int, ...] = (1, 5, 10), purge: int = 0,
                                price: str = "close") -> DataFrame:
    """``ret_{p}d`` along the shared trading calendar, prices carried over days without a bar.

    The price in force k calendar rows ahead is the last one in a range frame over the day number,
    so the rectangular grid is never built. One row per bar.
    """
    cal = calendar(panel)
    numbered = panel.join(cal, "trade_date")
    newest = cal.agg(F.max("day_no")).scalar()
    series = Window.partitionBy("ts_code").orderBy("day_no")

    def at(k: int) -> Column:
        known = F.last(price, ignorenulls=True).over(series.rangeBetween(Window.unboundedPreceding, k))
        return F.when(F.col("day_no") + k <= F.col("_last"), known)

    named = {f"ret_{p}d": ratio(at(purge + p), at(purge)) - 1 for p in periods}
    return numbered.withColumn("_last", newest).withColumns(named).dropna("all", subset=list(named)).drop("_last")


def align_factor(panel: DataFrame, factor: DataFrame, fill: float | None = 0.0) -> DataFrame:
    """Factor values on the panel's keys; missing ones filled unless ``fill`` is None."""
    names = [c for c in factor.columns if c not in KEYS]
    out = panel.select(*KEYS).join(factor, KEYS, "left")
    return out if fill is None else out.fillna(fill, subset=names)


def align_intersection(panel: DataFrame, factor: DataFrame, fill: float | None = 0.0) -> DataFrame:
    """Only the keys both sides have."""
    return align_factor(panel.select(*KEYS).join(factor.select(*KEYS), KEYS, "left_semi"), factor, fill)


def plain_code(code: Column) -> Column:
    """``000001.SZ`` -> ``000001``."""
    return F.substring_index(code, ".", 1)


def exchange_code(code: Column) -> Column:
    """Six-digit code with its exchange suffix."""
    six = F.when(F.length(code) < 6, F.lpad(code, 6, "0")).otherwise(code)
    shenzhen = F.substring(six, 1, 1).isin("0", "2", "3")
    return F.concat(six, F.when(shenzhen, F.lit(".SZ")).otherwise(F.lit(".SH")))


def board_of(code: Column) -> Column:
    """Listing board by code prefix."""
    out = None
    for prefixes, board in BOARDS:
        hit = code.rlike("^(" + "|".join(prefixes) + ")")
        out = F.when(hit, F.lit(board)) if out is None else out.when(hit, F.lit(board))
    return out.otherwise(F.lit(UNKNOWN_BOARD))


def market_snapshot(panel: DataFrame, on: Axis = SERIES) -> DataFrame:
    """Last bar of each security with its recent returns and yearly volatility."""
    stepped = by_series(panel, on).withColumns({
        "returns_1d": pct_change("close", 1, on), "returns_5d": pct_change("close", 5, on),
        "returns_20d": pct_change("close", 20, on), "_place": F.row_number().over(on.ordered),
        "data_rows": F.count(F.lit(1)).over(on.whole),
    })
    recent = on.last(20)
    vol = F.when(F.count("returns_1d").over(recent) == 20, F.stddev_samp("returns_1d").over(recent) * TRADING_DAYS ** 0.5)
    return stepped.withColumn("volatility_20d", vol).where("_place = data_rows").drop("_place").fillna(
        0.0, subset=["returns_1d", "returns_5d", "returns_20d", "volatility_20d"])


def limit_mask(panel: DataFrame, threshold: float = LIMIT_MOVE, price: str = "close") -> DataFrame:
    """Add ``tradable``: true below the limit move and on the first date of the whole panel; a
    security's first bar on a later date has no return and is not tradable."""
    first = panel.agg(F.min("trade_date")).scalar()
    moved = F.coalesce(F.abs(pct_change(price)) < threshold, F.lit(False))
    return panel.withColumn("_move", moved).withColumn(
        "tradable", F.when(F.col("trade_date") == first, F.lit(True)).otherwise(F.col("_move"))).drop("_move")


def apply_mask(factor: DataFrame, mask: DataFrame, names: list[str]) -> DataFrame:
    """Factor rows kept, values NULL where the mask says not tradable; keys without a mask keep theirs."""
    joined = factor.join(mask.select(*KEYS, "tradable"), KEYS, "left")
    keep = F.coalesce(F.col("tradable"), F.lit(True))
    return joined.withColumns({n: F.when(keep, F.col(n)) for n in names}).drop("tradable")


def market_state(panel: DataFrame, factors: list[str]) -> DataFrame:
    """Per date: mean and spread of returns, relative day range, means of the factors."""
    means = [F.coalesce(F.avg(f), F.lit(0.0)).alias(f"mean_{f}") for f in factors]
    span = ratio(F.avg("high") - F.avg("low"), F.avg("close"))
    return panel.groupBy("trade_date").agg(
        F.avg("ret").alias("market_ret"), F.stddev_samp("ret").alias("market_vol"), span.alias("market_range"), *means)


def sequence_windows(panel: DataFrame, features: list[str], label: str, length: int = 20, on: Axis = SERIES) -> DataFrame:
    """Training sequences: ``length`` consecutive rows per security, half a length apart.

    The label is the one of the last row. A frame holds ``length`` rows, so the lists are bounded.
    """
    stride = max(1, length // 2)
    rn = F.row_number().over(on.ordered)
    frame = on.last(length)
    rows = panel.withColumns({
        "_rn": rn, "sequence": F.collect_list(F.array(*(F.coalesce(F.col(f), F.lit(float("nan"))) for f in features))).over(frame),
        "first_date": F.min(on.order).over(frame)})
    return rows.where((F.col("_rn") >= length) & ((F.col("_rn") - length) % stride == 0)).select(
        on.key, "first_date", F.col(on.order).alias("last_date"), "sequence", F.col(label).alias("label"))
