"""From signals to weights, daily returns, costs, NAV and performance figures.

All steps take ``by``, extra key columns such as ``strategy``, so many portfolios run in one plan.
Timing: weights picked on day t earn from t+1; the cost of a rebalance lowers the NAV of that day
but not the day's return.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.core import or_zero, ratio
from barloom.functions.section import rank_sum
from barloom.operators.panel import TRADING_DAYS
from barloom.session import materialize

# Trading cost rates and limits.
COMMISSION, STAMP, SLIPPAGE = 0.0003, 0.0005, 0.001
MIN_COMMISSION = 5.0
IMPACT, IMPACT_POWER = 0.1, 0.5
MAX_COST = 0.05
ROUND_TRIP = 2 * COMMISSION + STAMP + 2 * SLIPPAGE
INIT_CASH = 1_000_000.0
EPS = 1e-10
MIN_DAYS, MIN_BENCHMARK_DAYS = 5, 10


def rebalance_dates(dates: DataFrame, freq: str = "M") -> DataFrame:
    """First date plus the last trading date of every month (M), week (W) or day (D).

    Weeks are told apart by year as well.
    """
    if freq == "D":
        return dates.select(F.col("trade_date").alias("rebalance_date")).distinct()
    period = F.date_trunc({"M": "month", "W": "week"}[freq], "trade_date")
    last = dates.groupBy(period.alias("_p")).agg(F.max("trade_date").alias("rebalance_date")).select("rebalance_date")
    first = dates.agg(F.min("trade_date").alias("rebalance_date"))
    return last.unionByName(first).distinct()


def top_n(df: DataFrame, value: str, n: int, by: Sequence[str], tie: str = "ts_code") -> DataFrame:
    """The n largest values per group, ties by code. Spark keeps only n rows per group and task before
    the exchange, so a large group costs little."""
    order = Window.partitionBy(*by).orderBy(F.col(value).desc(), F.col(tie))
    return df.where(F.col(value).isNotNull()).withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= n).drop("_rn")


def topn_weights(signal: DataFrame, rebalances: DataFrame, n: int, by: Sequence[str] = (), blacklist: DataFrame | None = None) -> DataFrame:
    """(by, rebalance_date, ts_code, weight): equal weights over the top n of each rebalance date.

    A date without valid signals yields no rows, which is all cash.
    """
    at = signal.withColumnRenamed("trade_date", "rebalance_date").join(rebalances, "rebalance_date")
    if blacklist is not None:
        at = at.join(blacklist.withColumnRenamed("trade_date", "rebalance_date"), ["rebalance_date", "ts_code"], "left_anti")
    keys = [*by, "rebalance_date"]
    picked = top_n(at, "signal", n, keys)
    return picked.withColumn("weight", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(*keys))).select(
        *keys, "ts_code", "weight")


def in_force(dates: DataFrame, rebalances: DataFrame) -> DataFrame:
    """(trade_date, rebalance_date): the latest rebalance before each date. One row per date: the
    as-of step runs on the calendar, the weights then join by equality."""
    flagged = dates.join(rebalances.withColumn("_rb", F.col("rebalance_date")),
                         F.col("trade_date") == F.col("_rb"), "left").drop("_rb")
    before = Window.partitionBy(F.lit(0)).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)
    return flagged.select("trade_date", F.last("rebalance_date", ignorenulls=True).over(before).alias("rebalance_date"))


def portfolio_returns(returns: DataFrame, weights: DataFrame, rebalances: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, trade_date, ret): weighted returns of the weights in force; a missing return counts as 0,
    as does a day before the first weights."""
    dates = returns.select("trade_date").distinct()
    held = returns.select("trade_date", "ts_code", "ret").join(in_force(dates, rebalances), "trade_date")
    earned = held.join(weights, ["rebalance_date", "ts_code"]).groupBy(*by, "trade_date").agg(
        F.sum(F.col("weight") * or_zero(F.col("ret"))).alias("ret"))
    if by:
        # every portfolio on every date, from one array no longer than the calendar
        calendar = dates.agg(F.collect_set("trade_date")).scalar()
        every = weights.select(*by).distinct().select(*by, F.explode(calendar).alias("trade_date"))
    else:
        every = dates
    return every.join(earned, [*by, "trade_date"], "left").fillna(0.0, subset=["ret"])


def turnover(weights: DataFrame, rebalances: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, trade_date, turnover): half the absolute weight change on every rebalance after the first."""
    order = Window.partitionBy(F.lit(0)).orderBy("rebalance_date")
    seq = rebalances.withColumn("_seq", F.row_number().over(order))
    # each weight counts for its own rebalance and against the next one
    sides = F.explode(F.array(F.struct(F.lit(0).alias("s"), F.col("weight").alias("w")), F.struct(F.lit(1).alias("s"), (-F.col("weight")).alias("w"))))
    signed = weights.join(seq, "rebalance_date").select(*by, "ts_code", "_seq", sides.alias("_e"))
    moved = signed.groupBy(*by, "ts_code", (F.col("_seq") + F.col("_e.s")).alias("_seq")).agg(F.abs(F.sum("_e.w")).alias("_d"))
    sums = moved.groupBy(*by, "_seq").agg((F.sum("_d") / 2).alias("turnover"))
    later = seq.where("_seq > 1")
    return later.join(sums, "_seq").select(*by, F.col("rebalance_date").alias("trade_date"), "turnover")


def cost_ratio(turnover_value: Column) -> Column:
    """Share of NAV that a rebalance costs."""
    return F.least(turnover_value * ROUND_TRIP, F.lit(MAX_COST))


def trade_costs(trades: DataFrame, amount: str = "amount", adv: str = "adv", side: str = "side") -> DataFrame:
    """Commission, slippage, stamp duty, market impact and total of single trades."""
    a, v = F.col(amount), F.col(adv)
    impact = F.when((a > 0) & (v > 0), IMPACT * F.pow(ratio(a, v), F.lit(IMPACT_POWER)) * a).otherwise(0.0)
    cost = trades.withColumns({
        "commission": F.greatest(a * COMMISSION, F.lit(MIN_COMMISSION)), "slippage": a * SLIPPAGE,
        "stamp": F.when(F.col(side) == "sell", a * STAMP).otherwise(0.0), "impact": impact})
    return cost.withColumn("total", F.col("commission") + F.col("slippage") + F.col("stamp") + F.col("impact"))


def nav(daily: DataFrame, turns: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, trade_date, ret, turnover, nav). One row per portfolio and date from here on, so the
    running product orders no more than a calendar per portfolio."""
    rows = daily.join(turns, [*by, "trade_date"], "left").fillna(0.0, subset=["turnover"])
    step = (1 + F.col("ret")) * (1 - cost_ratio(F.col("turnover")))
    return rows.withColumn("nav", F.product(step).over(_running(by)))


def _running(by: Sequence[str]):
    return Window.partitionBy(*(by or [F.lit(0)])).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)


def backtest(returns: DataFrame, signal: DataFrame, n: int, freq: str = "M", by: Sequence[str] = ()) -> DataFrame:
    """Weights, daily returns, turnover and NAV of a signal.

    The weights, n rows per rebalance, are written once: the returns and the turnover both need them,
    and behind them stands the whole signal. ``returns`` is read more than once as well; hand over a
    stored table when computing it is expensive.
    """
    rebalances = rebalance_dates(returns.select("trade_date").distinct(), freq)
    weights = materialize(topn_weights(signal, rebalances, n, by), "weights")
    return nav(portfolio_returns(returns, weights, rebalances, by), turnover(weights, rebalances, by), by)


def metrics(curve: DataFrame, by: Sequence[str] = (), init_cash: float = INIT_CASH, min_days: int = MIN_DAYS) -> DataFrame:
    """One row of performance figures per portfolio. With fewer than ``min_days`` days they are NULL and ``status`` is too_few_rows.

    Sharpe, win rate and VaR use the daily returns before cost.
    """
    part = list(by) or [F.lit(0)]
    order = Window.partitionBy(*part).orderBy("trade_date")
    r = F.col("ret")
    rows = curve.withColumns({
        "_prev": F.coalesce(F.lag("nav").over(order), F.lit(1.0)), "_peak": F.max("nav").over(_running(by)),
        "_var": F.percentile("ret", 0.05).over(Window.partitionBy(*part))})
    n = F.count(r)
    std = F.stddev_samp(r)
    total = F.max_by("nav", "trade_date") / F.min_by("nav", "trade_date") - 1
    out = rows.groupBy(*by).agg(
        n.alias("trading_days"), F.max_by("nav", "trade_date").alias("final_nav"), total.alias("cum_return"),
        (F.pow(1 + total, F.lit(float(TRADING_DAYS)) / n) - 1).alias("annual_return"),
        (std * TRADING_DAYS ** 0.5).alias("annual_volatility"),
        F.when(std > EPS, ratio(F.avg(r), std) * TRADING_DAYS ** 0.5).otherwise(0.0).alias("sharpe"),
        F.min(ratio(F.col("nav") - F.col("_peak"), F.col("_peak"))).alias("max_drawdown"),
        F.max("_var").alias("var_95"), F.coalesce(F.avg(F.when(r <= F.col("_var"), r)), F.max("_var")).alias("cvar_95"),
        F.avg("turnover").alias("avg_turnover"),
        F.sum(F.col("_prev") * F.col("turnover") * init_cash * ROUND_TRIP).alias("total_cost"),
        (F.count_if(r > 0) / n).alias("daily_win_rate"),
        # without a loss its size counts as 1, without a gain that as 0
        ratio(F.coalesce(F.avg(F.when(r > 0, r)), F.lit(0.0)), F.coalesce(F.abs(F.avg(F.when(r < 0, r))), F.lit(1.0))).alias("profit_loss_ratio"))
    deep = F.abs("max_drawdown") > EPS
    out = out.withColumns({
        "calmar": F.when(deep, ratio(F.col("annual_return"), F.abs("max_drawdown"))).otherwise(0.0),
        "cost_ratio": F.col("total_cost") / init_cash})
    return _with_status(out, [*by, "trading_days"], F.col("trading_days") < min_days)


def _with_status(df: DataFrame, keys: list[str], few: Column) -> DataFrame:
    """Figures NULL where there are too few rows, and a ``status`` that says so."""
    return df.select(*keys, *(F.when(~few, F.col(c)).alias(c) for c in df.columns if c not in keys), F.when(few, "too_few_rows").otherwise("ok").alias("status"))


def total_cost(curve: DataFrame, by: Sequence[str] = (), init_cash: float = INIT_CASH) -> DataFrame:
    """Money spent on rebalancing: the day before's NAV, times turnover, times the round-trip rate."""
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("trade_date")
    rows = curve.withColumn("_prev", F.coalesce(F.lag("nav").over(order), F.lit(1.0)))
    return rows.groupBy(*by).agg(F.sum(F.col("_prev") * F.col("turnover") * init_cash * ROUND_TRIP).alias("total_cost"))


def benchmark_compare(curve: DataFrame, bars: DataFrame, code: str | None = None, min_days: int = MIN_BENCHMARK_DAYS) -> DataFrame:
    """Benchmark and excess yearly return and the information ratio of the daily excess; NULL, with a
    ``status``, under ``min_days`` common days.

    The benchmark is one security's price, or the mean price over all securities; a security's price
    carries over days without a bar, as on the rectangular grid.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("trade_date")
    if code is not None:
        price = bars.where(F.col("ts_code") == code).select("trade_date", F.col("close").alias("price"))
    else:
        price = bars.groupBy("trade_date").agg(F.avg("close").alias("price"))
    bench = price.withColumn("bench", ratio("price", F.lag("price").over(order)) - 1).dropna(subset=["bench"])
    r, b = F.col("ret"), F.col("bench")
    both = F.when(b.isNotNull(), r) - b
    std = F.stddev_samp(both)
    mine = F.max_by("nav", "trade_date") / F.min_by("nav", "trade_date")
    out = curve.join(bench, "trade_date", "left").agg(
        F.count(both).alias("days"), (F.pow(F.product(1 + b), F.lit(float(TRADING_DAYS)) / F.count(b)) - 1).alias("benchmark_return"),
        F.when(std > EPS, ratio(F.avg(both), std) * TRADING_DAYS ** 0.5).otherwise(0.0).alias("information_ratio"),
        (F.pow(mine, F.lit(float(TRADING_DAYS)) / F.count(r)) - 1).alias("_annual"),
    ).withColumn("excess_return", F.col("_annual") - F.col("benchmark_return")).drop("_annual")
    return _with_status(out, ["days"], F.col("days") < min_days)


def equal_weight_signal(panel: DataFrame) -> DataFrame:
    """Signal 1.0 everywhere: with a top-n pick, the first n codes by tie order."""
    return panel.select("trade_date", "ts_code", F.lit(1.0).alias("signal"))


def at_rebalances(df: DataFrame, rebalances: DataFrame) -> DataFrame:
    """Rows of the rebalance dates only: cross-section work need not be done on other dates."""
    return df.join(rebalances.withColumnRenamed("rebalance_date", "trade_date"), "trade_date", "left_semi")


def composite_signal(df: DataFrame, rising: Sequence[str], falling: Sequence[str]) -> DataFrame:
    """Sum of average-tie percentile ranks per date: plus for ``rising``, minus for ``falling`` columns."""
    return rank_sum(df, {n: 1.0 for n in rising} | {n: -1.0 for n in falling}, "signal")


def oof_signal(keys: DataFrame, predictions: DataFrame, column: str = "prediction") -> DataFrame:
    """Out-of-fold predictions on all keys; NULL where no fold predicted."""
    at = ["trade_date", "ts_code"]
    return keys.select(*at).join(predictions.select(*at, F.col(column).alias("signal")), at, "left")


def compare_strategies(returns: DataFrame, signals: DataFrame, n: int, freq: str = "M") -> DataFrame:
    """Performance of several signals (column ``strategy``) in one plan, best Sharpe ratio first."""
    table = metrics(backtest(returns, signals, n, freq, ["strategy"]), ["strategy"])
    return table.orderBy(F.round("sharpe", 2).desc(), "strategy")


def holding_periods(dates: DataFrame, days: int = 5, start: int = 60) -> DataFrame:
    """(trade_date, day_no, period, pick_date): every ``days`` dates from ``start`` on; a period's picks
    are made on its first date and earn on the following ``days`` dates."""
    numbered = dates.withColumn("day_no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("trade_date")) - 1)
    picks = numbered.where((F.col("day_no") >= start) & ((F.col("day_no") - start) % days == 0)).select(
        ((F.col("day_no") - start) / days).cast("int").alias("period"), F.col("trade_date").alias("pick_date"))
    earned = numbered.where(F.col("day_no") > start).withColumn(
        "period", F.floor((F.col("day_no") - start - 1) / days).cast("int"))
    return earned.join(picks, "period")


def set_turnover(picks: DataFrame, period: str = "period") -> DataFrame:
    """(period, turnover): size of the symmetric difference to the previous picks over the size of the
    picks; 1 for the first period. ``picks`` holds a bounded top-n per period."""
    sets = picks.groupBy(period).agg(F.collect_set("ts_code").alias("_now"))
    before = F.lag("_now").over(Window.partitionBy(F.lit(0)).orderBy(period))
    differ = F.size(F.array_except("_now", "_old")) + F.size(F.array_except("_old", "_now"))
    return sets.withColumn("_old", before).select(
        period, F.when(F.col("_old").isNull(), F.lit(1.0)).otherwise(differ / F.greatest(F.size("_now"), F.lit(1))).alias("turnover"))


def holding_period_returns(returns: DataFrame, score: DataFrame, n: int, days: int = 5, start: int = 60, cost: float = 0.001) -> DataFrame:
    """(period, pick_date, turnover, period_ret): pick the top n by score every ``days`` dates, average
    their daily returns, subtract the spread cost and compound."""
    periods = holding_periods(returns.select("trade_date").distinct(), days, start)
    firsts = periods.select("period", F.col("pick_date").alias("trade_date")).distinct()
    picks = top_n(score.join(firsts, "trade_date"), "signal", n, ["period"]).select("period", "ts_code")
    moved = set_turnover(picks)
    daily = (
        returns.join(periods.select("trade_date", "period", "pick_date"), "trade_date").join(picks, ["period", "ts_code"])
        .groupBy("period", "pick_date", "trade_date").agg(F.avg("ret").alias("_r")).dropna(subset=["_r"]))
    return daily.join(moved, "period").groupBy("period", "pick_date", "turnover").agg(
        (F.product(1 + F.col("_r") - F.col("turnover") * cost / days) - 1).alias("period_ret"))


def annualized_periods(periods: DataFrame, days: int = 5) -> DataFrame:
    """Total and yearly return over all holding periods."""
    grown = F.product(1 + F.col("period_ret"))
    return periods.agg(F.count(F.lit(1)).alias("n_periods"), (grown - 1).alias("total_return"),
                       (F.pow(grown, F.lit(float(TRADING_DAYS)) / (F.count(F.lit(1)) * days)) - 1).alias("annual_return"))
