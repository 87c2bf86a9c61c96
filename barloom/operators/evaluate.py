"""Scoring factors against returns. Everything is keyed, so all securities are scored at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.core import SERIES, Axis, by_series, finite, or_zero, pairs, pearson, ratio
from barloom.functions.section import pair_correlations
from barloom.functions.series import clip, pct_change
from barloom.functions.stats import expanding
from barloom.operators.panel import TRADING_DAYS
from barloom.session import materialize

# Sample sizes and pass marks of the evaluation.
EPS = 1e-10
MIN_PAIRS = 20
MIN_ROWS = 3
MIN_EXPANDING = 60
POSITION_CLIP = 2.0
SPREAD = 16  # tasks over which rows of one date and factor value are dealt at most
PASS_IR, PASS_SHARPE, PASS_DRAWDOWN = 0.3, 0.5, -0.5
YEAR = TRADING_DAYS ** 0.5


def ic(df: DataFrame, factor: str, rets: list[str], by: str = "ts_code", train_end: str | None = None) -> DataFrame:
    """Full-sample correlation per security and horizon; NULL below 20 pairs."""
    if train_end is not None:
        df = df.where(F.col("trade_date") > F.to_date(F.lit(train_end)))
    cells = [F.when(pairs(factor, r) >= MIN_PAIRS, pearson(factor, r)).alias(f"ic_{r}") for r in rets]
    return df.groupBy(by).agg(*cells)


def series_rank(x: Column, on: Axis, keep: Column) -> Column:
    """Average-tie rank inside each series among the rows where ``keep`` holds.

    Rows below and rows not above come from the same sort, and all ranks share the exchange by series.
    """
    order = Window.partitionBy(on.key, keep).orderBy(x)
    return F.when(keep, (F.rank().over(order) + F.count(F.lit(1)).over(order)) / 2)


def series_rank_among(x: Column, on: Axis, keep: Column) -> Column:
    """The same rank from one sort of the whole series, which the ranks of ``x`` among other rows share."""
    order = Window.partitionBy(on.key).orderBy(x)
    kept = F.when(keep, 1).otherwise(0)
    equal = F.sum(kept).over(order.rangeBetween(Window.currentRow, Window.currentRow))
    return F.when(keep, F.sum(kept).over(order) - (equal - 1) / 2)


def rank_ic(df: DataFrame, factor: str, rets: list[str], on: Axis = SERIES) -> DataFrame:
    """Spearman correlation per security and horizon; NULL below 20 pairs."""
    ranks = {}
    for r in rets:
        keep = F.col(factor).isNotNull() & F.col(r).isNotNull()
        ranks[f"_f_{r}"] = series_rank_among(F.col(factor), on, keep)
        ranks[f"_r_{r}"] = series_rank(F.col(r), on, keep)
    cells = [F.when(F.count(f"_f_{r}") >= MIN_PAIRS, pearson(f"_f_{r}", f"_r_{r}")).alias(f"rank_ic_{r}") for r in rets]
    return by_series(df, on).withColumns(ranks).groupBy(on.key).agg(*cells)


def daily_ic(df: DataFrame, prediction: str, ret: str, min_rows: int = 3, by: str = "trade_date") -> DataFrame:
    """(date, ic, n): cross-section correlation of every date; NULL below ``min_rows`` rows."""
    return df.groupBy(by).agg(
        F.when(pairs(prediction, ret) >= min_rows, pearson(prediction, ret)).alias("ic"), pairs(prediction, ret).alias("n"))


def ic_stats(ics: DataFrame, column: str = "ic", by: list[str] | None = None) -> DataFrame:
    """Mean, spread, information ratio and hit rate of IC values."""
    x = F.col(column)
    mean, std = F.avg(x), or_zero(F.stddev_samp(x))
    return ics.where(x.isNotNull()).groupBy(*(by or [])).agg(
        F.round(mean, 6).alias("ic_mean"), F.round(std, 6).alias("ic_std"),
        F.when(std > EPS, F.round(ratio(mean, std), 4)).otherwise(0.0).alias("ic_ir"),
        F.round(F.avg((x > 0).cast("double")), 4).alias("hit_rate"), F.count_if(x > 0).alias("positive_days"),
        F.count(x).alias("total_days"), (F.count(x) == 1).alias("is_full_sample"))


def ic_summary(df: DataFrame, factor: str, rets: list[str], min_rows: int = MIN_ROWS, by: str = "trade_date") -> DataFrame:
    """(method, horizon, figures of ``ic_stats``): daily section IC, plain and of ranks, summed up per return column.

    The rows are dealt once, with all horizons side by side, by date, factor value and a hash of the returns, so copies of a row meet and neither a date nor a
    value gathers; there the horizons become rows over their complete pairs, which are counted and written once (a pair at most ``SPREAD`` times).
    Two rankings and one aggregate serve all of them: ranks come from counts of values, correlations from partial sums.
    """
    value = lambda c: finite(F.col(c).cast("double"))
    rows = df.select(by, value(factor).alias("_x"), *(value(r).alias(r) for r in rets)).where("_x is not null").withColumn(
        "_spread", F.pmod(F.xxhash64(*rets), F.lit(SPREAD)).cast("byte"))
    dealt = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), by, "_x", "_spread")
    cells = F.array(*(F.struct(F.lit(r).alias("horizon"), F.col(r).alias("_y")) for r in rets))
    counted = dealt.select(by, "_x", "_spread", F.inline(cells)).where("_y is not null").groupBy("horizon", by, "_x", "_spread", "_y").agg(F.count(F.lit(1)).alias("_w"))
    counted = materialize(counted.drop("_spread"), "pairs")
    cell = lambda method: F.struct(F.lit(method).alias("method"), F.round(F.when(F.col("n") >= min_rows, F.col(method)), 12).alias("ic"))
    daily = pair_correlations(counted, ["horizon", by]).select("horizon", by, F.array(cell("pearson"), cell("spearman")).alias("_both"))
    return ic_stats(daily.select("horizon", F.inline("_both")), by=["method", "horizon"])


def sharpe(ret: str = "ret", rf: float = 0.0) -> Column:
    """Yearly Sharpe ratio as an aggregate; 0 below 20 rows or without spread."""
    r = F.col(ret)
    std = F.stddev_samp(r)
    value = ratio(F.avg(r) - rf / TRADING_DAYS, std) * YEAR
    return F.when((F.count(r) < MIN_PAIRS) | (std < EPS), F.lit(0.0)).otherwise(value)


def sharpe_population(ret: str = "ret") -> Column:
    """Sharpe ratio with the population deviation for short histories; 0 below 5 rows."""
    r = F.col(ret)
    return F.when(F.count(r) < 5, F.lit(0.0)).otherwise(or_zero(ratio(F.avg(r), F.stddev_pop(r)) * YEAR))


def annual_return(ret: str = "ret") -> Column:
    """Compound return per year as an aggregate; 0 without rows."""
    r = F.col(ret)
    return F.when(F.count(r) < 1, F.lit(0.0)).otherwise(F.pow(F.product(1 + r), F.lit(float(TRADING_DAYS)) / F.count(r)) - 1)


def drawdown(equity: str, on: Axis = SERIES) -> Column:
    """Distance from the running peak."""
    peak = F.max(equity).over(on.so_far)
    return ratio(F.col(equity) - peak, peak)


def max_drawdown(df: DataFrame, equity: str, on: Axis = SERIES) -> DataFrame:
    """(key, max_drawdown) of an equity column; 0 below two values."""
    deep = df.where(F.col(equity).isNotNull()).withColumn("_dd", drawdown(equity, on))
    return deep.groupBy(on.key).agg(
        F.when(F.count("_dd") < 2, F.lit(0.0)).otherwise(F.min("_dd")).alias("max_drawdown"))


def position_turnover(df: DataFrame, position: str, on: Axis = SERIES) -> DataFrame:
    """(key, turnover): half the mean absolute position change."""
    moved = df.withColumn("_move", F.abs(F.col(position) - F.lag(position).over(on.ordered)))
    return moved.groupBy(on.key).agg(or_zero(F.avg("_move") / 2).alias("turnover"))


def zscore_position(df: DataFrame, factor: str, on: Axis = SERIES) -> DataFrame:
    """Add ``position`` (clipped z-score against the past, 0 before 60 values) and ``strategy_ret``
    (yesterday's position times today's return, column ``ret``)."""
    std = expanding(F.stddev_samp, factor, MIN_EXPANDING, on)
    z = ratio(F.col(factor) - expanding(F.avg, factor, MIN_EXPANDING, on), F.when(std == 0, F.lit(1.0)).otherwise(std))
    placed = df.withColumn("position", or_zero(clip(z, -POSITION_CLIP, POSITION_CLIP)))
    return placed.withColumn("strategy_ret", F.lag("position").over(on.ordered) * F.col("ret"))


def evaluate_factor(df: DataFrame, factor: str, price: str = "close", periods: tuple[int, ...] = (1, 5, 10, 20),
                    on: Axis = SERIES) -> DataFrame:
    """One row per security: IC and rank IC for each horizon, and the figures of the z-score strategy.

    All windows and the final aggregation use the series key: one exchange for the whole evaluation. The ranks of the factor
    share one sort.
    """
    rows = by_series(df.where(F.col(factor).isNotNull() & F.col(price).isNotNull()).select(on.key, on.order, *dict.fromkeys((factor, price))), on)
    rows = rows.withColumns({"ret": pct_change(price, 1, on)} | {
        f"ret_{p}d": ratio(F.lead(price, p).over(on.ordered), F.col(price)) - 1 for p in periods})
    rows = zscore_position(rows, factor, on)
    rows = rows.withColumns({
        "_move": F.abs(F.col("position") - F.lag("position").over(on.ordered)),
        "_equity": F.when(F.col("strategy_ret").isNotNull(), F.product(1 + F.col("strategy_ret")).over(on.so_far))})
    rows = rows.withColumn("_dd", drawdown("_equity", on))
    ranks = {}
    for p in periods:
        known = F.col(f"ret_{p}d").isNotNull()
        ranks |= {f"_f{p}": series_rank_among(F.col(factor), on, known), f"_r{p}": series_rank(F.col(f"ret_{p}d"), on, known)}
    rows = rows.withColumns(ranks)
    enough = lambda p: F.count(f"ret_{p}d") >= MIN_PAIRS
    return rows.groupBy(on.key).agg(
        F.count(F.lit(1)).alias("data_points"),
        *(F.when(enough(p), F.round(pearson(factor, f"ret_{p}d"), 6)).alias(f"ic_{p}d") for p in periods),
        *(F.when(enough(p), F.round(pearson(f"_f{p}", f"_r{p}"), 6)).alias(f"rank_ic_{p}d") for p in periods),
        F.round(sharpe("strategy_ret"), 4).alias("sharpe"),
        F.round(F.when(F.count("_dd") < 2, F.lit(0.0)).otherwise(F.min("_dd")), 4).alias("max_drawdown"),
        F.round(annual_return("strategy_ret"), 4).alias("annual_return"),
        F.round(or_zero(F.avg("_move") / 2), 4).alias("turnover"))


def verdict(ic_irs: list[Column], sharpe_value: Column, drawdown_value: Column) -> Column:
    """Pass mark: one strong information ratio, a strong Sharpe ratio, a bearable drawdown."""
    strongest = F.abs(ic_irs[0]) if len(ic_irs) == 1 else F.greatest(*(F.abs(c) for c in ic_irs))
    return (strongest >= PASS_IR) & (F.abs(sharpe_value) >= PASS_SHARPE) & (drawdown_value >= PASS_DRAWDOWN)


def judge(curves: DataFrame, summary: DataFrame) -> DataFrame:
    """Add ``passed`` to rows of ``sharpe`` and ``max_drawdown``: the strongest information ratio of the daily ICs, over the
    horizons of ``ic_summary``, counts for all of them; without a daily IC it is 0."""
    strongest = materialize(summary.where("method = 'pearson'").agg(or_zero(F.max(F.abs("ic_ir"))).alias("_ir")), "verdict").scalar()
    return curves.withColumn("passed", verdict([strongest], F.col("sharpe"), F.col("max_drawdown")))


def label_purge_check(df: DataFrame, rets: list[str], train_end: str) -> DataFrame:
    """Per label column: how many labels reach past the training end, in calendar days."""
    cells = F.explode(F.array(*(F.struct(F.lit(r).alias("label"), F.col(r).alias("value")) for r in rets)))
    long = df.select("trade_date", cells.alias("_c")).select("trade_date", "_c.*").where(F.col("value").isNotNull())
    days = F.coalesce(F.regexp_extract("label", r"^ret_(\d+)d$", 1).try_cast("int"), F.lit(1))
    leaks = F.col("trade_date") > F.date_sub(F.to_date(F.lit(train_end)), days)
    return long.withColumns({"period": days, "_leak": leaks}).groupBy("label").agg(
        F.count_if("_leak").alias("leaked"), F.count_if(~F.col("_leak")).alias("safe"),
        F.max("period").alias("recommended_purge")).withColumn("clean", F.col("leaked") == 0)


def market_beta(stock: DataFrame, market: DataFrame, window: int = 60, on: Axis = SERIES) -> DataFrame:
    """Add ``beta``: rolling slope of ``ret`` on ``market_ret`` over the dates both have.

    Rows without either return form a partition of their own, so the common rows keep their order
    without a filter and a join back. The market has one row per date and is broadcast, so the stocks stay dealt by series.
    """
    joined = stock.join(F.broadcast(market.select(on.order, "market_ret")), on.order, "left")
    known = F.col("ret").isNotNull() & F.col("market_ret").isNotNull()
    frame = Window.partitionBy(on.key, "_known").orderBy(on.order).rowsBetween(1 - window, 0)
    spread = F.var_samp("market_ret").over(frame)
    slope = ratio(F.covar_samp("ret", "market_ret").over(frame), spread)
    full = F.col("_known") & (F.count(F.lit(1)).over(frame) == window) & (spread > EPS)
    return joined.withColumn("_known", known).withColumn("beta", F.when(full, slope)).drop("_known")
