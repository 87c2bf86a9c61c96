"""Rule-based signals and the indicator bundles behind them, for every security at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import indicators, scalar
from barloom.functions.core import SERIES, Axis, or_zero, ratio
from barloom.operators.panel import TRADING_DAYS
from barloom.operators.recursive import Recursive, with_recursive
from barloom.operators.risk import PDF95, Z95, stress, var_parametric

# Cut-offs of the scores.
BULL, BEAR = 0.1, -0.1
MAX_CONFIDENCE = 0.85
PRICE_FLOOR = 0.01
YEAR = TRADING_DAYS ** 0.5

OUTPUT_SCHEMA = "signal string, confidence double, reasoning string, key_metrics map<string,double>, risk_flags array<string>"


def score_of(*rules: tuple[Column, float]) -> Column:
    """Sum of the weights of the rules that hold."""
    return reduce(lambda a, b: a + b, (F.when(c, F.lit(w)).otherwise(0.0) for c, w in rules))


def with_signal(df: DataFrame, score: Column) -> DataFrame:
    """Add ``score``, ``signal`` and ``confidence``."""
    s = F.col("score")
    return df.withColumn("score", score).withColumns({
        "signal": F.when(s > BULL, "bullish").when(s < BEAR, "bearish").otherwise("neutral"),
        "confidence": F.round(F.least(F.abs(s) * 2 + 0.3, F.lit(MAX_CONFIDENCE)), 2)})


def last_value(column: str, at_least: int = 1, order: str = "trade_date") -> Column:
    """Newest non-NULL value of a group, as an aggregate; NULL below ``at_least`` values."""
    newest = F.max_by(column, F.when(F.col(column).isNotNull(), F.col(order)))
    return F.when(F.count(column) >= at_least, newest)


def technical_bundle(panel: DataFrame, on: Axis = SERIES) -> DataFrame:
    """Indicators per bar: RSI_14, MA_5, MA_20, MA_60, ATR_14, BOLL_UPPER, MACD. Missing highs and lows
    are taken as the close plus and minus 2 %."""
    have = set(panel.columns)
    known = panel.withColumns({
        "high": F.coalesce(F.col("high"), F.col("close") * 1.02) if "high" in have else F.col("close") * 1.02,
        "low": F.coalesce(F.col("low"), F.col("close") * 0.98) if "low" in have else F.col("close") * 0.98})
    known = known.select(on.order, on.key, "high", "low", "close")
    rows = with_recursive(known, [Recursive("RSI", "RSI_14", {"w": 14}), Recursive("MACD", "MACD")], on)
    rows = rows.withColumn("_tr", indicators.true_range("high", "low", "close", on))
    return rows.withColumns({
        "MA_5": indicators.ma("close", 5, on), "MA_20": indicators.ma("close", 20, on), "MA_60": indicators.ma("close", 60, on),
        "ATR_14": indicators.atr_of("_tr", 14, on), "BOLL_UPPER": indicators.boll("close", 20, 2.0, on)}).drop("_tr")


def signal_technical(bundle: DataFrame, on: Axis = SERIES) -> DataFrame:
    """Oversold or overbought, and short against long average, from each security's newest values."""
    last = bundle.groupBy(on.key).agg(*(last_value(c, 2, on.order).alias(c) for c in ("RSI_14", "MA_5", "MA_20")))
    rsi, short, long = F.col("RSI_14"), F.col("MA_5"), F.col("MA_20")
    return with_signal(last, score_of(
        (rsi < 30, 0.2), (rsi > 70, -0.2), (short > long, 0.1), (short.isNotNull() & long.isNotNull() & ~(short > long), -0.1)))


def sentiment_features(panel: DataFrame, on: Axis = SERIES, min_rows: int = 20) -> DataFrame:
    """Volatility, value at risk, price-limit balance and trend per security; NULL, with status too_few_rows, under ``min_rows`` returns."""
    price = F.when(F.col("close") < PRICE_FLOOR, F.lit(PRICE_FLOOR)).otherwise(F.col("close"))
    newest = on.members.orderBy(F.col(on.order).desc())
    rows = panel.select(on.key, on.order, price.alias("_p")).withColumns({
        "_r": F.log(ratio("_p", F.lag("_p").over(on.ordered))), "_back": F.row_number().over(newest)})
    r, back, n = F.col("_r"), F.col("_back"), F.count("_r")
    recent = lambda k: F.when(back <= k, r)
    year = recent(TRADING_DAYS)
    up = F.count_if((back <= 20) & (r > 0.09))
    down = F.count_if((back <= 20) & (r < -0.09))
    v20, vall = F.stddev_pop(recent(20)) * YEAR, F.stddev_pop(r) * YEAR
    floor = F.lit(1e-10)
    out = rows.groupBy(on.key).agg(
        n.alias("_n"), v20.alias("vol_20d_annual"), F.when(n >= 60, F.stddev_pop(recent(60)) * YEAR).alias("vol_60d_annual"),
        F.when(vall > 0, v20 / F.greatest(vall, floor)).otherwise(1.0).alias("vol_percentile"),
        F.round(F.avg(year) + F.stddev_samp(year) * Z95, 6).alias("var_95"),
        F.round(F.avg(year) - F.stddev_samp(year) * PDF95 / 0.05, 6).alias("cvar_95"),
        ((up - down) / 20).alias("limit_ratio_20d"),
        F.when(n >= 60, F.avg(recent(10)) / F.greatest(F.stddev_pop(recent(60)), floor)).otherwise(0.0).alias("trend_strength"))
    few = F.col("_n") < min_rows
    figures = [c for c in out.columns if c not in (on.key, "_n")]
    return out.select(on.key, *(F.when(~few, F.col(c)).alias(c) for c in figures), F.when(few, "too_few_rows").otherwise("ok").alias("status"))


def signal_sentiment(features: DataFrame) -> DataFrame:
    vol, limit, trend = F.col("vol_percentile"), F.col("limit_ratio_20d"), F.col("trend_strength")
    return with_signal(features, score_of(
        (vol > 1.5, -0.15), (vol < 0.7, 0.1), (limit > 0.05, 0.15), (limit < -0.05, -0.15), (trend > 0.5, 0.1), (trend < -0.5, -0.1)))


def signal_fundamental(panel: DataFrame, on: Axis = SERIES) -> DataFrame:
    """Debt, growth and return on capital from the newest values of columns leverage, growth, roic."""
    last = panel.groupBy(on.key).agg(*(last_value(c, 1, on.order).alias(c) for c in ("leverage", "growth", "roic")))
    debt, growth, roic = F.col("leverage"), F.col("growth"), F.col("roic")
    return with_signal(last, score_of(
        (debt < 2.0, 0.15), (debt > 5.0, -0.15), (growth > 0.1, 0.2), (growth < 0, -0.2), (roic > 0.1, 0.15), (roic < 0.05, -0.1)))


def risk_review(df: DataFrame, var_95: str = "var_95") -> DataFrame:
    """Add ``risk_level`` and ``go_no_go`` by value at risk."""
    v = F.col(var_95)
    return df.withColumns({
        "risk_level": F.when(v > -0.01, "low").when(v > -0.03, "medium").when(v < -0.05, "high").otherwise("medium"),
        "go_no_go": F.when(v > -0.03, "go").otherwise("no_go")})


def news_counts(items: DataFrame, key: str) -> DataFrame:
    """(key, news_count, signal, confidence): neutral, with the number of items."""
    return items.groupBy(key).agg(F.count(F.lit(1)).alias("news_count")).withColumns(
        {"signal": F.lit("neutral"), "confidence": F.lit(0.5)})


def extract_json(df: DataFrame, raw: str) -> DataFrame:
    """Add signal, confidence, reasoning, key_metrics, risk_flags from the JSON object inside a text:
    first ``{`` to last ``}``. Without a readable object and signal: neutral, flagged parse_error."""
    body = F.regexp_extract(F.col(raw), r"(?s)\{.*\}", 0)
    rows = df.withColumn("_j", F.from_json(body, OUTPUT_SCHEMA, {"mode": "PERMISSIVE"}))
    bad = F.col("_j.signal").isNull()
    return rows.withColumns({
        "signal": F.coalesce("_j.signal", F.lit("neutral")),
        "confidence": F.when(bad, F.lit(0.5)).otherwise(F.col("_j.confidence")),
        "reasoning": F.col("_j.reasoning"), "key_metrics": F.col("_j.key_metrics"),
        "risk_flags": F.when(bad, F.array(F.lit("parse_error"))).otherwise(F.col("_j.risk_flags"))}).drop("_j")


def factor_bundle(panel: DataFrame, on: Axis = SERIES) -> DataFrame:
    """RSI_14, MACD, MA_5, MA_20, ATR_14 and GROWTH per bar, missing values as 0."""
    rows = technical_bundle(panel, on).withColumn("GROWTH", scalar.growth("close", on=on))
    names = ["RSI_14", "MACD", "MA_5", "MA_20", "ATR_14", "GROWTH"]
    return rows.select(on.order, on.key, *(or_zero(F.col(c)).alias(c) for c in names))


def snapshot_vector(bundle: DataFrame, names: list[str], last: int = 5, on: Axis = SERIES) -> DataFrame:
    """(key, features): the last values of each factor in one vector. Only ``last`` rows per security
    reach the aggregation."""
    back = F.count(F.lit(1)).over(on.whole) - F.row_number().over(on.ordered) + 1  # shares the sort of the indicators
    rows = bundle.withColumn("_back", back).where(F.col("_back") <= last)
    listed = F.sort_array(F.collect_list(F.struct((-F.col("_back")).alias("_at"), *names)))
    vector = rows.groupBy(on.key).agg(listed.alias("_l"))
    parts = [F.col(f"_l.{n}") for n in names]
    return vector.select(on.key, F.flatten(F.array(*parts)).cast("array<float>").alias("features"))


def stock_risk_metrics(returns: DataFrame, on: Axis = SERIES, min_rows: int = 20) -> DataFrame:
    """(key, var_95, cvar_95, stress_max_dd, status) per security; figures are NULL and status too_few_rows
    under ``min_rows`` returns."""
    sizes = returns.groupBy(on.key).agg(F.stddev_samp("ret").alias("vol"), F.count("ret").alias("_n"))
    worst = stress(sizes.where(F.col("_n") >= min_rows)).groupBy(on.key).agg(F.min("max_drawdown").alias("stress_max_dd"))
    few = F.col("_n") < min_rows
    return var_parametric(returns, [on.key]).join(sizes, on.key).join(worst, on.key, "left").select(
        on.key, *(F.when(~few, F.col(c)).alias(c) for c in ("var_95", "cvar_95", "stress_max_dd")), F.when(few, "too_few_rows").otherwise("ok").alias("status"))


def snapshot_risk(snapshot: DataFrame) -> DataFrame:
    """Add rough risk figures to a market snapshot: from yearly volatility and the last return."""
    vol = F.when(F.col("volatility_20d") > 0, F.col("volatility_20d") * -Z95)
    return snapshot.withColumns({
        "var_95": vol, "cvar_95": vol * 1.2, "stress_max_dd": F.greatest(F.lit(-0.1), F.col("returns_1d") * -50)})
