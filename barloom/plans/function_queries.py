"""One query per function of the factor library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import expr, indicators, scalar, section, series, stats
from barloom.functions.core import SERIES, by_series
from barloom.functions.library import FunctionLibrary
from barloom.operators.recursive import Recursive, with_recursive
from barloom.plans.base import query
from barloom.sources.panel_tables import bars

KEY = "trade_date:d ts_code"
ORDERED = "PARTITION BY ts_code ORDER BY trade_date"


def rolled(agg: str, x: str, w: int) -> str:
    """SQL of the rolling rule with its whole-series answer."""
    whole, frame = "(PARTITION BY ts_code)", f"({ORDERED} ROWS {w - 1} PRECEDING)"
    return (f"CASE WHEN {w} >= count(*) OVER {whole} THEN {agg} OVER {whole} "
            f"WHEN count({x}) OVER {frame} = {w} THEN {agg} OVER {frame} END")


def strict(agg: str, x: str, w: int) -> str:
    frame = f"({ORDERED} ROWS {w - 1} PRECEDING)"
    return f"CASE WHEN count({x}) OVER {frame} = {w} THEN {agg} OVER {frame} END"


def column_query(name: str, columns: dict[str, tuple[Callable[[], Column], str]], digits: int = 6, kinds: dict | None = None) -> None:
    """Register a query that adds columns to the bars; each comes with its SQL.

    Columns are given as functions: building one needs a running session, registering must not.
    """
    cols = KEY + "".join(f" {c}:{(kinds or {}).get(c, digits)}" for c in columns)
    sql = "SELECT trade_date, ts_code, " + ", ".join(f"{s} AS {c}" for c, (_, s) in columns.items()) + " FROM bars"

    @query(name, cols, sql, uses="bars")
    def build(spark, folder):
        return expr.factor_table(bars(spark, folder), {c: e() for c, (e, _) in columns.items()})


# -- statistics -----------------------------------------------------------------------------------

def _statistic(name: str, fn: Callable, agg: str, digits: int = 6) -> None:
    over = "(PARTITION BY ts_code)"
    columns = {
        "rolling": (lambda: fn("close", 20), rolled(agg.format(x="close"), "close", 20)),
        "gaps": (lambda: fn("gap", 4), rolled(agg.format(x="gap"), "gap", 4)),
        "overall": (lambda: fn("gap", 0), f"{agg.format(x='gap')} OVER {over}"),
    }
    if name == "fn_mean":
        columns["covered"] = (lambda: fn("gap", 100000), f"{agg.format(x='gap')} OVER {over}")
    column_query(name, columns, digits)


_statistic("fn_mean", stats.mean, "avg({x})")
_statistic("fn_std", stats.std, "stddev_samp({x})")
_statistic("fn_var", stats.var, "var_samp({x})")
_statistic("fn_max", stats.highest, "max({x})")
_statistic("fn_min", stats.lowest, "min({x})")
_statistic("fn_sum", stats.total, "sum({x})", digits=4)
_statistic("fn_count", stats.count, "count({x})")
_statistic("fn_median", stats.median, "quantile_cont({x}, 0.5)")
_statistic("fn_hhv", series.hhv, "max({x})")
_statistic("fn_llv", series.llv, "min({x})")

column_query("fn_product", {
    "rolling": (lambda: stats.product(F.col("close") / 108, 20), rolled("product(close / 108)", "close", 20)),
    "gaps": (lambda: stats.product(F.col("gap") / 108, 4), rolled("product(gap / 108)", "gap", 4)),
})
column_query("fn_percentile", {
    "rolling": (lambda: stats.percentile("close", 80, 20), rolled("quantile_cont(close, 0.8)", "close", 20)),
    "overall": (lambda: stats.percentile("gap", 10), "quantile_cont(gap, 0.1) OVER (PARTITION BY ts_code)"),
})

# -- ranking --------------------------------------------------------------------------------------

_LAST20 = f"list(close) OVER ({ORDERED} ROWS 19 PRECEDING)"
_FULL20 = f"count(close) OVER ({ORDERED} ROWS 19 PRECEDING) = 20"


@query("fn_rank", KEY + " overall:6 falling:6 rolling:6", uses="bars", sql=f"""
    SELECT trade_date, ts_code,
           row_number() OVER (PARTITION BY ts_code ORDER BY gap NULLS LAST, trade_date) / n AS overall,
           row_number() OVER (PARTITION BY ts_code ORDER BY gap DESC NULLS LAST, trade_date) / n AS falling,
           CASE WHEN n <= 20 THEN row_number() OVER (PARTITION BY ts_code ORDER BY close NULLS LAST, trade_date) / n
                WHEN full20 THEN len(list_filter(recent, lambda v: v <= close)) / 20 END AS rolling
    FROM (SELECT *, count(*) OVER (PARTITION BY ts_code) AS n, {_FULL20} AS full20, {_LAST20} AS recent FROM bars)""")
def fn_rank(spark, folder):
    return expr.factor_table(by_series(bars(spark, folder)), {
        "overall": stats.rank("gap"), "falling": stats.rank("gap", ascending=False), "rolling": stats.rank("close", 20)})


@query("fn_dense_rank", KEY + " overall:0 rolling:0", uses="bars", sql=f"""
    SELECT trade_date, ts_code, dense_rank() OVER (PARTITION BY ts_code ORDER BY gap NULLS LAST) AS overall,
           CASE WHEN n <= 20 THEN dense_rank() OVER (PARTITION BY ts_code ORDER BY close NULLS LAST)
                WHEN full20 THEN len(list_distinct(list_filter(recent, lambda v: v <= close))) END AS rolling
    FROM (SELECT *, count(*) OVER (PARTITION BY ts_code) AS n, {_FULL20} AS full20, {_LAST20} AS recent FROM bars)""")
def fn_dense_rank(spark, folder):
    return expr.factor_table(by_series(bars(spark, folder)), {
        "overall": stats.dense_rank("gap"), "rolling": stats.dense_rank("close", 20)})


column_query("fn_zscore", {
    "rolling": (lambda: stats.zscore("close", 20),
                f"coalesce((close - ({rolled('avg(close)', 'close', 20)})) / "
                f"nullif(({rolled('stddev_samp(close)', 'close', 20)}), 0), 0)"),
    "overall": (lambda: stats.zscore("gap"),
                "coalesce((gap - avg(gap) OVER (PARTITION BY ts_code)) / "
                "nullif(stddev_samp(gap) OVER (PARTITION BY ts_code), 0), 0)"),
})
column_query("fn_scale", {
    "scaled": (lambda: stats.scale("gap", 2.0, -1.0),
               "CASE WHEN max(gap) OVER p = min(gap) OVER p THEN 0 ELSE "
               "2 * (gap - min(gap) OVER p) / (max(gap) OVER p - min(gap) OVER p) - 1 END"
               .replace("OVER p", "OVER (PARTITION BY ts_code)")),
})

# -- time series ----------------------------------------------------------------------------------


def _lag(x: str, p: int) -> str:
    return f"lag({x}, {p}) OVER ({ORDERED})"


column_query("fn_delta", {
    "by5": (lambda: series.delta("close", 5), f"(close - {_lag('close', 5)}) / {_lag('close', 5)}"),
    "zero_base": (lambda: series.delta(F.col("vol") - 20, 1),
                  f"CASE WHEN {_lag('vol - 20', 1)} = 0 AND vol <> 20 THEN 0 ELSE "
                  f"(vol - 20 - {_lag('vol - 20', 1)}) / nullif({_lag('vol - 20', 1)}, 0) END"),
})
column_query("fn_delay", {"by3": (lambda: series.delay("close", 3), _lag("close", 3)),
                          "negative": (lambda: series.delay("close", -2), "close")})
column_query("fn_diff", {"by3": (lambda: series.diff("gap", 3), f"gap - {_lag('gap', 3)}")})
column_query("fn_ffill", {"filled": (lambda: series.fill_forward("gap"),
             f"last_value(gap IGNORE NULLS) OVER ({ORDERED} ROWS UNBOUNDED PRECEDING)")})
column_query("fn_bfill", {"filled": (lambda: series.fill_backward("gap"),
             f"first_value(gap IGNORE NULLS) OVER ({ORDERED} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")})
column_query("win_pct_change", {"by1": (lambda: series.pct_change("close"), f"close / {_lag('close', 1)} - 1"),
                                "by20": (lambda: series.pct_change("close", 20), f"close / {_lag('close', 20)} - 1")})
_SO_FAR = f"OVER ({ORDERED} ROWS UNBOUNDED PRECEDING)"
column_query("win_expanding", {
    "mean": (lambda: stats.expanding(F.avg, "gap", 60), f"CASE WHEN count(gap) {_SO_FAR} >= 60 THEN avg(gap) {_SO_FAR} END"),
    "std": (lambda: stats.expanding(F.stddev_samp, "gap", 60),
            f"CASE WHEN count(gap) {_SO_FAR} >= 60 THEN stddev_samp(gap) {_SO_FAR} END"),
})
column_query("win_cummax", {"peak": (lambda: series.running_max("gap"), f"max(gap) {_SO_FAR}")})
column_query("win_cumprod", {"grown": (lambda: series.running_product(1 + (F.col("close") - F.col("open")) / 10000),
                                       f"product(1 + (close - open) / 10000) {_SO_FAR}")})
column_query("win_clip", {"clipped": (lambda: series.clip(F.col("gap") - 108, -2, 2), "CASE WHEN gap IS NULL THEN NULL "
                                      "ELSE least(greatest(gap - 108, -2), 2) END")})

# -- indicators -----------------------------------------------------------------------------------

column_query("ind_ma", {"close_5": (lambda: indicators.ma("close", 5), strict("avg(close)", "close", 5)),
                        "gap_4": (lambda: indicators.ma("gap", 4), strict("avg(gap)", "gap", 4)),
                        "too_long": (lambda: indicators.ma("close", 100000), "CAST(NULL AS DOUBLE)")})
column_query("ind_wma", {"wma": (lambda: indicators.wma("gap", 10),
             f"CASE WHEN row_number() OVER ({ORDERED}) >= 10 THEN (coalesce(gap, 0) * 10 + "
             + " + ".join(f"coalesce({_lag('gap', i)}, 0) * {10 - i}" for i in range(1, 10)) + ") / 55 END")})
column_query("ind_boll", {"upper": (lambda: indicators.boll("close", 20, 2.0),
             f"({strict('avg(close)', 'close', 20)}) + 2 * ({strict('stddev_samp(close)', 'close', 20)})")})

_TR = f"""tr AS (SELECT *, greatest(high - low, abs(high - {_lag('close', 1)}), abs(low - {_lag('close', 1)})) AS rng,
       {_lag('close', 1)} AS prev FROM bars),
     tr2 AS (SELECT * REPLACE (CASE WHEN prev IS NOT NULL THEN rng END AS rng) FROM tr)"""


def with_true_range(df: DataFrame) -> DataFrame:
    return df.withColumn("rng", indicators.true_range("high", "low", "close"))


@query("ind_atr", KEY + " atr:6", uses="bars", sql=f"""{_TR}
--
SELECT trade_date, ts_code, {strict('avg(rng)', 'rng', 14)} AS atr FROM tr2""")
def ind_atr(spark, folder):
    return with_true_range(bars(spark, folder)).withColumn("atr", indicators.atr_of("rng", 14))


@query("ind_natr", KEY + " natr:6", uses="bars", sql=f"""{_TR}
--
SELECT trade_date, ts_code, ({strict('avg(rng)', 'rng', 14)}) / close * 100 AS natr FROM tr2""")
def ind_natr(spark, folder):
    return with_true_range(bars(spark, folder)).withColumn("natr", indicators.natr_of("rng", "close", 14))


@query("ind_obv", KEY + " obv:3", uses="bars", sql=f"""
    SELECT trade_date, ts_code, sum(step) {_SO_FAR} AS obv FROM (
        SELECT trade_date, ts_code, CASE WHEN row_number() OVER ({ORDERED}) = 1 THEN vol
               ELSE sign(close - {_lag('close', 1)}) * vol END AS step FROM bars)""")
def ind_obv(spark, folder):
    stepped = bars(spark, folder).withColumn("step", indicators.obv_step("close", "vol"))
    return stepped.withColumn("obv", indicators.obv_of("step"))


# The recursion walks row numbers; each step joins the next row of every series.
_NUMBERED = f"""num AS (SELECT *, row_number() OVER ({ORDERED}) AS rn,
       CASE WHEN row_number() OVER ({ORDERED}) = 1 THEN 0 ELSE close - {_lag('close', 1)} END AS move,
       max(high) OVER ({ORDERED} ROWS 8 PRECEDING) AS hh, min(low) OVER ({ORDERED} ROWS 8 PRECEDING) AS ll FROM bars)"""
_SLIM = ["trade_date", "ts_code", "high", "low", "close"]


@query("ind_ema", KEY + " ema:6", uses="bars", sql=f"""{_NUMBERED},
    walk AS (SELECT trade_date, ts_code, rn, close AS ema FROM num WHERE rn = 1
             UNION ALL SELECT n.trade_date, n.ts_code, n.rn, w.ema * (1 - 2.0 / 13) + n.close * (2.0 / 13)
             FROM walk w JOIN num n ON n.ts_code = w.ts_code AND n.rn = w.rn + 1)
--
SELECT trade_date, ts_code, ema FROM walk""")
def ind_ema(spark, folder):
    return with_recursive(bars(spark, folder).select(_SLIM), [Recursive("EMA", "ema", {"w": 12})])


@query("ind_macd", KEY + " macd:6", uses="bars", sql=f"""{_NUMBERED},
    walk AS (SELECT trade_date, ts_code, rn, close AS f, close AS s, CAST(0 AS DOUBLE) AS macd FROM num WHERE rn = 1
             UNION ALL
             SELECT trade_date, ts_code, rn, f, s, macd * 0.8 + (f - s) * 0.2 FROM (
                 SELECT n.trade_date, n.ts_code, n.rn, w.f * (11.0 / 13) + n.close * (2.0 / 13) AS f,
                        w.s * (25.0 / 27) + n.close * (2.0 / 27) AS s, w.macd
                 FROM walk w JOIN num n ON n.ts_code = w.ts_code AND n.rn = w.rn + 1))
--
SELECT trade_date, ts_code, macd FROM walk""")
def ind_macd(spark, folder):
    return with_recursive(bars(spark, folder).select(_SLIM), [Recursive("MACD", "macd")])


@query("ind_rsi", KEY + " rsi:6", uses="bars", sql=f"""{_NUMBERED},
    seed AS (SELECT ts_code, avg(greatest(move, 0)) AS up, avg(greatest(-move, 0)) AS down, count(*) AS n
             FROM num WHERE rn <= 14 GROUP BY 1),
    walk AS (SELECT num.trade_date, num.ts_code, rn, up, down FROM num JOIN seed USING (ts_code) WHERE rn = 14
             UNION ALL SELECT n.trade_date, n.ts_code, n.rn, (w.up * 13 + greatest(n.move, 0)) / 14,
                              (w.down * 13 + greatest(-n.move, 0)) / 14
             FROM walk w JOIN num n ON n.ts_code = w.ts_code AND n.rn = w.rn + 1)
--
SELECT num.trade_date, num.ts_code, CASE WHEN seed.n < 14 THEN NULL WHEN num.rn < 14 OR w.down = 0 THEN 100 - 100 / 101.0
       ELSE 100 - 100 / (1 + w.up / w.down) END AS rsi
FROM num JOIN seed USING (ts_code) LEFT JOIN walk w ON w.ts_code = num.ts_code AND w.rn = num.rn""")
def ind_rsi(spark, folder):
    return with_recursive(bars(spark, folder).select(_SLIM), [Recursive("RSI", "rsi")])


@query("ind_kdj", KEY + " k:6", uses="bars", sql=f"""{_NUMBERED},
    raw AS (SELECT trade_date, ts_code, rn, CASE WHEN rn < 9 THEN 0 WHEN hh = ll THEN 50
                   ELSE (close - ll) / (hh - ll) * 100 END AS rsv FROM num),
    walk AS (SELECT trade_date, ts_code, rn, CAST(50 AS DOUBLE) AS k FROM raw WHERE rn = 1
             UNION ALL SELECT n.trade_date, n.ts_code, n.rn, w.k * 2 / 3 + n.rsv / 3
             FROM walk w JOIN raw n ON n.ts_code = w.ts_code AND n.rn = w.rn + 1)
--
SELECT trade_date, ts_code, k FROM walk""")
def ind_kdj(spark, folder):
    return with_recursive(bars(spark, folder).select(_SLIM), [Recursive("KDJ", "k")])


@query("ind_sar", KEY + " sar:6", uses="bars", sql=f"""{_NUMBERED},
    pair AS (SELECT a.*, b.high AS h2, b.low AS l2, a.high AS ph, a.low AS pl FROM num a
             LEFT JOIN num b ON b.ts_code = a.ts_code AND b.rn = a.rn + 1),
    walk AS (SELECT trade_date, ts_code, rn, high AS ph, low AS pl, CAST(0.02 AS DOUBLE) AS af, h2 >= high AS up,
                    CASE WHEN h2 IS NULL THEN NULL WHEN h2 >= high THEN greatest(high, h2) ELSE least(low, l2) END AS ep,
                    CASE WHEN h2 IS NULL THEN NULL WHEN h2 >= high THEN least(low, l2) ELSE greatest(high, h2) END AS sar
             FROM pair WHERE rn = 1
             UNION ALL
             SELECT trade_date, ts_code, rn, h, l,
                    CASE WHEN flip THEN 0.02 WHEN (up AND h > ep) OR (NOT up AND l < ep) THEN least(af + 0.02, 0.2) ELSE af END,
                    up <> flip,
                    CASE WHEN flip THEN (CASE WHEN up THEN l ELSE h END)
                         WHEN up THEN greatest(ep, h) ELSE least(ep, l) END,
                    CASE WHEN flip THEN ep ELSE t END
             FROM (SELECT *, CASE WHEN up THEN l < t ELSE h > t END AS flip FROM (
                 SELECT n.trade_date, n.ts_code, n.rn, n.high AS h, n.low AS l, w.af, w.up, w.ep,
                        CASE WHEN w.up THEN least(w.sar + w.af * (w.ep - w.sar), w.pl, n.low)
                             ELSE greatest(w.sar + w.af * (w.ep - w.sar), w.ph, n.high) END AS t
                 FROM walk w JOIN num n ON n.ts_code = w.ts_code AND n.rn = w.rn + 1)))
--
SELECT trade_date, ts_code, sar FROM walk""")
def ind_sar(spark, folder):
    return with_recursive(bars(spark, folder).select(_SLIM), [Recursive("SAR", "sar")])


# -- two series -----------------------------------------------------------------------------------

column_query("fn_corr", {
    "corr": (lambda: series.corr("close", "vol", 20), strict("corr(close, vol)", "close", 20)),
    "gaps": (lambda: series.corr("gap", "vol", 4), strict("corr(gap, vol)", "gap", 4)),
})
column_query("fn_cov", {"cov": (lambda: series.covariance("close", "vol", 20), strict("covar_samp(close, vol)", "close", 20))})
column_query("fn_beta", {"beta": (lambda: series.beta("close", "vol", 20),
             strict("coalesce(covar_samp(close, vol) OVER f / nullif(var_samp(vol) OVER f, 0), 0)", "close", 20)
             .replace("OVER f", f"OVER ({ORDERED} ROWS 19 PRECEDING)")
             .replace(f", 0) OVER ({ORDERED} ROWS 19 PRECEDING)", ", 0)"))})

# -- math -----------------------------------------------------------------------------------------


def _d() -> Column:
    return F.col("gap") - 108


column_query("fn_abs", {"value": (lambda: scalar.absolute(_d()), "abs(gap - 108)")})
column_query("fn_sign", {"value": (lambda: scalar.sign(_d()), "sign(gap - 108)")})
column_query("fn_log", {"value": (lambda: scalar.log(_d()), "ln(CASE WHEN gap - 108 > 0 THEN gap - 108 ELSE 1e-10 END)")})
column_query("fn_log10", {"value": (lambda: scalar.log10(_d()), "log10(CASE WHEN gap - 108 > 0 THEN gap - 108 ELSE 1e-10 END)")})
column_query("fn_exp", {"value": (lambda: scalar.exp(_d() / 4), "exp((gap - 108) / 4)")})
column_query("fn_sqrt", {"value": (lambda: scalar.sqrt(_d()), "sqrt(CASE WHEN gap - 108 >= 0 THEN gap - 108 ELSE 0 END)")})
column_query("fn_power", {"value": (lambda: scalar.power(_d()), "pow(gap - 108, 2)"),
                          "root": (lambda: scalar.power(_d(), 0.5), "CASE WHEN gap - 108 >= 0 THEN sqrt(gap - 108) END")})
column_query("fn_sign_pow", {"value": (lambda: scalar.sign_pow(_d()), "sign(gap - 108) * sqrt(abs(gap - 108))")})
column_query("cs_abs", {"value": (lambda: scalar.absolute(F.col("close") - F.col("high")), "abs(close - high)")})

# -- cross-section --------------------------------------------------------------------------------


@query("cs_rank", KEY + " value:6", uses="bars", sql="""
    SELECT trade_date, ts_code, row_number() OVER (PARTITION BY trade_date ORDER BY gap NULLS LAST, ts_code)
           / count(*) OVER (PARTITION BY trade_date) AS value FROM bars""")
def cs_rank(spark, folder):
    return section.ordinal_rank(bars(spark, folder).select("trade_date", "ts_code", "gap"), "gap", "value")


@query("cs_zscore", KEY + " value:6", uses="bars", sql="""
    SELECT trade_date, ts_code, coalesce((gap - avg(gap) OVER d) / nullif(stddev_samp(gap) OVER d, 0), 0) AS value
    FROM bars WINDOW d AS (PARTITION BY trade_date)""")
def cs_zscore(spark, folder):
    return section.zscore(bars(spark, folder), "gap", "value")


@query("cs_scale", KEY + " value:6", uses="bars", sql="""
    SELECT trade_date, ts_code, CASE WHEN max(gap) OVER d = min(gap) OVER d THEN 0.5
           ELSE (gap - min(gap) OVER d) / (max(gap) OVER d - min(gap) OVER d) END AS value
    FROM bars WINDOW d AS (PARTITION BY trade_date)""")
def cs_scale(spark, folder):
    return section.scale(bars(spark, folder), "gap", "value")


@query("cs_demedian", KEY + " value:6", uses="bars", sql="""
    SELECT trade_date, ts_code, gap - median(gap) OVER (PARTITION BY trade_date) AS value FROM bars""")
def cs_demedian(spark, folder):
    return section.demedian(bars(spark, folder).select("trade_date", "ts_code", "gap"), "gap", "value")


@query("cs_pct_rank", KEY + " value:6", uses="bars", sql="""
    SELECT trade_date, ts_code, CASE WHEN vol IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date ORDER BY vol)
           + (count(*) OVER (PARTITION BY trade_date, vol) - 1) / 2) / count(vol) OVER (PARTITION BY trade_date) END AS value
    FROM bars""")
def cs_pct_rank(spark, folder):
    return section.pct_rank(bars(spark, folder).select("trade_date", "ts_code", "vol"), "vol", "value")


# -- conditions and ratios ------------------------------------------------------------------------

_TRUE = "coalesce({c} <> 0, true)"
column_query("fn_when", {
    "picked": (lambda: scalar.when(F.col("gap") - 108, "open", "low"), f"CASE WHEN {_TRUE.format(c='(gap - 108)')} THEN open ELSE low END"),
    "or_zero": (lambda: scalar.when(expr.gt("gap", 108), "open"), "CASE WHEN gap > 108 THEN open ELSE 0 END"),
})
column_query("fn_filter", {"within": (lambda: scalar.keep_between("gap", 104, 112), "CASE WHEN gap BETWEEN 104 AND 112 THEN gap END"),
                           "low_only": (lambda: scalar.keep_between("close", low=110), "CASE WHEN close >= 110 THEN close END")})
column_query("fn_keep", {"kept": (lambda: scalar.keep_every("close", 3),
             f"CASE WHEN (row_number() OVER ({ORDERED}) - 1) % 3 = 0 THEN close END")})
column_query("fin_leverage", {"value": (lambda: scalar.leverage("amount", F.col("vol") - 20), "amount / nullif(vol - 20, 0)")}, 4)
column_query("fin_debt_ratio", {"value": (lambda: scalar.debt_ratio("vol", "amount"), "vol / nullif(amount, 0)")}, 8)
column_query("fin_growth", {"value": (lambda: scalar.growth(F.col("vol") - 20), f"(vol - 20) / nullif({_lag('vol - 20', 4)}, 0) - 1")})
column_query("fin_roic", {"value": (lambda: scalar.roic(F.col("close") - F.col("open"), F.col("vol") - 10),
                                    "(close - open) / nullif(vol - 10, 0)")})

# -- expression operators -------------------------------------------------------------------------

column_query("expr_var", {"close": (lambda: F.col("close"), "close"), "gap": (lambda: F.col("gap"), "gap")})
column_query("expr_literal", {"sci": (lambda: expr.lit(1.5e-3) * F.col("close"), "1.5e-3 * close"),
                              "yes": (lambda: expr.lit(True), "1.0"), "no": (lambda: expr.lit(False), "0.0"),
                              "word": (lambda: expr.lit("hs300"), "'hs300'")}, kinds={"word": "s"})
column_query("expr_arith", {"value": (lambda: expr.add(expr.mul("gap", 2.0), expr.sub("open", "vol")), "gap * 2 + open - vol")})
column_query("expr_div", {"value": (lambda: expr.div("gap", F.col("vol") - 20), "coalesce(gap / nullif(vol - 20, 0), 0)")})
column_query("expr_mod", {
    "value": (lambda: expr.mod(_d(), 3.0), "(gap - 108) - 3 * floor((gap - 108) / 3)"),
    "negative": (lambda: expr.mod(_d(), F.col("vol") - 20), "(gap - 108) - (vol - 20) * floor((gap - 108) / nullif(vol - 20, 0))"),
})
column_query("expr_pow", {"value": (lambda: expr.power(_d(), 0.5), "CASE WHEN gap >= 108 THEN sqrt(gap - 108) END"),
                          "square": (lambda: expr.power("gap", 2.0), "gap * gap")}, 4)
column_query("expr_compare", {
    "gt": (lambda: expr.gt("gap", 108), "CASE WHEN gap > 108 THEN 1 ELSE 0 END"),
    "ge": (lambda: expr.ge("vol", 20), "CASE WHEN vol >= 20 THEN 1 ELSE 0 END"),
    "lt": (lambda: expr.lt("gap", "open"), "CASE WHEN gap < open THEN 1 ELSE 0 END"),
    "le": (lambda: expr.le("gap", "open"), "CASE WHEN gap <= open THEN 1 ELSE 0 END"),
    "eq": (lambda: expr.eq("gap", "close"), "CASE WHEN gap = close THEN 1 ELSE 0 END"),
    "ne": (lambda: expr.ne("gap", "close"), "CASE WHEN coalesce(gap <> close, true) THEN 1 ELSE 0 END"),
}, 0)
_A, _B = "coalesce(gap - 108 <> 0, true)", "(vol - 20 <> 0)"
column_query("expr_logic", {
    "conj": (lambda: expr.both(_d(), F.col("vol") - 20), f"CASE WHEN {_A} AND {_B} THEN 1 ELSE 0 END"),
    "disj": (lambda: expr.either(F.col("gap") * 0, F.col("vol") - 20),
               f"CASE WHEN coalesce(gap * 0 <> 0, true) OR {_B} THEN 1 ELSE 0 END"),
    "negated": (lambda: expr.negate(F.col("gap") * 0), "CASE WHEN coalesce(gap * 0 <> 0, true) THEN 0 ELSE 1 END"),
}, 0)
column_query("expr_neg", {"value": (lambda: -F.col("gap"), "-gap")})
column_query("expr_if", {"no_else": (lambda: expr.choose(expr.gt("gap", 108), "gap"), "CASE WHEN gap > 108 THEN gap END"),
                         "with_else": (lambda: expr.choose(F.col("gap") * 0, "open", "low"),
                                       "CASE WHEN coalesce(gap * 0 <> 0, true) THEN open ELSE low END")})
_LIB = FunctionLibrary()
column_query("expr_call", {"mean": (lambda: _LIB.call("mean", "close", 20), rolled("avg(close)", "close", 20)),
                           "sign": (lambda: _LIB.call("Sign", _d()), "sign(gap - 108)")})
_LIB.register("spread", lambda a, b: expr.div(expr.sub(a, b), b))
column_query("udf_register", {"spread": (lambda: _LIB.call("SPREAD", "high", "low"), "(high - low) / low")})
column_query("factor_table", {
    "mom20": (lambda: series.delta("close", 20), f"close / {_lag('close', 20)} - 1"),
    "vola20": (lambda: expr.div(stats.std("close", 20), "close"),
               f"coalesce(({rolled('stddev_samp(close)', 'close', 20)}) / close, 0)"),
    "volume_ratio": (lambda: expr.div("vol", stats.mean("vol", 20)),
                     f"coalesce(vol / ({rolled('avg(vol)', 'vol', 20)}), 0)"),
    "pv_corr": (lambda: series.corr("close", "vol", 20), strict("corr(close, vol)", "close", 20)),
})
