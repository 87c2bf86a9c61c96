"""Queries for portfolio construction, accounting and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import series, stats
from barloom.functions.core import SERIES, ratio
from barloom.operators import panel, portfolio
from barloom.plans.base import query
from barloom.plans.function_queries import rolled, strict
from barloom.plans.tables import TABLES
from barloom.sources.panel_tables import BY_SUPPLIER, bars, returns, series_bars, stored_returns

KEY = "trade_date:d ts_code"
ORDERED = "PARTITION BY ts_code ORDER BY trade_date"
N = 5

TABLES.update({
    "signals": ("rets", f"""
        SELECT trade_date, ts_code, close / lag(close, 5) OVER ({ORDERED}) - 1 AS signal FROM rets"""),
    "rebal": ("days", """
        SELECT rebalance_date, row_number() OVER (ORDER BY rebalance_date) AS seq FROM (
            SELECT max(trade_date) AS rebalance_date FROM days GROUP BY date_trunc('month', trade_date)
            UNION SELECT min(trade_date) FROM days)"""),
    "weights": ("signals rebal", f"""
        SELECT rebalance_date, seq, ts_code, 1.0 / count(*) OVER (PARTITION BY rebalance_date) AS weight FROM (
            SELECT r.rebalance_date, seq, ts_code, row_number() OVER (PARTITION BY r.rebalance_date ORDER BY signal DESC, ts_code) AS rn
            FROM signals s JOIN rebal r ON s.trade_date = r.rebalance_date WHERE signal IS NOT NULL) WHERE rn <= {N}"""),
    "active": ("days rebal", """
        SELECT trade_date, (SELECT max(rebalance_date) FROM rebal WHERE rebalance_date < trade_date) AS rebalance_date FROM days"""),
    "daily": ("rets active weights", """
        SELECT d.trade_date, coalesce(ret, 0) AS ret FROM days d LEFT JOIN (
            SELECT r.trade_date, sum(w.weight * coalesce(r.ret, 0)) AS ret
            FROM rets r JOIN active a ON a.trade_date = r.trade_date
            JOIN weights w ON w.rebalance_date = a.rebalance_date AND w.ts_code = r.ts_code GROUP BY 1) p USING (trade_date)"""),
    "turns": ("weights rebal", """
        SELECT rebalance_date AS trade_date, turnover FROM (
            SELECT seq, sum(d) / 2 AS turnover FROM (
                SELECT seq, ts_code, abs(sum(n) - sum(o)) AS d FROM (
                    SELECT seq, ts_code, weight AS n, 0 AS o FROM weights UNION ALL SELECT seq + 1, ts_code, 0, weight FROM weights)
                GROUP BY 1, 2) GROUP BY 1) JOIN rebal USING (seq) WHERE seq > 1"""),
    "curve": ("daily turns", """
        SELECT trade_date, ret, coalesce(turnover, 0) AS turnover,
               product((1 + ret) * (1 - least(coalesce(turnover, 0) * 0.0031, 0.05))) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS nav
        FROM daily LEFT JOIN turns USING (trade_date)"""),
})


def momentum(r):
    return r.select("trade_date", "ts_code", series.pct_change("close", 5).alias("signal"))


def parts(spark, folder):
    """Returns, rebalance dates and weights of the monthly momentum portfolio."""
    r = stored_returns(spark, folder)
    rb = portfolio.rebalance_dates(panel.dates(r))
    return r, rb, portfolio.topn_weights(momentum(r), rb, N)


def curve_of(spark, folder, r=None):
    r = r if r is not None else stored_returns(spark, folder)
    return portfolio.backtest(r, momentum(r), N)


METRIC_COLS = ("trading_days:i final_nav:6 cum_return:6 annual_return:6 annual_volatility:6 sharpe:6 max_drawdown:6 var_95:6 cvar_95:6 "
               "avg_turnover:6 total_cost:2 daily_win_rate:6 profit_loss_ratio:6 calmar:6 cost_ratio:8 status")


def metrics_sql(source: str, by: str = "") -> str:
    """SQL of the performance figures over (by, trade_date, ret, turnover, nav)."""
    part = f"PARTITION BY {by}" if by else ""
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    few = ", ".join(f"CASE WHEN trading_days >= 5 THEN {c} END AS {c}" for c in (w.split(":")[0] for w in METRIC_COLS.split()) if c not in ("trading_days", "status"))
    return f"""
    SELECT * REPLACE ({few}) FROM (
    SELECT *, CASE WHEN abs(max_drawdown) > 1e-10 THEN annual_return / abs(max_drawdown) ELSE 0 END AS calmar, total_cost / 1000000 AS cost_ratio,
           CASE WHEN trading_days < 5 THEN 'too_few_rows' ELSE 'ok' END AS status FROM (
        SELECT {keys}count(*) AS trading_days, arg_max(nav, trade_date) AS final_nav,
               arg_max(nav, trade_date) / arg_min(nav, trade_date) - 1 AS cum_return,
               pow(arg_max(nav, trade_date) / arg_min(nav, trade_date), 252.0 / count(*)) - 1 AS annual_return,
               stddev_samp(ret) * sqrt(252) AS annual_volatility, avg(ret) / stddev_samp(ret) * sqrt(252) AS sharpe,
               min(nav / peak - 1) AS max_drawdown, any_value(q) AS var_95, avg(ret) FILTER (ret <= q) AS cvar_95, avg(turnover) AS avg_turnover,
               sum(prev * turnover * 1000000 * 0.0031) AS total_cost, count(*) FILTER (ret > 0) / count(*) AS daily_win_rate,
               coalesce(avg(ret) FILTER (ret > 0), 0) / coalesce(abs(avg(ret) FILTER (ret < 0)), 1) AS profit_loss_ratio
        FROM (SELECT *, max(nav) OVER ({part} ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS peak, quantile_cont(ret, 0.05) OVER ({part}) AS q,
                     coalesce(lag(nav) OVER ({part} ORDER BY trade_date), 1) AS prev FROM {source}) {group}))"""


@query("rebalance_dates", "freq rebalance_date:d", uses="days", sql="""
    SELECT 'M' AS freq, max(trade_date) AS rebalance_date FROM days GROUP BY date_trunc('month', trade_date)
    UNION SELECT 'M', min(trade_date) FROM days
    UNION SELECT 'W', max(trade_date) FROM days GROUP BY date_trunc('week', trade_date)
    UNION SELECT 'W', min(trade_date) FROM days
    UNION SELECT 'D', trade_date FROM days""")
def rebalance_dates(spark, folder):
    d = panel.dates(bars(spark, folder))
    m, w, day = (portfolio.rebalance_dates(d, f).withColumn("freq", F.lit(f)) for f in "MWD")
    return m.unionByName(w).unionByName(day)


@query("topn_per_date", KEY + " signal:6", uses="signals", sql=f"""
    SELECT trade_date, ts_code, signal FROM signals WHERE signal IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY signal DESC, ts_code) <= {N}""")
def topn_per_date(spark, folder):
    return portfolio.top_n(momentum(returns(spark, folder)), "signal", N, ["trade_date"])


@query("topn_weights", "rebalance_date:d ts_code weight:6", uses="signals rebal", sql=f"""
    SELECT rebalance_date, ts_code, 1.0 / count(*) OVER (PARTITION BY rebalance_date) AS weight FROM (
        SELECT rebalance_date, ts_code, row_number() OVER (PARTITION BY rebalance_date ORDER BY signal DESC, ts_code) AS rn
        FROM signals s JOIN rebal r ON s.trade_date = r.rebalance_date
        WHERE signal IS NOT NULL AND (ts_code, trade_date) NOT IN (SELECT (ts_code, trade_date) FROM bars WHERE vol > 45)) WHERE rn <= {N}""")
def topn_weights(spark, folder):
    r = stored_returns(spark, folder)
    banned = r.where("vol > 45").select("trade_date", "ts_code")
    return portfolio.topn_weights(momentum(r), portfolio.rebalance_dates(panel.dates(r)), N, blacklist=banned)


@query("join_asof_weights", "trade_date:d rebalance_date:d ts_code weight:6", uses="active weights", sql="""
    SELECT a.trade_date, a.rebalance_date, ts_code, weight FROM active a JOIN weights w USING (rebalance_date)""")
def join_asof_weights(spark, folder):
    r, rb, w = parts(spark, folder)
    return portfolio.in_force(panel.dates(r), rb).join(w, "rebalance_date")


@query("portfolio_returns", "trade_date:d ret:6", uses="daily", sql="SELECT * FROM daily")
def portfolio_returns(spark, folder):
    r, rb, w = parts(spark, folder)
    return portfolio.portfolio_returns(r, w, rb)


@query("turnover", "trade_date:d turnover:6", uses="turns", sql="SELECT * FROM turns")
def turnover(spark, folder):
    _, rb, w = parts(spark, folder)
    return portfolio.turnover(w, rb)


@query("rebalance_cost", "trade_date:d cost:8", uses="turns", sql="SELECT trade_date, least(turnover * 0.0031, 0.05) AS cost FROM turns")
def rebalance_cost(spark, folder):
    _, rb, w = parts(spark, folder)
    return portfolio.turnover(w, rb).withColumn("cost", portfolio.cost_ratio(F.col("turnover")))


@query("trade_cost", "trade_date:d ts_code side commission:6 slippage:6 stamp:6 impact:6 total:6", uses="bars", sql=f"""
    SELECT *, commission + slippage + stamp + impact AS total FROM (
        SELECT trade_date, ts_code, side, greatest(amount * 0.0003, 5) AS commission, amount * 0.001 AS slippage,
               CASE WHEN side = 'sell' THEN amount * 0.0005 ELSE 0 END AS stamp,
               CASE WHEN amount > 0 AND adv > 0 THEN 0.1 * sqrt(amount / adv) * amount ELSE 0 END AS impact
        FROM (SELECT *, CASE WHEN close > open + 1 THEN 'sell' ELSE 'buy' END AS side, {strict('avg(amount)', 'amount', 20)} AS adv FROM bars))""")
def trade_cost(spark, folder):
    b = bars(spark, folder).withColumns({
        "side": F.when(F.col("close") > F.col("open") + 1, F.lit("sell")).otherwise(F.lit("buy")), "adv": stats.rolling_mean("amount", 20)})
    return portfolio.trade_costs(b)


@query("nav", "trade_date:d ret:6 turnover:6 nav:6", uses="curve", sql="SELECT * FROM curve")
def nav(spark, folder):
    return curve_of(spark, folder)


@query("backtest_metrics", METRIC_COLS, uses="curve", sql=metrics_sql("curve"))
def backtest_metrics(spark, folder):
    return portfolio.metrics(curve_of(spark, folder))


@query("total_cost", "total_cost:2", uses="curve", sql="""
    SELECT sum(coalesce(prev, 1) * turnover * 1000000 * 0.0031) AS total_cost FROM (SELECT *, lag(nav) OVER (ORDER BY trade_date) AS prev FROM curve)""")
def total_cost(spark, folder):
    return portfolio.total_cost(curve_of(spark, folder))


@query("benchmark_compare", "days:i benchmark_return:6 excess_return:6 information_ratio:6 status", uses="curve", sql="""
    b AS (SELECT trade_date, price / lag(price) OVER (ORDER BY trade_date) - 1 AS bench FROM (SELECT trade_date, avg(close) AS price FROM bars GROUP BY 1))
--
SELECT days, 'ok' AS status, benchmark_return, information_ratio, (SELECT pow(arg_max(nav, trade_date) / arg_min(nav, trade_date), 252.0 / count(*)) - 1 FROM curve) - benchmark_return AS excess_return FROM (
    SELECT count(*) AS days, pow(product(1 + bench), 252.0 / count(*)) - 1 AS benchmark_return,
           avg(ret - bench) / stddev_samp(ret - bench) * sqrt(252) AS information_ratio FROM curve JOIN b USING (trade_date) WHERE bench IS NOT NULL)""")
def benchmark_compare(spark, folder):
    r = stored_returns(spark, folder)
    return portfolio.benchmark_compare(curve_of(spark, folder, r), r)


@query("equal_weight_baseline", "rebalance_date:d ts_code weight:6", uses="rebal", sql=f"""
    SELECT rebalance_date, ts_code, 1.0 / count(*) OVER (PARTITION BY rebalance_date) AS weight FROM (
        SELECT rebalance_date, ts_code, row_number() OVER (PARTITION BY rebalance_date ORDER BY ts_code) AS rn
        FROM bars JOIN rebal ON trade_date = rebalance_date) WHERE rn <= {N}""")
def equal_weight_baseline(spark, folder):
    b = bars(spark, folder)
    return portfolio.topn_weights(portfolio.equal_weight_signal(b), portfolio.rebalance_dates(panel.dates(b)), N)


_MANY = f"""sig AS (SELECT trade_date, ts_code, 'momentum' AS strategy, signal FROM signals
                    UNION ALL SELECT trade_date, ts_code, 'reversal', -signal FROM signals
                    UNION ALL SELECT trade_date, ts_code, 'equal', 1.0 FROM rets),
    w AS (SELECT strategy, rebalance_date, seq, ts_code, 1.0 / count(*) OVER (PARTITION BY strategy, rebalance_date) AS weight FROM (
            SELECT strategy, rebalance_date, seq, ts_code, row_number() OVER (PARTITION BY strategy, rebalance_date ORDER BY signal DESC, ts_code) AS rn
            FROM sig s JOIN rebal r ON s.trade_date = r.rebalance_date WHERE signal IS NOT NULL) WHERE rn <= {N}),
    d AS (SELECT strategy, trade_date, coalesce(ret, 0) AS ret FROM (SELECT DISTINCT strategy FROM w) CROSS JOIN days LEFT JOIN (
            SELECT strategy, r.trade_date, sum(w.weight * coalesce(r.ret, 0)) AS ret FROM rets r JOIN active a ON a.trade_date = r.trade_date
            JOIN w ON w.rebalance_date = a.rebalance_date AND w.ts_code = r.ts_code GROUP BY 1, 2) USING (strategy, trade_date)),
    t AS (SELECT strategy, rebalance_date AS trade_date, turnover FROM (SELECT strategy, seq, sum(d) / 2 AS turnover FROM (
            SELECT strategy, seq, ts_code, abs(sum(n) - sum(o)) AS d FROM (SELECT strategy, seq, ts_code, weight AS n, 0 AS o FROM w
            UNION ALL SELECT strategy, seq + 1, ts_code, 0, weight FROM w) GROUP BY 1, 2, 3) GROUP BY 1, 2) JOIN rebal USING (seq) WHERE seq > 1),
    c AS (SELECT strategy, trade_date, ret, coalesce(turnover, 0) AS turnover, product((1 + ret) * (1 - least(coalesce(turnover, 0) * 0.0031, 0.05)))
            OVER (PARTITION BY strategy ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS nav FROM d LEFT JOIN t USING (strategy, trade_date))
--
"""


def three_signals(r):
    m = momentum(r)
    return (m.withColumn("strategy", F.lit("momentum"))
            .unionByName(m.withColumns({"signal": -F.col("signal"), "strategy": F.lit("reversal")}))
            .unionByName(portfolio.equal_weight_signal(r).withColumn("strategy", F.lit("equal"))))


@query("compare_strategies", "strategy " + METRIC_COLS, uses="signals rebal active rets", sql=_MANY + metrics_sql("c", "strategy"))
def compare_strategies(spark, folder):
    r = stored_returns(spark, folder)
    return portfolio.compare_strategies(r, three_signals(r), N)


@query("strategy_ranking", "place:i strategy sharpe:2", uses="signals rebal active rets", sql=_MANY + f"""
    SELECT row_number() OVER (ORDER BY round(sharpe, 2) DESC, strategy) AS place, strategy, sharpe FROM ({metrics_sql("c", "strategy")})""")
def strategy_ranking(spark, folder):
    from pyspark.sql import Window
    r = stored_returns(spark, folder)
    table_ = portfolio.compare_strategies(r, three_signals(r), N)
    order = Window.partitionBy(F.lit(0)).orderBy(F.round("sharpe", 2).desc(), "strategy")
    return table_.withColumn("place", F.row_number().over(order))


@query("oof_signal", KEY + " signal:6", uses="bars", sql="SELECT trade_date, ts_code, CASE WHEN vol > 30 THEN close END AS signal FROM bars")
def oof_signal(spark, folder):
    b = bars(spark, folder)
    predicted = b.where("vol > 30").select("trade_date", "ts_code", F.col("close").alias("prediction"))
    return portfolio.oof_signal(b, predicted)


_RANKED = "CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY trade_date ORDER BY {c} NULLS LAST) + (count(*) OVER (PARTITION BY trade_date, {c}) - 1) / 2) / count({c}) OVER (PARTITION BY trade_date) END"
TABLES["composite_parts"] = ("rets", f"""
    SELECT *, close / lag(close, 20) OVER ({ORDERED}) - 1 AS mom20,
           coalesce(({rolled('stddev_samp(close)', 'close', 20)}) / close, 0) AS vola20,
           coalesce(vol / ({rolled('avg(vol)', 'vol', 20)}), 0) AS volume_ratio FROM rets""")
TABLES["composite"] = ("composite_parts", f"""
    SELECT trade_date, ts_code, {_RANKED.format(c='volume_ratio')} - {_RANKED.format(c='mom20')} - {_RANKED.format(c='vola20')} AS signal FROM composite_parts""")


def composite_factors(r, on=SERIES):
    return r.select("trade_date", "ts_code", series.pct_change("close", 20, on).alias("mom20"),
                    F.coalesce(ratio(stats.std("close", 20, on), "close"), F.lit(0.0)).alias("vola20"),
                    F.coalesce(ratio("vol", stats.mean("vol", 20, on)), F.lit(0.0)).alias("volume_ratio"))


def composite(factors):
    return portfolio.composite_signal(factors, ["volume_ratio"], ["mom20", "vola20"])


@query("composite_signal", KEY + " signal:6", uses="composite", sql="SELECT * FROM composite")
def composite_signal(spark, folder):
    return composite(composite_factors(series_bars(spark, folder), BY_SUPPLIER))


_FLAGSHIP_TABLES = {  # the weights-to-curve chain again, on the composite signal
    "f_weights": ("composite rebal", TABLES["weights"][1].replace("FROM signals s", "FROM (SELECT trade_date, ts_code, round(signal, 9) AS signal FROM composite) s")),
    "f_daily": ("rets active f_weights", TABLES["daily"][1].replace("JOIN weights w", "JOIN f_weights w")),
    "f_turns": ("f_weights rebal", TABLES["turns"][1].replace("FROM weights", "FROM f_weights")),
    "f_curve": ("f_daily f_turns", TABLES["curve"][1].replace("FROM daily", "FROM f_daily").replace("JOIN turns", "JOIN f_turns")),
}
TABLES.update(_FLAGSHIP_TABLES)


@query("flagship_backtest", METRIC_COLS, uses="f_curve", sql=metrics_sql("f_curve"))
def flagship_backtest(spark, folder):
    r = stored_returns(spark, folder)
    rebalances = portfolio.rebalance_dates(panel.dates(r))
    signal = composite(portfolio.at_rebalances(composite_factors(r), rebalances)).withColumn("signal", F.round("signal", 9))
    return portfolio.metrics(portfolio.backtest(r, signal, N))


_PERIODS = f"""p AS (SELECT *, CAST(floor((day_no - 61) / 5) AS INTEGER) AS period FROM days WHERE day_no > 60),
    f AS (SELECT CAST((day_no - 60) / 5 AS INTEGER) AS period, trade_date AS pick_date FROM days WHERE day_no >= 60 AND (day_no - 60) % 5 = 0),
    used AS (SELECT * FROM f WHERE period IN (SELECT period FROM p)),
    picks AS (SELECT period, ts_code FROM (SELECT period, ts_code, row_number() OVER (PARTITION BY period ORDER BY signal DESC, ts_code) AS rn
              FROM signals JOIN used ON trade_date = pick_date WHERE signal IS NOT NULL) WHERE rn <= {N}),
    seqs AS (SELECT period, row_number() OVER (ORDER BY period) AS k, n FROM (SELECT period, count(*) AS n FROM picks GROUP BY 1)),
    both_of AS (SELECT a.k, count(*) AS c FROM (SELECT k, ts_code FROM picks JOIN seqs USING (period)) a
                JOIN (SELECT k, ts_code FROM picks JOIN seqs USING (period)) b ON b.k = a.k - 1 AND a.ts_code = b.ts_code GROUP BY 1),
    turn AS (SELECT s.period, CASE WHEN s.k = 1 THEN 1.0 ELSE (s.n + o.n - 2 * coalesce(c, 0)) / s.n END AS turnover
             FROM seqs s LEFT JOIN seqs o ON o.k = s.k - 1 LEFT JOIN both_of ON both_of.k = s.k),
    hp AS (SELECT period, pick_date, turnover, product(1 + r - turnover * 0.001 / 5) - 1 AS period_ret FROM (
             SELECT period, pick_date, trade_date, avg(ret) AS r FROM rets JOIN p USING (trade_date) JOIN used USING (period)
             JOIN picks USING (period, ts_code) GROUP BY 1, 2, 3) JOIN turn USING (period) WHERE r IS NOT NULL GROUP BY 1, 2, 3)
--
"""


@query("holding_period_returns", "period:i pick_date:d turnover:6 period_ret:6", uses="signals days", sql=_PERIODS + "SELECT * FROM hp")
def holding_period_returns(spark, folder):
    r = stored_returns(spark, folder)
    return portfolio.holding_period_returns(r, momentum(r), N)


@query("holding_period_annual", "n_periods:i total_return:6 annual_return:6", uses="signals days", sql=_PERIODS + """
    SELECT count(*) AS n_periods, product(1 + period_ret) - 1 AS total_return, pow(product(1 + period_ret), 252.0 / (count(*) * 5)) - 1 AS annual_return FROM hp""")
def holding_period_annual(spark, folder):
    r = stored_returns(spark, folder)
    return portfolio.annualized_periods(portfolio.holding_period_returns(r, momentum(r), N))


@query("set_symdiff_turnover", "period:i turnover:6", uses="signals days", sql=_PERIODS + "SELECT * FROM turn")
def set_symdiff_turnover(spark, folder):
    r = stored_returns(spark, folder)
    firsts = portfolio.holding_periods(panel.dates(r)).select("period", F.col("pick_date").alias("trade_date")).distinct()
    return portfolio.set_turnover(portfolio.top_n(momentum(r).join(firsts, "trade_date"), "signal", N, ["period"]))
