"""Queries for value at risk, stress scenarios and the risk rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import series
from barloom.operators import portfolio, risk
from barloom.plans.base import query
from barloom.plans.portfolio_queries import N, curve_of
from barloom.plans.research_queries import factor_frame, holdings, weighted
from barloom.plans.tables import TABLES
from barloom.session import materialize
from barloom.sources.panel_tables import returns, stored_returns

KEY = "trade_date:d ts_code"
ORDERED = "PARTITION BY ts_code ORDER BY trade_date"
VAR_COLS = "var_95:6 var_99:6 cvar_95:6 cvar_99:6"
# Limits tight enough for the smooth test prices to set every rule off.
TIGHT = risk.RiskLimits(daily_loss_limit=-0.01, max_monthly_loss=-0.005, stop_loss_portfolio=-0.02, max_positions=15,
                        max_factor_exposure=0.005, max_total_exposure=2.5)

TABLES["pnl"] = ("holdings", "SELECT trade_date, sum(weight * coalesce(ret, 0)) AS pnl FROM holdings GROUP BY 1")
TABLES["sectors"] = ("holdings", "SELECT trade_date, industry, sum(weight) AS sector_weight FROM holdings GROUP BY 1, 2")


@query("var_historical", "ts_code method " + VAR_COLS, uses="rets", sql="""
    q AS (SELECT ts_code, count(ret) AS n, quantile_cont(ret, 0.05) AS q5, quantile_cont(ret, 0.01) AS q1 FROM rets WHERE ret IS NOT NULL GROUP BY 1)
--
SELECT ts_code, 'historical' AS method, CASE WHEN n < 20 THEN 0 ELSE q5 END AS var_95, CASE WHEN n < 20 THEN 0 ELSE q1 END AS var_99,
       CASE WHEN n < 20 THEN 0 ELSE avg(ret) FILTER (ret <= q5) END AS cvar_95, CASE WHEN n < 20 THEN 0 ELSE avg(ret) FILTER (ret <= q1) END AS cvar_99
FROM rets JOIN q USING (ts_code) GROUP BY ts_code, n, q5, q1""")
def var_historical(spark, folder):
    return risk.var_historical(returns(spark, folder).select("ts_code", "ret"), ["ts_code"])


_PARAM = """SELECT {key}avg(ret) + stddev_samp(ret) * -1.6448536269514729 AS var_95, avg(ret) + stddev_samp(ret) * -2.3263478740408408 AS var_99,
    avg(ret) + stddev_samp(ret) * {sign}0.10313564037537128 / 0.05 AS cvar_95, avg(ret) + stddev_samp(ret) * {sign}0.026652142203457764 / 0.01 AS cvar_99
    FROM {src} {group}"""


@query("var_parametric", "ts_code tail " + VAR_COLS, uses="rets", sql=(
    _PARAM.format(key="ts_code, 'below' AS tail, ", sign="-", src="rets", group="GROUP BY ts_code") + " UNION ALL "
    + _PARAM.format(key="ts_code, 'added' AS tail, ", sign="", src="rets", group="GROUP BY ts_code")))
def var_parametric(spark, folder):
    r = returns(spark, folder).select("ts_code", "ret")
    return risk.var_parametric(r, ["ts_code"]).withColumn("tail", F.lit("below")).unionByName(
        risk.var_parametric(r, ["ts_code"], tail_sign=1.0).withColumn("tail", F.lit("added")))


_DRAWS = """mc AS (SELECT m + s * sqrt(-2 * ln(u)) * cos(2 * pi() * v) AS ret
           FROM (SELECT (CAST('0x' || substr(h, 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u, (CAST('0x' || substr(h, 17, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS v
                 FROM (SELECT md5('42-' || range) AS h FROM range(100000))), (SELECT avg(pnl) AS m, stddev_samp(pnl) AS s FROM pnl)),
    mq AS (SELECT quantile_cont(ret, 0.05) AS q5, quantile_cont(ret, 0.01) AS q1 FROM mc)"""
_MONTE_CARLO = """SELECT 'monte_carlo' AS method, q5 AS var_95, q1 AS var_99, avg(ret) FILTER (ret <= q5) AS cvar_95, avg(ret) FILTER (ret <= q1) AS cvar_99
    FROM mc, mq GROUP BY q5, q1"""


@query("var_monte_carlo", "method " + VAR_COLS, uses="pnl", sql=f"{_DRAWS}\n--\n{_MONTE_CARLO}")
def var_monte_carlo(spark, folder):
    return risk.var_monte_carlo(spark, risk.portfolio_pnl(holdings(spark, folder)).withColumnRenamed("pnl", "ret"))


@query("var_all", "method " + VAR_COLS, uses="pnl", sql=f"""{_DRAWS},
    hq AS (SELECT quantile_cont(pnl, 0.05) AS q5, quantile_cont(pnl, 0.01) AS q1 FROM pnl)
--
{_MONTE_CARLO} UNION ALL
    SELECT 'historical', q5, q1, avg(pnl) FILTER (pnl <= q5), avg(pnl) FILTER (pnl <= q1) FROM pnl, hq GROUP BY q5, q1 UNION ALL
    SELECT 'parametric', * FROM ({_PARAM.format(key="", sign="-", src="(SELECT pnl AS ret FROM pnl)", group="")})""")
def var_all(spark, folder):
    return risk.var_all(spark, risk.portfolio_pnl(holdings(spark, folder)).withColumnRenamed("pnl", "ret"))


_SCENARIOS = "sc AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS scenario, unnest({s}) AS shock, unnest(range(1, {len(s) + 1})) AS day, CAST({risk.pstdev(s)!r} AS DOUBLE) AS sv"
    for n, s in risk.SCENARIOS.items()) + ")"
_STRESS = f"""{_SCENARIOS},
    vols AS (SELECT ts_code, stddev_samp(ret) AS vol FROM rets GROUP BY 1),
    paths AS (SELECT ts_code, scenario, day, shock, vol, greatest(0.5, least(3.0, vol / sv)) AS k FROM vols CROSS JOIN sc),
    navs AS (SELECT *, shock * k AS s, product(1 + shock * k) OVER (PARTITION BY ts_code, scenario ORDER BY day ROWS UNBOUNDED PRECEDING) AS nav FROM paths),
    peaks AS (SELECT *, greatest(1, max(nav) OVER (PARTITION BY ts_code, scenario ORDER BY day ROWS UNBOUNDED PRECEDING)) AS peak FROM navs),
    outcome AS (SELECT ts_code, scenario, arg_max(nav, day) AS end_nav, arg_max(nav, day) - 1 AS total_return, least(0, min(nav / peak - 1)) AS max_drawdown,
                       least(0, min(s)) AS worst_day, count(*) FILTER (s < -0.02) AS var_breaches FROM peaks GROUP BY 1, 2)
--
"""
STRESS_COLS = "ts_code scenario end_nav:4 total_return:4 max_drawdown:4 worst_day:4 var_breaches:i"


def volatilities(spark, folder):
    return returns(spark, folder).groupBy("ts_code").agg(F.stddev_samp("ret").alias("vol"))


@query("stress_test", STRESS_COLS, uses="rets", sql=_STRESS + "SELECT * FROM outcome")
def stress_test(spark, folder):
    return risk.stress(volatilities(spark, folder))


@query("cross_scenarios", "ts_code scenario day:i shock:6 scaled:6", uses="rets", sql=_STRESS + "SELECT *, s AS scaled FROM navs")
def cross_scenarios(spark, folder):
    rows = risk.scaled_shocks(risk.with_scenarios(volatilities(spark, folder)))
    return rows.select("ts_code", "scenario", "shock_scale", F.posexplode("shocks").alias("day", "shock")).withColumns(
        {"day": F.col("day") + 1, "scaled": F.col("shock") * F.col("shock_scale")})


# -- rules ----------------------------------------------------------------------------------------


@query("risk_single_stop", KEY + " stopped:b new_weight:6", uses="holdings", sql="""
    SELECT trade_date, ts_code, coalesce(ret, 0) <= -0.08 AND weight > 0 AS stopped, CASE WHEN coalesce(ret, 0) <= -0.08 THEN 0 ELSE weight END AS new_weight FROM holdings""")
def risk_single_stop(spark, folder):
    return risk.single_stop(holdings(spark, folder))


@query("risk_daily_loss", KEY + " pnl:6 breached:b new_weight:6", uses="holdings pnl", sql="""
    SELECT trade_date, ts_code, pnl, pnl <= -0.01 AS breached, CASE WHEN pnl <= -0.01 THEN weight * 0.5 ELSE weight END AS new_weight
    FROM holdings JOIN pnl USING (trade_date)""")
def risk_daily_loss(spark, folder):
    return risk.daily_loss(holdings(spark, folder), limits=TIGHT)


@query("risk_monthly_loss", "trade_date:d month_pnl:6 liquidate:b", uses="pnl", sql="""
    SELECT trade_date, m AS month_pnl, m <= -0.005 AS liquidate FROM (
        SELECT *, sum(pnl) OVER (PARTITION BY date_trunc('month', trade_date) ORDER BY trade_date) AS m FROM pnl)""")
def risk_monthly_loss(spark, folder):
    return risk.monthly_loss(risk.portfolio_pnl(holdings(spark, folder)), TIGHT)


_STREAK = """st AS (SELECT trade_date, pnl, CASE WHEN pnl < 0 THEN row_number() OVER (PARTITION BY island, pnl < 0 ORDER BY trade_date) ELSE 0 END AS streak
    FROM (SELECT *, sum(CASE WHEN pnl < 0 THEN 0 ELSE 1 END) OVER (ORDER BY trade_date) AS island FROM pnl))"""


@query("risk_loss_streak", "trade_date:d streak:i reduce:b", uses="pnl", sql=f"""{_STREAK}
--
SELECT trade_date, streak, streak > 0 AND streak % 3 = 0 AS reduce FROM st""")
def risk_loss_streak(spark, folder):
    return risk.loss_streak(risk.portfolio_pnl(holdings(spark, folder)))


@query("risk_portfolio_stop", "trade_date:d nav_change:6 liquidate:b", uses="curve", sql="""
    SELECT trade_date, c AS nav_change, coalesce(c <= -0.02, false) AS liquidate FROM (SELECT *, nav / lag(nav) OVER (ORDER BY trade_date) - 1 AS c FROM curve)""")
def risk_portfolio_stop(spark, folder):
    return risk.portfolio_stop(curve_of(spark, folder), TIGHT)


_TRAIL = f"tr AS (SELECT *, max(weight) OVER ({ORDERED} ROWS UNBOUNDED PRECEDING) AS peak FROM holdings)"


@query("risk_trailing_stop", KEY + " peak_weight:6 stopped:b new_weight:6", uses="holdings", sql=f"""{_TRAIL}
--
SELECT trade_date, ts_code, peak AS peak_weight, (weight - peak) / peak <= -0.1 AS stopped,
       CASE WHEN (weight - peak) / peak <= -0.1 THEN 0 ELSE weight END AS new_weight FROM tr""")
def risk_trailing_stop(spark, folder):
    return risk.trailing_stop(holdings(spark, folder))


_LIMITED = "CASE WHEN row_number() OVER (PARTITION BY trade_date ORDER BY least({w}, 0.1) DESC, ts_code) <= 15 THEN least({w}, 0.1) ELSE 0 END"


@query("risk_position_limits", KEY + " new_weight:6", uses="holdings",
       sql=f"SELECT trade_date, ts_code, {_LIMITED.format(w='weight')} AS new_weight FROM holdings")
def risk_position_limits(spark, folder):
    return risk.position_limits(holdings(spark, folder), TIGHT)


@query("topn_positions", KEY + " weight:6", uses="holdings", sql="""
    SELECT trade_date, ts_code, weight FROM holdings QUALIFY row_number() OVER (PARTITION BY trade_date ORDER BY weight DESC, ts_code) <= 15""")
def topn_positions(spark, folder):
    return portfolio.top_n(holdings(spark, folder).where("weight > 0"), "weight", 15, ["trade_date"])


@query("risk_sector_cap", KEY + " sector_weight:6 capped:b new_weight:6", uses="holdings sectors", sql="""
    SELECT trade_date, ts_code, sector_weight, sector_weight > 0.3 AS capped, CASE WHEN sector_weight > 0.3 THEN weight * 0.3 / sector_weight ELSE weight END AS new_weight
    FROM holdings JOIN sectors USING (trade_date, industry)""")
def risk_sector_cap(spark, folder):
    return risk.sector_cap(holdings(spark, folder, industry=True))


_TOP3 = """t3 AS (SELECT trade_date, sum(sector_weight) AS top3 FROM (
    SELECT *, row_number() OVER (PARTITION BY trade_date ORDER BY sector_weight DESC) AS rn FROM sectors) WHERE rn <= 3 GROUP BY 1)"""


@query("top3_sectors", "trade_date:d top3:6", uses="sectors", sql=f"""{_TOP3}
--
SELECT * FROM t3""")
def top3_sectors(spark, folder):
    return risk.top3_sectors(holdings(spark, folder, industry=True))


@query("risk_top3_sector", KEY + " top3:6 new_weight:6", uses="holdings sectors", sql=f"""{_TOP3}
--
SELECT trade_date, ts_code, top3, CASE WHEN top3 > 0.6 THEN weight * 0.6 / top3 ELSE weight END AS new_weight FROM holdings JOIN t3 USING (trade_date)""")
def risk_top3_sector(spark, folder):
    return risk.top3_cap(holdings(spark, folder, industry=True))


@query("risk_normalize", KEY + " new_weight:6", uses="holdings", sql=f"""
    SELECT trade_date, ts_code, {_LIMITED.format(w='s')} AS new_weight FROM (
        SELECT *, amount / sum(amount) OVER (PARTITION BY trade_date) AS s FROM holdings)""")
def risk_normalize(spark, folder):
    return risk.normalize(holdings(spark, folder).withColumn("weight", F.col("amount")), TIGHT)


@query("factor_exposure", "trade_date:d factor exposure:6 breached:b", uses="factors holdings", sql="""
    e AS (SELECT trade_date, coalesce(sum(weight * f.mom5), 0) AS mom5, coalesce(sum(weight * f.volume_ratio), 0) AS volume_ratio
          FROM holdings JOIN factors f USING (trade_date, ts_code) GROUP BY 1)
--
SELECT trade_date, 'mom5' AS factor, mom5 AS exposure, abs(mom5) > 0.005 AS breached FROM e
UNION ALL SELECT trade_date, 'volume_ratio', volume_ratio, abs(volume_ratio) > 0.005 FROM e
UNION ALL SELECT trade_date, 'total', abs(mom5) + abs(volume_ratio), abs(mom5) + abs(volume_ratio) > 2.5 FROM e""")
def factor_exposure(spark, folder):
    weights = holdings(spark, folder).select("trade_date", "ts_code", "weight")
    factors = factor_frame(spark, folder).select("trade_date", "ts_code", "mom5", "volume_ratio")
    return risk.factor_exposure(weights.join(factors, ["trade_date", "ts_code"]), ["mom5", "volume_ratio"], TIGHT)


@query("risk_blacklist", KEY + " blacklisted:b", uses="holdings", sql=f"""
    SELECT trade_date, ts_code, coalesce(bool_or(coalesce(ret, 0) <= -0.08) OVER ({ORDERED} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), false) AS blacklisted FROM holdings""")
def risk_blacklist(spark, folder):
    return risk.blacklist(risk.single_stop(holdings(spark, folder)))


_EVENTS = f"""{_STREAK}, {_TRAIL}, {_TOP3},
    mo AS (SELECT *, sum(pnl) OVER (PARTITION BY date_trunc('month', trade_date) ORDER BY trade_date) AS m FROM pnl),
    nc AS (SELECT *, nav / lag(nav) OVER (ORDER BY trade_date) - 1 AS c FROM curve),
    ev AS (SELECT trade_date, ts_code, 'stop_loss_single' AS event_type, ret AS value, 'liquidate' AS action FROM holdings WHERE ret <= -0.08
        UNION ALL SELECT trade_date, NULL, 'daily_loss_limit', pnl, 'reduce_all' FROM pnl WHERE pnl <= -0.01
        UNION ALL SELECT trade_date, NULL, 'monthly_loss_limit', m, 'liquidate_all' FROM mo WHERE m <= -0.005
        UNION ALL SELECT trade_date, NULL, 'consecutive_losses', streak, 'reduce_all' FROM st WHERE streak > 0 AND streak % 3 = 0
        UNION ALL SELECT trade_date, NULL, 'stop_loss_portfolio', c, 'liquidate_all' FROM nc WHERE c <= -0.02
        UNION ALL SELECT trade_date, ts_code, 'trailing_stop', weight, 'liquidate' FROM tr WHERE (weight - peak) / peak <= -0.1
        UNION ALL SELECT trade_date, NULL, 'sector_limit', sector_weight, 'reduce' FROM sectors WHERE sector_weight > 0.3
        UNION ALL SELECT trade_date, NULL, 'sector_concentration', top3, 'reduce_all' FROM t3 WHERE top3 > 0.6)
--
"""


def events(spark, folder):
    r = stored_returns(spark, folder, industry=True)
    return risk.all_events(weighted(r), curve_of(spark, folder, r), TIGHT)


@query("risk_events", KEY + " event_type value:6 action", uses="pnl holdings curve sectors", sql=_EVENTS + "SELECT * FROM ev")
def risk_events(spark, folder):
    return events(spark, folder)


_CHAIN = f"""{_STREAK},
    h0 AS (SELECT *, coalesce(ret, 0) <= -0.08 AND weight > 0 AS stop1, CASE WHEN coalesce(ret, 0) <= -0.08 AND weight > 0 THEN 0 ELSE weight END AS cut FROM holdings),
    dd AS (SELECT trade_date, sum(weight * coalesce(ret, 0)) AS pnl, sum(cut * coalesce(ret, 0)) AS rest FROM h0 GROUP BY 1),
    dr AS (SELECT dd.trade_date, rest <= -0.01 AS daily, sum(dd.pnl) OVER (PARTITION BY date_trunc('month', dd.trade_date) ORDER BY dd.trade_date) <= -0.005 AS monthly,
                  streak > 0 AND streak % 3 = 0 AS streak, coalesce(c <= -0.02, false) AS navstop
           FROM dd JOIN st USING (trade_date) LEFT JOIN (SELECT trade_date, nav / lag(nav) OVER (ORDER BY trade_date) - 1 AS c FROM curve) USING (trade_date)),
    w4 AS (SELECT h0.*, dr.* EXCLUDE (trade_date), cut * CASE WHEN daily THEN 0.5 ELSE 1 END * CASE WHEN monthly THEN 0 ELSE 1 END * CASE WHEN streak THEN 0.5 ELSE 1 END
                  * CASE WHEN navstop THEN 0 ELSE 1 END AS w4 FROM h0 JOIN dr USING (trade_date)),
    w5 AS (SELECT *, w4 > 0 AND coalesce((w4 - peak) / nullif(peak, 0) <= -0.1, false) AS trail FROM (
               SELECT *, max(w4) OVER (PARTITION BY ts_code ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS peak FROM w4)),
    w6 AS (SELECT *, {_LIMITED.format(w='w5')} AS w6 FROM (SELECT *, CASE WHEN trail THEN 0 ELSE w4 END AS w5 FROM w5)),
    se AS (SELECT trade_date, industry, sum(w6) AS sw, row_number() OVER (PARTITION BY trade_date ORDER BY sum(w6) DESC, industry) AS place
           FROM w6 WHERE industry IS NOT NULL GROUP BY 1, 2),
    th AS (SELECT trade_date, sum(sw) AS top3 FROM se WHERE place <= 3 GROUP BY 1),
    w7 AS (SELECT w6.*, coalesce(sw > 0.3, false) AS sector, coalesce(top3 > 0.6, false) AS three,
                  w6 * CASE WHEN coalesce(sw > 0.3, false) THEN 0.3 / sw ELSE 1 END * CASE WHEN coalesce(top3 > 0.6, false) THEN 0.6 / top3 ELSE 1 END AS w7
           FROM w6 LEFT JOIN se USING (trade_date, industry) LEFT JOIN th USING (trade_date)),
    w8 AS (SELECT *, CASE WHEN sum(w7) OVER (PARTITION BY trade_date) > 0 THEN w7 / sum(w7) OVER (PARTITION BY trade_date) ELSE w7 END AS s FROM w7),
    ch AS (SELECT trade_date, ts_code, weight, {_LIMITED.format(w='s')} AS new_weight,
                  concat_ws(',', CASE WHEN stop1 THEN 'stop_loss_single' END, CASE WHEN daily THEN 'daily_loss_limit' END, CASE WHEN monthly THEN 'monthly_loss_limit' END,
                      CASE WHEN streak THEN 'consecutive_losses' END, CASE WHEN navstop THEN 'stop_loss_portfolio' END, CASE WHEN trail THEN 'trailing_stop' END,
                      CASE WHEN w6 <> w5 THEN 'position_limit' END, CASE WHEN sector THEN 'sector_limit' END, CASE WHEN three THEN 'sector_concentration' END) AS fired FROM w8)
--
"""


def chained(spark, folder):
    # the curve's signal comes from the pass that finds the returns, so its series are not dealt again
    r = returns(spark, folder, industry=True).withColumns({"signal": series.pct_change("close", 5)})
    r = materialize(r.select("trade_date", "ts_code", "industry", "amount", "ret", "signal"), "returns")
    return risk.chain(weighted(r), portfolio.backtest(r, r.select("trade_date", "ts_code", "signal"), N), TIGHT)


@query("risk_chain", KEY + " weight:6 new_weight:6 fired", uses="pnl holdings curve", sql=_CHAIN + "SELECT * FROM ch")
def risk_chain(spark, folder):
    return chained(spark, folder)


@query("risk_chain_days", "trade_date:d given:6 kept:6 n_held:i", uses="pnl holdings curve",
       sql=_CHAIN + "SELECT trade_date, sum(weight) AS given, sum(new_weight) AS kept, count(*) FILTER (new_weight > 0) AS n_held FROM ch GROUP BY 1")
def risk_chain_days(spark, folder):
    """What the chain leaves of each date's portfolio; the rest is cash."""
    return chained(spark, folder).groupBy("trade_date").agg(
        F.sum("weight").alias("given"), F.sum("new_weight").alias("kept"), F.count_if(F.col("new_weight") > 0).alias("n_held"))


@query("agg_event_counts", "event_type n:i", uses="pnl holdings curve sectors", sql=_EVENTS + "SELECT event_type, count(*) AS n FROM ev GROUP BY 1")
def agg_event_counts(spark, folder):
    return risk.event_counts(events(spark, folder))
