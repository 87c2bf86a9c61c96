"""Queries for factor engineering, evaluation, aggregations and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import section, series, stats
from barloom.functions.core import pairs, pearson, ratio
from barloom.operators import evaluate, factor, panel
from barloom.plans.base import query
from barloom.plans.function_queries import rolled
from barloom.plans.tables import TABLES
from barloom.sources.panel_tables import BY_SUPPLIER, bars, returns, security_dim, series_bars

KEY = "trade_date:d ts_code"
ORDERED = "PARTITION BY ts_code ORDER BY trade_date"
FACTORS = ["mom5", "mom5_copy", "vola20", "volume_ratio", "day_span", "level"]

TABLES["factors"] = ("labelled", f"""
    SELECT *, mom5 * 2 + day_span AS mom5_copy FROM (
        SELECT *, close / lag(close, 5) OVER ({ORDERED}) - 1 AS mom5,
               coalesce(({rolled('stddev_samp(close)', 'close', 20)}) / close, 0) AS vola20,
               coalesce(vol / ({rolled('avg(vol)', 'vol', 20)}), 0) AS volume_ratio,
               (high - low) / close AS day_span, gap - 108 AS level FROM labelled)""")


def factor_frame(spark, folder):
    """Bars with returns, a five-row label and six factors, two of them near copies."""
    return dealt_factor_frame(spark, folder).drop("l_suppkey")


def dealt_factor_frame(spark, folder):
    """The same with ``l_suppkey``, by which it is dealt: windows per ``BY_SUPPLIER`` need no further exchange."""
    on = BY_SUPPLIER
    b = series_bars(spark, folder).withColumns({
        "ret": series.pct_change("close", on=on), "mom5": series.pct_change("close", 5, on),
        "fwd_ret": F.lead("close", 5).over(on.ordered) / F.col("close") - 1,
        "vola20": F.coalesce(ratio(stats.std("close", 20, on), "close"), F.lit(0.0)),
        "volume_ratio": F.coalesce(ratio("vol", stats.mean("vol", 20, on)), F.lit(0.0)),
        "day_span": (F.col("high") - F.col("low")) / F.col("close"), "level": F.col("gap") - 108})
    return b.withColumn("mom5_copy", F.col("mom5") * 2 + F.col("day_span"))


# -- neutralisation -------------------------------------------------------------------------------

_NEUTRAL_TAIL = """,
    tot AS (SELECT *, min(grp) OVER d AS base, count(*) OVER d AS k, sum(n) OVER d AS total FROM g WINDOW d AS (PARTITION BY trade_date)),
    fit AS (SELECT trade_date, grp, my, mx, grp = base AS plain, {cols} AS cols, total,
                   coalesce(sum(CASE WHEN grp = base THEN ryx ELSE ryx - n * my * mx END) OVER d
                   / nullif(sum(CASE WHEN grp = base THEN rxx ELSE rxx - n * mx * mx END) OVER d, 0), 0) AS slope
            FROM tot WINDOW d AS (PARTITION BY trade_date))
--
SELECT trade_date, ts_code, CASE WHEN total >= 3 AND total >= cols + 1 THEN
       (y - CASE WHEN plain THEN 0 ELSE my END) - slope * (x - CASE WHEN plain THEN 0 ELSE mx END) ELSE raw END AS resid
FROM v JOIN fit USING (trade_date, grp)"""


def _neutral_sql(group: str, x: str, cols: str) -> str:
    return f"""v AS (SELECT trade_date, ts_code, gap AS raw, {group} AS grp, CASE WHEN gap IS NOT NULL THEN gap END AS y,
        CASE WHEN gap IS NOT NULL THEN {x} END AS x FROM bars),
    g AS (SELECT trade_date, grp, count(y) AS n, coalesce(avg(y), 0) AS my, coalesce(avg(x), 0) AS mx,
        coalesce(sum(y * x), 0) AS ryx, coalesce(sum(x * x), 0) AS rxx FROM v GROUP BY 1, 2)""" + _NEUTRAL_TAIL.format(cols=cols)


@query("neutralize_industry", KEY + " resid:6", uses="bars", sql=_neutral_sql("industry", "0.0", "k - 1"))
def neutralize_industry(spark, folder):
    return factor.neutralize(bars(spark, folder, industry=True), "gap", "resid", industry="industry")


@query("neutralize_size", KEY + " resid:6", uses="bars", sql=_neutral_sql("''", "ln(amount)", "1"))
def neutralize_size(spark, folder):
    return factor.neutralize(bars(spark, folder), "gap", "resid", cap="amount")


@query("neutralize_both", KEY + " resid:6", uses="bars", sql=_neutral_sql("industry", "ln(amount)", "k"))
def neutralize_both(spark, folder):
    b = bars(spark, folder)
    caps = b.select("trade_date", "ts_code", F.col("amount").alias("market_cap"))
    return factor.neutralize_aligned(b, "gap", "resid", security_dim(spark, folder), caps)


@query("neutralize_cross_section", KEY + " resid:6", uses="bars", sql="""
    s AS (SELECT *, count(gap) OVER (PARTITION BY trade_date) AS n, count(gap) OVER (PARTITION BY trade_date, industry) AS ng,
                 avg(gap) OVER (PARTITION BY trade_date, industry) AS m FROM bars)
--
SELECT trade_date, ts_code, CASE WHEN n >= 3 AND n >= (SELECT count(DISTINCT industry) FROM bars b WHERE b.trade_date = s.trade_date)
       THEN gap - m ELSE gap END AS resid FROM s""")
def neutralize_cross_section(spark, folder):
    return factor.neutralize(bars(spark, folder, industry=True), "gap", "resid", industry="industry", intercept=True)


# -- selection ------------------------------------------------------------------------------------

_IC = "ic AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS factor, {i} AS pos, corr({f}, fwd_ret) AS ic, "
    f"count(*) FILTER ({f} IS NOT NULL AND fwd_ret IS NOT NULL) AS n FROM factors" for i, f in enumerate(FACTORS)) + ")"
_PAIRS = "cm AS (" + " UNION ALL ".join(
    f"SELECT '{a}' AS lft, '{b}' AS rgt, corr({a}, {b}) AS corr FROM factors"
    for i, a in enumerate(FACTORS) for b in FACTORS[i + 1:]) + ")"


@query("filter_by_ic", "factor ic:6 n:i", uses="factors", sql=f"""{_IC}
--
SELECT factor, round(ic, 6) AS ic, n FROM ic WHERE n >= 20 AND abs(ic) >= 0.02""")
def filter_by_ic(spark, folder):
    return factor.filter_by_ic(factor_frame(spark, folder), FACTORS, "fwd_ret")


_GREEDY = """walk AS (SELECT 0 AS step, CAST([] AS VARCHAR[]) AS kept
             UNION ALL SELECT step + 1, CASE WHEN EXISTS (SELECT 1 FROM cm WHERE abs(corr) > 0.7
                 AND ((lft = r.factor AND list_contains(kept, rgt)) OR (rgt = r.factor AND list_contains(kept, lft))))
                 THEN kept ELSE list_append(kept, r.factor) END
             FROM walk JOIN ranked r ON r.place = step + 1),
    left_over AS (SELECT unnest(kept) AS factor FROM (SELECT kept FROM walk ORDER BY step DESC LIMIT 1))"""


@query("remove_correlated", "factor", uses="factors", sql=f"""{_PAIRS},
    ranked AS (SELECT unnest({FACTORS!r}) AS factor, unnest(range(1, 7)) AS place), {_GREEDY}
--
SELECT factor FROM left_over""")
def remove_correlated(spark, folder):
    kept = factor.uncorrelated(factor_frame(spark, folder), FACTORS)
    return spark.createDataFrame([(f,) for f in kept], "factor string")


@query("mean_corr_filter", "factor mean_corr:6", uses="factors", sql=f"""{_PAIRS}
--
SELECT factor, avg(abs(corr)) AS mean_corr FROM (SELECT lft AS factor, corr FROM cm UNION ALL SELECT rgt, corr FROM cm)
GROUP BY 1 HAVING avg(abs(corr)) <= 0.15""")
def mean_corr_filter(spark, folder):
    return factor.mean_corr(factor_frame(spark, folder), FACTORS).where("mean_corr <= 0.15")


@query("select_factors", "factor ic:6", uses="factors", sql=f"""{_IC}, {_PAIRS},
    strong AS (SELECT * FROM ic WHERE n >= 20 AND abs(ic) >= 0.02),
    ranked AS (SELECT *, row_number() OVER (ORDER BY abs(round(ic, 6)) DESC) AS place FROM strong), {_GREEDY},
    means AS (SELECT factor, avg(abs(corr)) AS m FROM (SELECT lft AS factor, rgt AS other, corr FROM cm UNION ALL SELECT rgt, lft, corr FROM cm)
              WHERE other IN (SELECT factor FROM left_over) GROUP BY 1)
--
SELECT factor, round(ic, 6) AS ic FROM left_over JOIN ic USING (factor) LEFT JOIN means USING (factor)
WHERE m <= 0.5 OR (SELECT count(*) FROM left_over) < 2""")
def select_factors(spark, folder):
    return spark.createDataFrame(factor.select_factors(factor_frame(spark, folder), FACTORS, "fwd_ret"), "factor string, ic double")


# -- evaluation -----------------------------------------------------------------------------------


@query("ic", "ts_code ic_fwd_ret:6", uses="factors", sql="""
    SELECT ts_code, CASE WHEN count(*) FILTER (mom5 IS NOT NULL AND fwd_ret IS NOT NULL) >= 20 THEN corr(mom5, fwd_ret) END AS ic_fwd_ret
    FROM factors WHERE trade_date > '1999-12-31' GROUP BY 1""")
def ic(spark, folder):
    return evaluate.ic(factor_frame(spark, folder), "mom5", ["fwd_ret"], train_end="1999-12-31")


@query("rank_ic", "ts_code rank_ic_fwd_ret:6", uses="factors", sql="""
    r AS (SELECT ts_code, rank() OVER (PARTITION BY ts_code ORDER BY vol) + (count(*) OVER (PARTITION BY ts_code, vol) - 1) / 2 AS f,
                 rank() OVER (PARTITION BY ts_code ORDER BY fwd_ret) + (count(*) OVER (PARTITION BY ts_code, fwd_ret) - 1) / 2 AS r
          FROM factors WHERE fwd_ret IS NOT NULL)
--
SELECT ts_code, CASE WHEN count(*) >= 20 THEN corr(f, r) END AS rank_ic_fwd_ret FROM r GROUP BY 1""")
def rank_ic(spark, folder):
    return evaluate.rank_ic(factor_frame(spark, folder), "vol", ["fwd_ret"])


_DAILY_IC = """di AS (SELECT trade_date, CASE WHEN n > 2 AND NOT isnan(c) THEN c END AS ic, n FROM (
    SELECT trade_date, corr(mom5, fwd_ret) AS c, count(*) FILTER (mom5 IS NOT NULL AND fwd_ret IS NOT NULL) AS n
    FROM factors GROUP BY 1))"""


@query("daily_ic", "trade_date:d ic:6 n:i", uses="factors", sql=f"""{_DAILY_IC}
--
SELECT * FROM di""")
def daily_ic(spark, folder):
    return evaluate.daily_ic(factor_frame(spark, folder), "mom5", "fwd_ret")


@query("agg_daily_ic", "mean_ic:6 n_days:i", uses="factors", sql=f"""{_DAILY_IC}
--
SELECT avg(ic) AS mean_ic, count(ic) AS n_days FROM di""")
def agg_daily_ic(spark, folder):
    return evaluate.daily_ic(factor_frame(spark, folder), "mom5", "fwd_ret").agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("n_days"))


@query("ic_stats", "ic_mean:6 ic_std:6 ic_ir:4 hit_rate:4 positive_days:i total_days:i is_full_sample:b", uses="factors", sql=f"""{_DAILY_IC}
--
SELECT avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(ic) / stddev_samp(ic) AS ic_ir, avg(CASE WHEN ic > 0 THEN 1 ELSE 0 END) AS hit_rate,
       count(*) FILTER (ic > 0) AS positive_days, count(*) AS total_days, count(*) = 1 AS is_full_sample FROM di WHERE ic IS NOT NULL""")
def ic_stats(spark, folder):
    return evaluate.ic_stats(evaluate.daily_ic(factor_frame(spark, folder), "mom5", "fwd_ret"))


@query("sharpe", "ts_code sharpe:6", uses="rets", sql="""
    SELECT ts_code, CASE WHEN count(ret) < 20 OR stddev_samp(ret) < 1e-10 THEN 0
           ELSE (avg(ret) - 0.02 / 252) / stddev_samp(ret) * sqrt(252) END AS sharpe FROM rets GROUP BY 1""")
def sharpe(spark, folder):
    return returns(spark, folder).groupBy("ts_code").agg(evaluate.sharpe("ret", 0.02).alias("sharpe"))


@query("sharpe_pop", "ts_code sharpe:6", uses="rets", sql="""
    SELECT ts_code, CASE WHEN count(ret) < 5 THEN 0 ELSE coalesce(avg(ret) / nullif(stddev_pop(ret), 0) * sqrt(252), 0) END AS sharpe
    FROM rets GROUP BY 1""")
def sharpe_pop(spark, folder):
    return returns(spark, folder).groupBy("ts_code").agg(evaluate.sharpe_population("ret").alias("sharpe"))


@query("max_drawdown", "ts_code max_drawdown:6", uses="bars", sql="""
    SELECT ts_code, CASE WHEN count(gap) < 2 THEN 0 ELSE min(gap / peak - 1) END AS max_drawdown
    FROM (SELECT ts_code, gap, max(gap) OVER (PARTITION BY ts_code ORDER BY trade_date) AS peak FROM bars) GROUP BY 1""")
def max_drawdown(spark, folder):
    return evaluate.max_drawdown(bars(spark, folder), "gap")


@query("annual_return", "ts_code annual:6", uses="rets", sql="""
    SELECT ts_code, CASE WHEN count(ret) < 1 THEN 0 ELSE pow(product(1 + ret), 252.0 / count(ret)) - 1 END AS annual FROM rets GROUP BY 1""")
def annual_return(spark, folder):
    return returns(spark, folder).groupBy("ts_code").agg(evaluate.annual_return("ret").alias("annual"))


@query("agg_compound", "ts_code total:6", uses="rets", sql="SELECT ts_code, product(1 + ret) - 1 AS total FROM rets GROUP BY 1")
def agg_compound(spark, folder):
    return returns(spark, folder).groupBy("ts_code").agg((F.product(1 + F.col("ret")) - 1).alias("total"))


@query("position_turnover", "ts_code turnover:6", uses="bars", sql=f"""
    SELECT ts_code, coalesce(avg(m) / 2, 0) AS turnover FROM (
        SELECT ts_code, abs(vol - lag(vol) OVER ({ORDERED})) AS m FROM bars) GROUP BY 1""")
def position_turnover(spark, folder):
    return evaluate.position_turnover(bars(spark, folder), "vol")


_POSITION = f"""pos AS (SELECT *, CASE WHEN level IS NULL OR m IS NULL THEN 0 ELSE least(greatest((level - m) / CASE WHEN s = 0 THEN 1 ELSE s END, -2), 2) END AS position
    FROM (SELECT *, CASE WHEN count(level) OVER e >= 60 THEN avg(level) OVER e END AS m,
          CASE WHEN count(level) OVER e >= 60 THEN stddev_samp(level) OVER e END AS s FROM {{src}}
          WINDOW e AS ({ORDERED} ROWS UNBOUNDED PRECEDING))),
    strat AS (SELECT *, lag(position) OVER ({ORDERED}) * ret AS strategy_ret FROM pos)"""


@query("zscore_position", KEY + " position:6 strategy_ret:6", uses="factors", sql=(
    _POSITION.format(src="(SELECT * REPLACE (close - 108 AS level) FROM factors)") + "\n--\nSELECT trade_date, ts_code, position, strategy_ret FROM strat"))
def zscore_position(spark, folder):
    f = returns(spark, folder).withColumn("level", F.col("close") - 108)
    return evaluate.zscore_position(f, "level")


_PERIODS = (1, 5, 10, 20)
_EVAL_COLS = ("ts_code data_points:i " + " ".join(f"ic_{p}d:6" for p in _PERIODS) + " " + " ".join(f"rank_ic_{p}d:6" for p in _PERIODS)
              + " sharpe:4 max_drawdown:4 annual_return:4 turnover:4")
_EVAL_SQL = f"""known AS (SELECT trade_date, ts_code, gap AS level, gap, gap / lag(gap) OVER ({ORDERED}) - 1 AS ret, """ + ", ".join(
    f"lead(gap, {p}) OVER ({ORDERED}) / gap - 1 AS r{p}" for p in _PERIODS) + f""" FROM bars WHERE gap IS NOT NULL),
    {_POSITION.format(src='known')},
    eq AS (SELECT *, CASE WHEN strategy_ret IS NOT NULL THEN product(1 + strategy_ret) OVER ({ORDERED} ROWS UNBOUNDED PRECEDING) END AS equity,
                  abs(position - lag(position) OVER ({ORDERED})) AS move FROM strat),
    dd AS (SELECT *, equity / max(equity) OVER ({ORDERED} ROWS UNBOUNDED PRECEDING) - 1 AS drop_by FROM eq),
    """ + ",\n    ".join(
    f"k{p} AS (SELECT ts_code, corr(f, r) AS c FROM (SELECT ts_code, rank() OVER (PARTITION BY ts_code ORDER BY gap) + (count(*) OVER (PARTITION BY ts_code, gap) - 1) / 2 AS f, "
    f"rank() OVER (PARTITION BY ts_code ORDER BY r{p}) + (count(*) OVER (PARTITION BY ts_code, r{p}) - 1) / 2 AS r FROM known WHERE r{p} IS NOT NULL) GROUP BY 1)"
    for p in _PERIODS) + """
--
SELECT ts_code, count(*) AS data_points, """ + ", ".join(f"CASE WHEN count(r{p}) >= 20 THEN corr(gap, r{p}) END AS ic_{p}d" for p in _PERIODS) + ", " + ", ".join(
    f"CASE WHEN count(r{p}) >= 20 THEN any_value(k{p}.c) END AS rank_ic_{p}d" for p in _PERIODS) + """,
    CASE WHEN count(strategy_ret) < 20 OR stddev_samp(strategy_ret) < 1e-10 THEN 0 ELSE avg(strategy_ret) / stddev_samp(strategy_ret) * sqrt(252) END AS sharpe,
    CASE WHEN count(drop_by) < 2 THEN 0 ELSE min(drop_by) END AS max_drawdown,
    CASE WHEN count(strategy_ret) < 1 THEN 0 ELSE pow(product(1 + strategy_ret), 252.0 / count(strategy_ret)) - 1 END AS annual_return,
    coalesce(avg(move) / 2, 0) AS turnover
FROM dd """ + " ".join(f"LEFT JOIN k{p} USING (ts_code)" for p in _PERIODS) + " GROUP BY 1"


@query("evaluate_factor", _EVAL_COLS, uses="bars", sql=_EVAL_SQL)
def evaluate_factor(spark, folder):
    return evaluate.evaluate_factor(bars(spark, folder), "gap", "gap")


def _summary_sql(src: str, value: str) -> str:
    """WITH items ``sm``: figures of the daily ICs of ``value`` per method and horizon, from ``src`` with returns r1 to r20."""
    return "lg AS (" + " UNION ALL ".join(f"SELECT trade_date, 'ret_{p}d' AS horizon, {value} AS x, r{p} AS y FROM {src} WHERE {value} IS NOT NULL AND r{p} IS NOT NULL"
                                          for p in _PERIODS) + """),
    rk AS (SELECT *, rank() OVER (PARTITION BY horizon, trade_date ORDER BY x) + (count(*) OVER (PARTITION BY horizon, trade_date, x) - 1) / 2 AS xr,
                  rank() OVER (PARTITION BY horizon, trade_date ORDER BY y) + (count(*) OVER (PARTITION BY horizon, trade_date, y) - 1) / 2 AS yr FROM lg),
    dy AS (SELECT horizon, trade_date, count(*) AS n, corr(x, y) AS p, corr(xr, yr) AS s FROM rk GROUP BY 1, 2),
    mt AS (SELECT 'pearson' AS method, horizon, round(p, 12) AS ic FROM dy WHERE n >= 3 AND NOT isnan(p) UNION ALL
           SELECT 'spearman', horizon, round(s, 12) FROM dy WHERE n >= 3 AND NOT isnan(s)),
    sm AS (SELECT method, horizon, avg(ic) AS ic_mean, coalesce(stddev_samp(ic), 0) AS ic_std,
                  CASE WHEN coalesce(stddev_samp(ic), 0) > 1e-10 THEN round(avg(ic) / stddev_samp(ic), 4) ELSE 0 END AS ic_ir,
                  avg(CASE WHEN ic > 0 THEN 1 ELSE 0 END) AS hit_rate, count(*) FILTER (ic > 0) AS positive_days, count(*) AS total_days, count(*) = 1 AS is_full_sample
           FROM mt WHERE ic IS NOT NULL GROUP BY 1, 2)"""


_HORIZONS = [f"ret_{p}d" for p in _PERIODS]
_AHEAD = ", ".join(f"lead({{0}}, {p}) OVER ({ORDERED}) / {{0}} - 1 AS r{p}" for p in _PERIODS)


@query("evaluate_summary", "method horizon ic_mean:6 ic_std:6 ic_ir:4 hit_rate:4 positive_days:i total_days:i is_full_sample:b", uses="bars", sql=f"""
    known AS (SELECT trade_date, ts_code, gap, {_AHEAD.format('gap')} FROM bars WHERE gap IS NOT NULL),
    {_summary_sql('known', 'gap')}
--
SELECT * FROM sm""")
def evaluate_summary(spark, folder):
    known = panel.dealt_forward_returns(series_bars(spark, folder).where("gap is not null"), _PERIODS, price="gap", on=BY_SUPPLIER)
    return evaluate.ic_summary(known, "gap", _HORIZONS)


@query("factor_verdict", "ts_code passed:b", uses="factors", sql=f"""
    ahead AS (SELECT trade_date, ts_code, level, {_AHEAD.format('close')} FROM factors),
    {_summary_sql('ahead', 'level')},
    {_POSITION.format(src='factors')},
    eq AS (SELECT *, CASE WHEN strategy_ret IS NOT NULL THEN product(1 + strategy_ret) OVER ({ORDERED} ROWS UNBOUNDED PRECEDING) END AS equity FROM strat),
    dd AS (SELECT *, equity / max(equity) OVER ({ORDERED} ROWS UNBOUNDED PRECEDING) - 1 AS drop_by FROM eq)
--
SELECT ts_code, coalesce((SELECT max(abs(ic_ir)) FROM sm WHERE method = 'pearson'), 0) >= 0.3 AND abs(CASE WHEN count(strategy_ret) < 20 OR stddev_samp(strategy_ret) < 1e-10 THEN 0
       ELSE avg(strategy_ret) / stddev_samp(strategy_ret) * sqrt(252) END) >= 0.5 AND coalesce(min(drop_by), 0) >= -0.5 AS passed
FROM dd GROUP BY 1""")
def factor_verdict(spark, folder):
    on = BY_SUPPLIER
    f = dealt_factor_frame(spark, folder)
    placed = evaluate.zscore_position(f, "level", on)
    curve = placed.withColumn("equity", F.when(F.col("strategy_ret").isNotNull(), F.product(1 + F.col("strategy_ret")).over(on.so_far)))
    rows = curve.withColumn("dd", evaluate.drawdown("equity", on)).groupBy("l_suppkey", "ts_code").agg(
        evaluate.sharpe("strategy_ret").alias("sharpe"), F.coalesce(F.min("dd"), F.lit(0.0)).alias("max_drawdown"))
    return evaluate.judge(rows, evaluate.ic_summary(panel.dealt_forward_returns(f, _PERIODS, on=on), "level", _HORIZONS))


@query("label_purge_check", "label leaked:i safe:i recommended_purge:i clean:b", uses="bars", sql=f"""
    l AS (SELECT trade_date, lead(close, 1) OVER w / close - 1 AS ret_1d, lead(close, 5) OVER w / close - 1 AS ret_5d,
                 lead(close, 10) OVER w / close - 1 AS ret_10d FROM bars WINDOW w AS ({ORDERED}))
--
SELECT *, leaked = 0 AS clean FROM (
    SELECT 'ret_' || p || 'd' AS label, count(*) FILTER (trade_date > DATE '1999-12-31' - CAST(p AS INTEGER)) AS leaked,
           count(*) FILTER (trade_date <= DATE '1999-12-31' - CAST(p AS INTEGER)) AS safe, p AS recommended_purge
    FROM (SELECT trade_date, 1 AS p, ret_1d AS v FROM l UNION ALL SELECT trade_date, 5, ret_5d FROM l UNION ALL SELECT trade_date, 10, ret_10d FROM l)
    WHERE v IS NOT NULL GROUP BY p)""")
def label_purge_check(spark, folder):
    return evaluate.label_purge_check(panel.forward_returns(bars(spark, folder)), ["ret_1d", "ret_5d", "ret_10d"], "1999-12-31")


@query("market_beta", KEY + " beta:6", uses="rets", sql="""
    m AS (SELECT trade_date, close / lag(close) OVER (ORDER BY trade_date) - 1 AS market_ret FROM (SELECT trade_date, avg(close) AS close FROM bars GROUP BY 1)),
    j AS (SELECT *, ret IS NOT NULL AND market_ret IS NOT NULL AS known FROM rets LEFT JOIN m USING (trade_date))
--
SELECT trade_date, ts_code, CASE WHEN known AND count(*) OVER f = 60 AND var_samp(market_ret) OVER f > 1e-10
       THEN covar_samp(ret, market_ret) OVER f / var_samp(market_ret) OVER f END AS beta
FROM j WINDOW f AS (PARTITION BY ts_code, known ORDER BY trade_date ROWS 59 PRECEDING)""")
def market_beta(spark, folder):
    stock = returns(spark, folder)
    index = stock.groupBy("trade_date").agg(F.avg("close").alias("close")).withColumn("ts_code", F.lit("000300.SH"))
    market = index.withColumn("market_ret", series.pct_change("close"))
    return evaluate.market_beta(stock, market)


# -- aggregations ---------------------------------------------------------------------------------


@query("agg_sector_weights", "trade_date:d industry weight:6", uses="holdings", sql="""
    SELECT trade_date, industry, sum(weight) AS weight FROM holdings WHERE industry <> 'ASIA' GROUP BY 1, 2""")
def agg_sector_weights(spark, folder):
    known = security_dim(spark, folder).where("industry <> 'ASIA'")
    return holdings(spark, folder).join(known, "ts_code").groupBy("trade_date", "industry").agg(F.sum("weight").alias("weight"))


def holdings(spark, folder, industry=False):
    return weighted(returns(spark, folder, industry))


def weighted(r):
    """A portfolio per date: every security weighted by its traded amount. Totals per date come from a
    partial aggregation, not from a window over the date."""
    held = section.with_stats(r, ["trade_date"], _total=F.sum("amount"))
    return held.withColumn("weight", F.col("amount") / F.col("_total")).drop("_total")


@query("agg_hhi", "trade_date:d hhi:6", uses="holdings", sql="""
    SELECT trade_date, sum(w * w) AS hhi FROM (SELECT trade_date, CASE WHEN industry = 'ASIA' THEN '未知' ELSE industry END AS i, sum(weight) AS w
    FROM holdings GROUP BY 1, 2) GROUP BY 1""")
def agg_hhi(spark, folder):
    from barloom.operators.risk import sector_hhi
    known = security_dim(spark, folder).where("industry <> 'ASIA'")
    return sector_hhi(holdings(spark, folder).join(known, "ts_code", "left"))


@query("agg_describe", "factor mean:6 std:6", uses="factors", sql=" UNION ALL ".join(
    f"SELECT '{f}' AS factor, avg({f}) AS mean, stddev_samp({f}) AS std FROM factors" for f in FACTORS))
def agg_describe(spark, folder):
    from barloom.operators.model import describe
    return describe(factor_frame(spark, folder), FACTORS)


@query("agg_nunique", "n_stocks:i n_dates:i", uses="bars", sql="SELECT count(DISTINCT ts_code) AS n_stocks, count(DISTINCT trade_date) AS n_dates FROM bars")
def agg_nunique(spark, folder):
    return bars(spark, folder).agg(F.count_distinct("ts_code").alias("n_stocks"), F.count_distinct("trade_date").alias("n_dates"))


@query("agg_corr_matrix", "method lft rgt corr:6", uses="factors", sql=f"""{_PAIRS},
    r AS (SELECT rank() OVER (ORDER BY vol) + (count(*) OVER (PARTITION BY vol) - 1) / 2 AS a,
                 rank() OVER (ORDER BY gap) + (count(*) OVER (PARTITION BY gap) - 1) / 2 AS b FROM factors WHERE gap IS NOT NULL)
--
SELECT 'pearson' AS method, lft, rgt, corr FROM cm UNION ALL SELECT 'spearman', 'vol', 'gap', corr(a, b) FROM r""")
def agg_corr_matrix(spark, folder):
    f = factor_frame(spark, folder)
    pearson_rows = factor.corr_matrix(f, FACTORS).withColumn("method", F.lit("pearson"))
    spearman_rows = factor.corr_matrix(f, ["vol", "gap"], "spearman").withColumn("method", F.lit("spearman"))
    return pearson_rows.unionByName(spearman_rows).withColumnsRenamed({"left": "lft", "right": "rgt"})


@query("agg_quantile", "trade_date:d q05:6", uses="rets", sql="SELECT trade_date, quantile_cont(ret, 0.05) AS q05 FROM rets WHERE ret IS NOT NULL GROUP BY 1")
def agg_quantile(spark, folder):
    return section.group_quantile(returns(spark, folder).select("trade_date", "ret"), ["trade_date"], "ret", 0.05, "q05")


@query("agg_tail_mean", "trade_date:d q05:6 tail_mean:6", uses="rets", sql="""
    SELECT trade_date, q05, avg(ret) AS tail_mean FROM (SELECT trade_date, ret, quantile_cont(ret, 0.05) OVER (PARTITION BY trade_date) AS q05
    FROM rets WHERE ret IS NOT NULL) WHERE ret <= q05 GROUP BY 1, 2""")
def agg_tail_mean(spark, folder):
    r = returns(spark, folder).select("trade_date", "ret")
    q = section.group_quantile(r, ["trade_date"], "ret", 0.05, "q05")
    return r.join(q, "trade_date").where("ret <= q05").groupBy("trade_date", "q05").agg(F.avg("ret").alias("tail_mean"))


@query("agg_last_per_period", "period:d last_date:d", uses="days", sql="""
    SELECT CAST(date_trunc('month', trade_date) AS DATE) AS period, max(trade_date) AS last_date FROM days GROUP BY 1""")
def agg_last_per_period(spark, folder):
    return panel.dates(bars(spark, folder)).groupBy(F.trunc("trade_date", "month").alias("period")).agg(F.max("trade_date").alias("last_date"))
