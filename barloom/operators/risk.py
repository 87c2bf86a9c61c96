"""Value at risk, stress scenarios and the portfolio risk rules, applied table by table.

Holdings are rows (trade_date, ts_code, industry, weight, ret). Sums per date or sector come from
partial aggregation joined back; running states follow one security or one portfolio over its dates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from statistics import pstdev

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.core import SERIES, Axis, or_zero, ratio
from barloom.functions import section
from barloom.operators.portfolio import top_n
from barloom.session import materialize

# Standard-normal quantiles and densities at 5 % and 1 %.
Z95, Z99 = -1.6448536269514729, -2.3263478740408408
PDF95, PDF99 = 0.10313564037537128, 0.026652142203457764
MIN_ROWS = 20
EPS = 1e-10
UNKNOWN_SECTOR = "未知"
BROADCAST_POSITIONS = 100  # largest positions per date whose keys are broadcast

# Daily shocks of the stress scenarios.
SCENARIOS: dict[str, list[float]] = {
    "2015股灾": [0.0000, -0.0300, -0.0200, -0.0350, -0.0300, -0.0700, -0.0550, 0.0200, -0.0250, -0.0450, -0.0350,
               -0.0150, 0.0100, -0.0200, -0.0100, -0.0550, -0.0600, -0.0850, 0.0000, 0.0400, 0.0200],
    "2020疫情": [-0.0290, -0.0770],
    "2024小微盘": [-0.0250, -0.0450, -0.0850],
    "闪崩场景": [-0.0700, -0.0200, -0.0200, -0.0200],
}
SINGLE_SHOCK_VOL = 0.02
SCALE_RANGE = (0.5, 3.0)


@dataclass(frozen=True)
class RiskLimits:
    """Thresholds of the risk rules (fixed values)."""

    stop_loss_single: float = -0.08
    stop_loss_portfolio: float = -0.05
    trailing_stop: float = -0.10
    max_single_position: float = 0.10
    max_sector_position: float = 0.30
    max_positions: int = 50
    max_top3_sector: float = 0.60
    blacklist_days: int = 5
    max_factor_exposure: float = 2.0
    max_total_exposure: float = 5.0
    daily_loss_limit: float = -0.03
    consecutive_loss_days: int = 3
    max_monthly_loss: float = -0.10


LIMITS = RiskLimits()
EVENT = ["trade_date", "ts_code", "event_type", "value", "action"]

# -- value at risk --------------------------------------------------------------------------------


def _method(df: DataFrame, name: str, by: list[str]) -> DataFrame:
    return df.select(*by, F.lit(name).alias("method"), *(F.round(c, 6).alias(c) for c in ("var_95", "var_99", "cvar_95", "cvar_99")))


def var_historical(returns: DataFrame, by: list[str], ret: str = "ret") -> DataFrame:
    """Empirical quantiles and tail means per key; 0 below 20 returns.

    Quantiles come from ranks of distinct values in slices, so a key with most of the returns gathers in no task.
    """
    q = materialize(returns.groupBy(*by).agg(F.count(ret).alias("_n")).join(
        section.group_quantiles(returns, by, ret, {"var_95": 0.05, "var_99": 0.01}), by, "left"), "quantiles")
    r = F.col(ret)
    tails = returns.join(q, by).groupBy(*by, "var_95", "var_99", "_n").agg(
        F.avg(F.when(r <= F.col("var_95"), r)).alias("cvar_95"), F.avg(F.when(r <= F.col("var_99"), r)).alias("cvar_99"))
    enough = F.col("_n") >= MIN_ROWS
    return _method(tails.withColumns({c: F.when(enough, F.coalesce(F.col(c), F.col(c[1:] if c[0] == "c" else c))).otherwise(0.0)
                                      for c in ("cvar_95", "cvar_99", "var_95", "var_99")}), "historical", by)


def var_parametric(returns: DataFrame, by: list[str], ret: str = "ret", tail_sign: float = -1.0) -> DataFrame:
    """Normal quantiles and tail means per key; 0 below 20 returns or without spread.

    The tail mean of a normal loss is mu - sigma*pdf/alpha. ``tail_sign=1.0`` gives the variant that
    adds the term, for comparison with results computed that way.
    """
    mu, sd = F.avg(ret), F.stddev_samp(ret)
    p = returns.groupBy(*by).agg(mu.alias("_mu"), sd.alias("_sd"), F.count(ret).alias("_n"))
    ok = (F.col("_n") >= MIN_ROWS) & (F.col("_sd") >= EPS)
    point = lambda k: F.when(ok, F.col("_mu") + F.col("_sd") * k).otherwise(0.0)
    return _method(p.withColumns({
        "var_95": point(Z95), "var_99": point(Z99),
        "cvar_95": point(tail_sign * PDF95 / 0.05), "cvar_99": point(tail_sign * PDF99 / 0.01)}), "parametric", by)


def normal_draw(number: Column, seed: int) -> Column:
    """A standard normal value from a counter (Box-Muller on two parts of an MD5): the same on any cluster."""
    digest = F.md5(F.concat(F.lit(f"{seed}-"), number.cast("string")).cast("binary"))
    part = lambda at: (F.conv(F.substring(digest, at, 13), 16, 10).cast("double") + 0.5) / 2.0 ** 52
    return F.sqrt(-2 * F.log(part(1))) * F.cos(2 * math.pi * part(17))


def var_monte_carlo(spark: SparkSession, returns: DataFrame, n: int = 100_000, seed: int = 42, ret: str = "ret") -> DataFrame:
    """Quantiles and tail means of ``n`` normal draws with the moments of one return series.

    The draws are generated in parallel; the moments, written as one row, reach them as scalar subqueries.
    """
    returns = materialize(returns.agg(F.avg(ret).alias("_mu"), F.stddev_samp(ret).alias("_sd"), F.count(ret).alias("_n")), "moments")
    mu, sd = returns.select("_mu").scalar(), returns.select("_sd").scalar()
    drawn = spark.range(n).select(normal_draw(F.col("id"), seed).alias("_z")).select((mu + sd * F.col("_z")).alias("ret"))
    enough = returns.select("_n").scalar()
    return var_historical(drawn.withColumn("_k", F.lit(1)).where(enough >= MIN_ROWS), ["_k"]).withColumn("method", F.lit("monte_carlo")).drop("_k")


def var_all(spark: SparkSession, returns: DataFrame, ret: str = "ret") -> DataFrame:
    """The three methods for one return series, one row each. The series is written once for all of them."""
    returns = materialize(returns.select(ret), "series")
    one = returns.select(F.lit(1).alias("_k"), ret)
    return var_historical(one, ["_k"], ret).drop("_k").unionByName(var_parametric(one, ["_k"], ret).drop("_k")).unionByName(
        var_monte_carlo(spark, returns, ret=ret))


# -- stress ---------------------------------------------------------------------------------------


def scenario_array(scenarios: dict[str, list[float]] | None = None) -> Column:
    """Array of (scenario, shocks, scenario_vol) literals."""
    rows = []
    for name, shocks in (scenarios or SCENARIOS).items():
        vol = pstdev(shocks) if len(shocks) > 1 else SINGLE_SHOCK_VOL
        rows.append(F.struct(F.lit(name).alias("scenario"), F.array(*(F.lit(float(s)) for s in shocks)).alias("shocks"),
                             F.lit(float(vol)).alias("scenario_vol")))
    return F.array(*rows)


def with_scenarios(df: DataFrame, scenarios: dict[str, list[float]] | None = None) -> DataFrame:
    """Every row next to every scenario (a fixed, short list)."""
    return df.withColumn("_s", F.explode(scenario_array(scenarios))).select("*", "_s.*").drop("_s")


def scaled_shocks(df: DataFrame, vol: str = "vol") -> DataFrame:
    """Add ``shock_scale``: the portfolio's volatility against the scenario's, within limits."""
    usable = (F.col("scenario_vol") > EPS) & (F.col(vol) > EPS)
    scale = F.greatest(F.lit(SCALE_RANGE[0]), F.least(F.lit(SCALE_RANGE[1]), ratio(vol, "scenario_vol")))
    return df.withColumn("shock_scale", F.when(usable, scale).otherwise(1.0))


def stress(df: DataFrame, vol: str = "vol", var_95: Column | float = -0.02,
           scenarios: dict[str, list[float]] | None = None) -> DataFrame:
    """Outcome of each scenario for each row's volatility: final NAV, drawdown, worst day, breaches.

    The NAV path is folded inside the shock array, so a row never leaves its task.
    """
    limit = var_95 if isinstance(var_95, Column) else F.lit(float(var_95))
    rows = scaled_shocks(with_scenarios(df, scenarios), vol).withColumn("_limit", limit)
    zero = F.lit(0.0)
    start = F.struct(F.lit(1.0).alias("nav"), F.lit(1.0).alias("peak"), zero.alias("dd"), zero.alias("worst"), F.lit(0).alias("n"))

    def day(acc: Column, shock: Column) -> Column:
        s = shock * F.col("shock_scale")
        nav = acc["nav"] * (1 + s)
        peak = F.greatest(acc["peak"], nav)
        return F.struct(nav.alias("nav"), peak.alias("peak"), F.least(acc["dd"], (nav - peak) / peak).alias("dd"),
                        F.least(acc["worst"], s).alias("worst"),
                        (acc["n"] + F.when(s < F.col("_limit"), 1).otherwise(0)).alias("n"))

    end = rows.withColumn("_e", F.aggregate("shocks", start, day))
    return end.withColumns({
        "end_nav": F.round("_e.nav", 4), "total_return": F.round(F.col("_e.nav") - 1, 4), "max_drawdown": F.round("_e.dd", 4),
        "worst_day": F.round("_e.worst", 4), "var_breaches": F.col("_e.n")}).drop("_e", "_limit", "shocks", "scenario_vol", "shock_scale")


# -- rules ----------------------------------------------------------------------------------------


def events_of(df: DataFrame, hit: Column, kind: str, value: Column, action: str) -> DataFrame:
    """Event rows where ``hit`` holds."""
    code = F.col("ts_code") if "ts_code" in df.columns else F.lit(None).cast("string")
    return df.where(hit).select("trade_date", code.alias("ts_code"), F.lit(kind).alias("event_type"),
                                value.cast("double").alias("value"), F.lit(action).alias("action"))


def portfolio_pnl(h: DataFrame, pnl: str = "ret", weight: str = "weight") -> DataFrame:
    """(trade_date, pnl)."""
    return h.groupBy("trade_date").agg(F.sum(F.col(weight) * or_zero(F.col(pnl))).alias("pnl"))


def single_stop(h: DataFrame, pnl: str = "ret", limits: RiskLimits = LIMITS) -> DataFrame:
    """Add ``stopped`` and ``new_weight``: a held security at or below the loss limit is sold.

    ``pnl`` may be the security's return or its contribution (weight times return)."""
    hit = (or_zero(F.col(pnl)) <= limits.stop_loss_single) & (F.col("weight") > 0)
    return h.withColumn("stopped", hit).withColumn("new_weight", F.when(hit, F.lit(0.0)).otherwise(F.col("weight")))


def daily_loss(h: DataFrame, pnl: str = "ret", limits: RiskLimits = LIMITS) -> DataFrame:
    """Add ``pnl``, ``breached`` and ``new_weight``: a bad day halves all positions."""
    rows = h.join(portfolio_pnl(h, pnl), "trade_date").withColumn("breached", F.col("pnl") <= limits.daily_loss_limit)
    return rows.withColumn("new_weight", F.when(F.col("breached"), F.col("weight") * 0.5).otherwise(F.col("weight")))


def monthly_loss(pnl: DataFrame, limits: RiskLimits = LIMITS) -> DataFrame:
    """Add ``month_pnl`` (running within the month) and ``liquidate``."""
    month = Window.partitionBy(F.trunc("trade_date", "month")).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    return pnl.withColumn("month_pnl", F.sum("pnl").over(month)).withColumn("liquidate", F.col("month_pnl") <= limits.max_monthly_loss)


def loss_streak(pnl: DataFrame, limits: RiskLimits = LIMITS) -> DataFrame:
    """Add ``streak`` and ``reduce``: every n-th losing day in a row fires."""
    order = Window.partitionBy(F.lit(0)).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    lost = F.col("pnl") < 0
    rows = pnl.withColumn("_island", F.sum(F.when(lost, 0).otherwise(1)).over(order))
    inside = Window.partitionBy("_island").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("streak", F.sum(lost.cast("int")).over(inside)).drop("_island")
    return rows.withColumn("reduce", (F.col("streak") > 0) & (F.col("streak") % limits.consecutive_loss_days == 0))


def portfolio_stop(curve: DataFrame, limits: RiskLimits = LIMITS) -> DataFrame:
    """Add ``nav_change`` and ``liquidate`` to a NAV table."""
    before = F.lag("nav").over(Window.partitionBy(F.lit(0)).orderBy("trade_date"))
    return curve.withColumn("nav_change", ratio(F.col("nav"), before) - 1).withColumn(
        "liquidate", F.coalesce(F.col("nav_change") <= limits.stop_loss_portfolio, F.lit(False)))


def trailing_stop(h: DataFrame, limits: RiskLimits = LIMITS, on: Axis = SERIES) -> DataFrame:
    """Add ``peak_weight``, ``stopped`` and ``new_weight``: a weight too far below its own peak is sold."""
    rows = h.withColumn("peak_weight", F.max("weight").over(on.so_far))
    w, peak = F.col("weight"), F.col("peak_weight")
    hit = (w > 0) & (ratio(w - peak, peak) <= limits.trailing_stop)
    return rows.withColumn("stopped", F.coalesce(hit, F.lit(False))).withColumn(
        "new_weight", F.when(F.col("stopped"), F.lit(0.0)).otherwise(w))


def position_limits(h: DataFrame, limits: RiskLimits = LIMITS, weight: str = "weight", stored: bool = False) -> DataFrame:
    """Add ``new_weight``: clipped to the single limit, and zero outside the largest positions, whose keys are written once if ``stored``."""
    clipped = h.withColumn("_w", F.least(F.col(weight), F.lit(limits.max_single_position)))
    kept = top_n(clipped.where("_w > 0").select("trade_date", "ts_code", "_w"), "_w", limits.max_positions, ["trade_date"])
    marks = kept.select("trade_date", "ts_code", F.lit(True).alias("_kept"))
    marks = materialize(marks, "risk-positions") if stored else marks
    marks = F.broadcast(marks) if limits.max_positions <= BROADCAST_POSITIONS else marks  # at most so many rows per date
    return clipped.join(marks, ["trade_date", "ts_code"], "left").withColumn(
        "new_weight", F.when(F.col("_kept") | (F.col("_w") <= 0), F.col("_w")).otherwise(0.0)).drop("_w", "_kept")


def sector_weights(h: DataFrame, weight: str = "weight") -> DataFrame:
    """(trade_date, industry, sector_weight); securities without an industry are left out."""
    return h.where(F.col("industry").isNotNull()).groupBy("trade_date", "industry").agg(F.sum(weight).alias("sector_weight"))


def sector_hhi(h: DataFrame, weight: str = "weight") -> DataFrame:
    """(trade_date, hhi): sum of squared sector weights, unmapped securities forming one sector."""
    mapped = h.withColumn("industry", F.coalesce("industry", F.lit(UNKNOWN_SECTOR)))
    return sector_weights(mapped, weight).groupBy("trade_date").agg(F.sum(F.col("sector_weight") ** 2).alias("hhi"))


def sector_cap(h: DataFrame, limits: RiskLimits = LIMITS) -> DataFrame:
    """Add ``sector_weight``, ``capped`` and ``new_weight``: heavy sectors are scaled down to the cap."""
    rows = h.join(sector_weights(h), ["trade_date", "industry"], "left")
    over = F.coalesce(F.col("sector_weight") > limits.max_sector_position, F.lit(False))
    return rows.withColumn("capped", over).withColumn(
        "new_weight", F.when(over, F.col("weight") * ratio(F.lit(limits.max_sector_position), "sector_weight")).otherwise(F.col("weight")))


def top3_sectors(h: DataFrame) -> DataFrame:
    """(trade_date, top3): weight of the three heaviest sectors."""
    listed = F.slice(F.sort_array(F.collect_list("sector_weight"), asc=False), 1, 3)
    return sector_weights(h).groupBy("trade_date").agg(listed.alias("_t")).select(
        "trade_date", F.aggregate("_t", F.lit(0.0), lambda a, v: a + v).alias("top3"))


def top3_cap(h: DataFrame, limits: RiskLimits = LIMITS) -> DataFrame:
    """Add ``top3`` and ``new_weight``: all positions scaled when three sectors weigh too much."""
    rows = h.join(top3_sectors(h), "trade_date", "left")
    scale = F.when(F.col("top3") > limits.max_top3_sector, ratio(F.lit(limits.max_top3_sector), "top3")).otherwise(1.0)
    return rows.withColumn("new_weight", F.col("weight") * scale)


def normalize(h: DataFrame, limits: RiskLimits = LIMITS, stored: bool = False) -> DataFrame:
    """Add ``new_weight``: scaled to sum 1, then clipped and cut to the largest positions again; ``stored`` writes the sums and the positions' keys once."""
    sums = h.groupBy("trade_date").agg(F.sum("weight").alias("_sum"))
    rows = h.join(F.broadcast(materialize(sums, "risk-sums") if stored else sums), ["trade_date"], "left")
    scaled = rows.withColumn("_scaled", F.when(F.col("_sum") > 0, ratio("weight", "_sum")).otherwise(F.col("weight")))
    return position_limits(scaled, limits, "_scaled", stored).drop("_sum", "_scaled")


@dataclass(frozen=True)
class Rule:
    """A step of the chain: its name among the events and what it does when it fires."""

    name: str
    action: str


#: The chain's steps in order.
CHAIN = (Rule("stop_loss_single", "liquidate"), Rule("daily_loss_limit", "reduce_all"), Rule("monthly_loss_limit", "liquidate_all"),
         Rule("consecutive_losses", "reduce_all"), Rule("stop_loss_portfolio", "liquidate_all"), Rule("trailing_stop", "liquidate"),
         Rule("position_limit", "reduce"), Rule("sector_limit", "reduce"), Rule("sector_concentration", "reduce_all"))
#: What is left of a weight under an action that concerns all positions.
LEFT = {"reduce_all": 0.5, "liquidate_all": 0.0}


def day_rules(h: DataFrame, curve: DataFrame, limits: RiskLimits = LIMITS) -> DataFrame:
    """One row per date: which of the four rules on the whole portfolio fire, and what they leave of every weight (``left``).

    ``h`` has ``weight`` as given and ``cut``, the weight after the stops of single positions. The daily limit looks at what these
    left over; month and losing streak follow the portfolio as it was given.
    """
    sums = h.groupBy("trade_date").agg(F.sum(F.col("weight") * or_zero(F.col("ret"))).alias("pnl"), F.sum(F.col("cut") * or_zero(F.col("ret"))).alias("_after"))
    days = loss_streak(monthly_loss(sums, limits), limits).join(portfolio_stop(curve, limits).select("trade_date", F.col("liquidate").alias("_nav")), "trade_date", "left")
    fired = {"daily_loss_limit": F.col("_after") <= limits.daily_loss_limit, "monthly_loss_limit": F.col("liquidate"),
             "consecutive_losses": F.col("reduce"), "stop_loss_portfolio": F.coalesce("_nav", F.lit(False))}
    left = F.lit(1.0)
    for rule in CHAIN[1:5]:
        left = left * F.when(fired[rule.name], F.lit(LEFT[rule.action])).otherwise(1.0)
    return days.select("trade_date", *[c.alias(name) for name, c in fired.items()], left.alias("left"))


def chain(h: DataFrame, curve: DataFrame, limits: RiskLimits = LIMITS) -> DataFrame:
    """(trade_date, ts_code, weight, new_weight, fired): all rules one after the other, each on the weights that the one before left.

    Open loop: every date starts from its given weights; what runs over the dates is the month's loss, the losing streak and each position's
    peak. ``fired`` lists the rules that changed the position or, for rules on the whole portfolio, held on its date. ``h`` holds (trade_date,
    ts_code, industry, weight, ret), ``curve`` (trade_date, nav).

    Rules that need sums take them from partial aggregates joined back, so no date gathers; these tables hold one row per date, date and
    industry, or kept position, and are broadcast, so the rows are dealt by security once and not again. The rows are written once, after the rules that
    need their order, and then only the small tables: every later step reads the rows again and derives its weights from these, which costs no
    shuffle and no second copy of the rows, and keeps the plan from doubling. Only where more positions are kept than are broadcast, rows are written at each step.
    """
    def settled(rows: DataFrame) -> DataFrame:
        return rows if limits.max_positions <= BROADCAST_POSITIONS else materialize(rows, "risk-chain")

    hit = (or_zero(F.col("ret")) <= limits.stop_loss_single) & (F.col("weight") > 0)
    rows = h.select("trade_date", "ts_code", "industry", F.col("weight").cast("double").alias("weight"), "ret", hit.alias("stop_loss_single")).withColumn(
        "cut", F.when(F.col("stop_loss_single"), 0.0).otherwise(F.col("weight")))
    rows = rows.join(F.broadcast(day_rules(rows, curve, limits)), "trade_date").withColumnsRenamed({"weight": "given"}).withColumn("weight", F.col("cut") * F.col("left"))
    rows = trailing_stop(rows, limits).withColumnsRenamed({"stopped": "trailing_stop", "weight": "_before"}).withColumn("weight", F.col("new_weight"))
    rows = materialize(rows.drop("new_weight", "_before", "peak_weight", "cut", "left", "ret"), "risk-chain")

    rows = position_limits(rows, limits, stored=True)
    rows = settled(rows.withColumn("position_limit", F.col("new_weight") != F.col("weight")).drop("weight").withColumnRenamed("new_weight", "weight"))

    sectors = materialize(sector_weights(rows), "risk-sectors")
    three = materialize(top_n(sectors, "sector_weight", 3, ["trade_date"], tie="industry").groupBy("trade_date").agg(F.sum("sector_weight").alias("top3")), "risk-sectors")
    rows = rows.join(F.broadcast(sectors), ["trade_date", "industry"], "left").join(F.broadcast(three), "trade_date", "left").withColumns({
        "sector_limit": F.coalesce(F.col("sector_weight") > limits.max_sector_position, F.lit(False)),
        "sector_concentration": F.coalesce(F.col("top3") > limits.max_top3_sector, F.lit(False))})
    scaled = F.when(F.col("sector_limit"), ratio(F.lit(limits.max_sector_position), "sector_weight")).otherwise(1.0) * F.when(
        F.col("sector_concentration"), ratio(F.lit(limits.max_top3_sector), "top3")).otherwise(1.0)
    rows = settled(rows.withColumn("weight", F.col("weight") * scaled).drop("sector_weight", "top3"))

    names = [F.when(F.col(rule.name), F.lit(rule.name)) for rule in CHAIN]
    return normalize(rows, limits, stored=True).select("trade_date", "ts_code", F.col("given").alias("weight"), "new_weight", F.concat_ws(",", *names).alias("fired"))


def factor_exposure(h: DataFrame, factors: list[str], limits: RiskLimits = LIMITS) -> DataFrame:
    """(trade_date, factor, exposure, breached): weighted factor sums, and their absolute total."""
    sums = h.groupBy("trade_date").agg(*(or_zero(F.sum(F.col("weight") * F.col(f))).alias(f) for f in factors))
    total = sum((F.abs(f) for f in factors[1:]), F.abs(factors[0]))
    cells = [F.struct(F.lit(f).alias("factor"), F.col(f).alias("exposure"), (F.abs(f) > limits.max_factor_exposure).alias("breached"))
             for f in factors]
    cells.append(F.struct(F.lit("total").alias("factor"), total.alias("exposure"), (total > limits.max_total_exposure).alias("breached")))
    return sums.select("trade_date", F.explode(F.array(*cells)).alias("_c")).select("trade_date", "_c.*")


def blacklist(triggers: DataFrame, limits: RiskLimits = LIMITS, on: Axis = SERIES) -> DataFrame:
    """Add ``blacklisted``: a stop within the previous trading days bars the security."""
    recent = on.ordered.rowsBetween(-limits.blacklist_days, -1)
    return triggers.withColumn("blacklisted", F.coalesce(F.max("stopped").over(recent), F.lit(False)))


def all_events(h: DataFrame, curve: DataFrame, limits: RiskLimits = LIMITS) -> DataFrame:
    """Events of every rule, one below the other. Every rule reads the holdings: build them from a
    stored table."""
    pnl = portfolio_pnl(h)
    sectors = sector_weights(h)
    parts = [
        events_of(single_stop(h, limits=limits), F.col("stopped"), "stop_loss_single", F.col("ret"), "liquidate"),
        events_of(pnl, F.col("pnl") <= limits.daily_loss_limit, "daily_loss_limit", F.col("pnl"), "reduce_all"),
        events_of(monthly_loss(pnl, limits), F.col("liquidate"), "monthly_loss_limit", F.col("month_pnl"), "liquidate_all"),
        events_of(loss_streak(pnl, limits), F.col("reduce"), "consecutive_losses", F.col("streak"), "reduce_all"),
        events_of(portfolio_stop(curve, limits), F.col("liquidate"), "stop_loss_portfolio", F.col("nav_change"), "liquidate_all"),
        events_of(trailing_stop(h, limits), F.col("stopped"), "trailing_stop", F.col("weight"), "liquidate"),
        events_of(sectors, F.col("sector_weight") > limits.max_sector_position, "sector_limit", F.col("sector_weight"), "reduce"),
        events_of(top3_sectors(h), F.col("top3") > limits.max_top3_sector, "sector_concentration", F.col("top3"), "reduce_all"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
