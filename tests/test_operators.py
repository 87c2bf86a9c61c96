"""Operators on small literal tables."""

import datetime as dt
import math
import random
from itertools import combinations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import catalog, evaluate, factor, model, panel, portfolio, quality, records, risk, signals
from barloom.sources import bars_io, store
from barloom.session import scratch_table
from barloom.streaming import incremental

D = dt.date(2024, 1, 1)


def day(i):
    return D + dt.timedelta(days=i)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


# -- data ------------------------------------------------------------------------------------------


def test_normalize_and_quality(spark):
    raw = spark.createDataFrame([("2024-01-15", "1", "2"), ("2024-01-16", "bad", "3"), ("2024-01-17", "4", "x")], "d string, o string, c string")
    out = bars_io.normalize(raw, {"d": "trade_date", "o": "open", "c": "close"}, F.lit("000001.SZ"))
    assert rows(out, "trade_date", "open", "close") == [("20240115", 1.0, 2.0), ("20240116", None, 3.0)]
    good = spark.createDataFrame([(1.0, 2.0, 0.5, 1.5, 10.0)], "open double, high double, low double, close double, vol double")
    assert quality.report(good).first()["passed"]
    bad = good.drop("vol").withColumn("close", F.lit(99999.0))
    verdict = quality.report(bad).first()
    assert not verdict["passed"] and verdict["warnings"] == "columns,price"
    with pytest.raises(quality.QualityError):
        quality.require_quality(bad)
    assert not quality.missing_ratio(good.where("false")).first()["ok"]


def test_date_order_across_blocks(spark):
    df = spark.createDataFrame([("a", i, i) for i in range(10)] + [("b", i, 9 - i) for i in range(10)] +
                               [("c", i, 5 if i == 4 else 6 if i < 4 else i + 5) for i in range(10)], "k string, seq long, v long")
    got = dict(rows(quality.date_sorted(df, "k", "v", "seq", block=4), "k", "is_sorted"))
    assert got == {"a": True, "b": False, "c": False}


def test_incremental_merge(spark):
    old = spark.createDataFrame([("A", day(0), 1.0), ("A", day(1), 2.0)], "ts_code string, trade_date date, close double")
    new = spark.createDataFrame([("A", day(1), 9.0, 1), ("A", day(2), 3.0, 2), ("A", day(2), 4.0, 3), ("B", day(0), 5.0, 4)],
                                "ts_code string, trade_date date, close double, seq long")
    assert rows(bars_io.incremental_merge(old, new, "seq"), "ts_code", "trade_date", "close") == [
        ("A", day(0), 1.0), ("A", day(1), 2.0), ("A", day(2), 3.0), ("B", day(0), 5.0)]


def test_streaming_merge_is_repeatable(spark):
    inbox, target, check = (scratch_table(spark, n) for n in ("inbox", "store", "check"))
    schema = "ts_code string, trade_date date, close double, vol double, seq long"
    first = spark.createDataFrame([("A", day(0), 1.0, 1.0, 1), ("A", day(1), 2.0, 1.0, 2)], schema)
    first.coalesce(1).write.parquet(inbox)
    incremental.start_merge(spark, inbox, schema, target, check).awaitTermination(120)
    spark.createDataFrame([("A", day(1), 9.0, 1.0, 3), ("A", day(2), 3.0, 1.0, 4)], schema).coalesce(1).write.mode("append").parquet(inbox)
    incremental.start_merge(spark, inbox, schema, target, check).awaitTermination(120)
    want = [("A", day(0), 1.0), ("A", day(1), 2.0), ("A", day(2), 3.0)]
    assert rows(spark.read.parquet(target), "ts_code", "trade_date", "close") == want
    incremental.merge_batch(target, "seq")(first, 0)  # the first batch once more
    assert rows(spark.read.parquet(target), "ts_code", "trade_date", "close") == want


def test_stores(spark, panel):
    df = panel(a=[1, 2], b=[3, None])
    s = store.FactorStore(spark, scratch_table(spark, "factors"))
    s.write(df, ["a", "b"])
    s.write(df.withColumn("a", F.col("a") * 10), ["a"])
    assert rows(s.read_wide(["a", "b", "zzz"]).select("a", "b"), "a", "b") == [(10.0, 3.0), (20.0, None)]
    assert s.has("b") and s.delete("b") and not s.delete("b") and rows(s.names(), "factor") == [("a",)]
    cache = store.DatasetStore(spark, scratch_table(spark, "cache"))
    assert cache.get("x") is None
    cache.put("x", df)
    assert cache.get("x").count() == 2 and cache.stats().first()["dataset"] == "x"
    cache.clear()
    assert cache.get("x") is None


# -- panels ----------------------------------------------------------------------------------------


def test_grid_and_forward_returns(spark):
    bars = spark.createDataFrame([("A", day(0), 1.0), ("A", day(1), 2.0), ("A", day(2), 4.0), ("B", day(0), 10.0), ("B", day(2), 5.0)],
                                 "ts_code string, trade_date date, close double")
    assert panel.grid(bars).count() == 6
    own = panel.forward_returns(bars, (1,))
    assert rows(own, "ts_code", "trade_date", "ret_1d") == [("A", day(0), 1.0), ("A", day(1), 1.0), ("B", day(0), -0.5)]
    shared = panel.forward_returns_on_calendar(bars, (1,))
    assert rows(shared, "ts_code", "trade_date", "ret_1d") == [("A", day(0), 1.0), ("A", day(1), 1.0), ("B", day(0), 0.0)]
    purged = panel.forward_returns(bars, (1,), purge=1)
    assert rows(purged, "ts_code", "ret_1d") == [("A", 1.0)]


def test_limit_mask(panel, spark):
    from barloom.operators import panel as ops
    df = panel({"A": {"close": [100, 90, 91]}, "B": {"close": [1, 1.05, 1.2]}})
    late = df.where("not (ts_code = 'B' and trade_date = '2024-01-01')")
    masked = ops.limit_mask(late)
    assert rows(masked, "ts_code", "trade_date", "tradable") == [
        ("A", day(0), True), ("A", day(1), False), ("A", day(2), True), ("B", day(1), False), ("B", day(2), False)]
    out = ops.apply_mask(late.withColumn("f", F.lit(1.0)), masked, ["f"])
    assert [r[0] for r in rows(out, "f")].count(None) == 3


@pytest.mark.parametrize("code, full, board", [("600000", "600000.SH", "沪市主板"), ("1", "000001.SZ", "未知"), ("300750", "300750.SZ", "创业板"),
                                               ("900901", "900901.SH", "未知"), ("430047", "430047.SH", "北交所"), ("688001", "688001.SH", "科创板")])
def test_codes(spark, code, full, board):
    r = spark.range(1).select(panel.exchange_code(F.lit(code)).alias("f"), panel.board_of(F.lit(code)).alias("b")).first()
    assert (r["f"], r["b"]) == (full, board)
    assert spark.range(1).select(panel.plain_code(F.lit(full))).first()[0] == full[:6]


# -- factors ---------------------------------------------------------------------------------------


def brute_residual(y, industry=None, cap=None):
    """Least squares on first-dropped dummies and log cap, no intercept, for one complete section."""
    cols = []
    if industry is not None:
        cols += [[float(i == name) for i in industry] for name in sorted(set(industry))[1:]]
    if cap is not None:
        cols.append([math.log(c) for c in cap])
    x = np.array(cols).T
    return y - x @ np.linalg.lstsq(x, np.array(y), rcond=None)[0]


@pytest.mark.parametrize("use_industry, use_cap", [(True, False), (False, True), (True, True)])
def test_neutralize_against_least_squares(spark, use_industry, use_cap):
    rnd = random.Random(7)
    data = [(d, f"S{i}", rnd.gauss(5, 2), rnd.choice("abc"), math.exp(rnd.gauss(8, 1))) for d in range(3) for i in range(15)]
    df = spark.createDataFrame(data, "trade_date int, ts_code string, f double, industry string, cap double")
    out = factor.neutralize(df, "f", "r", "industry" if use_industry else None, "cap" if use_cap else None)
    got = {(r["trade_date"], r["ts_code"]): r["r"] for r in out.collect()}
    for d in range(3):
        part = [r for r in data if r[0] == d]
        want = brute_residual([r[2] for r in part], [r[3] for r in part] if use_industry else None, [r[4] for r in part] if use_cap else None)
        assert [got[(d, r[1])] for r in part] == pytest.approx(list(want), abs=1e-9)


def test_neutralize_small_section_keeps_raw(spark):
    df = spark.createDataFrame([(1, "A", 5.0, "x", 2.0), (1, "B", None, "y", 3.0), (2, "A", 1.0, "x", 1.0), (2, "B", 2.0, "x", -1.0),
                                (2, "C", 3.0, None, 3.0), (2, "D", 4.0, "x", 4.0)],
                               "trade_date int, ts_code string, f double, industry string, cap double")
    got = {(r["trade_date"], r["ts_code"]): r["r"] for r in factor.neutralize(df, "f", "r", cap="cap").collect()}
    assert got[(1, "A")] == 5.0 and got[(1, "B")] is None and got[(2, "B")] is None and got[(2, "D")] != 4.0


def test_selection(spark):
    rnd = random.Random(1)
    data = []
    for _ in range(200):
        r = rnd.gauss(0, 1)
        a = r + rnd.gauss(0, 1)
        data.append((a, a * 1.5 + rnd.gauss(0, .01), rnd.gauss(0, 1), 1.0, r))
    df = spark.createDataFrame(data, "good double, copy double, noise double, flat double, ret double")
    picked = [f for f, _ in factor.select_factors(df, ["noise", "copy", "good", "flat"], "ret", min_abs_ic=0.3)]
    assert len(picked) == 1 and picked[0] in ("good", "copy")
    assert factor.uncorrelated(df, ["good", "copy", "noise", "flat"]) == ["good", "noise"]
    spearman = factor.corr_matrix(df, ["good", "copy"], "spearman").first()["corr"]
    assert spearman > 0.99


def test_spearman_of_all_pairs_over_their_complete_rows(spark):
    rnd = random.Random(2)
    gap = lambda x: None if rnd.random() < 0.2 else x
    data = [(gap(float(rnd.randrange(9))), gap(rnd.gauss(0, 1)), gap(rnd.random()), None) for _ in range(150)] + [(float("nan"), 1.0, float("inf"), None)]
    df = spark.createDataFrame(data, "a double, b double, c double, empty double")
    got = {(r["left"], r["right"]): r["corr"] for r in factor.corr_matrix(df, ["a", "b", "c", "empty"], "spearman").collect()}
    frame = pd.DataFrame(data, columns=["a", "b", "c", "empty"], dtype=float).replace(float("inf"), float("nan"))
    want = {}
    for x, y in combinations(frame.columns, 2):
        part = frame[[x, y]].dropna().rank()
        want[x, y] = pytest.approx(part[x].corr(part[y]), abs=1e-9) if len(part) else None
    assert got == want


def test_summary_of_daily_ics_and_the_verdict_on_it(spark):
    rnd = random.Random(4)
    data = []
    for d in range(12):
        for c in "ABCDEF"[: 2 if d == 0 else 6]:  # the first section is too small
            x = float(rnd.randrange(4))
            data.append((day(d), c, None if d == 3 and c == "A" else x, x / 50 + rnd.gauss(0, .02), rnd.gauss(0, 1) if d < 2 else None))
    df = spark.createDataFrame(data, "trade_date date, ts_code string, x double, near double, far double")
    got = {(r["method"], r["horizon"]): r for r in evaluate.ic_summary(df, "x", ["near", "far"]).collect()}
    frame = pd.DataFrame(data, columns=["d", "c", "x", "near", "far"])
    for method, horizon in (("pearson", "near"), ("spearman", "near"), ("pearson", "far")):
        parts = [g[["x", horizon]].astype(float).dropna() for _, g in frame.groupby("d")]
        ics = [p["x"].corr(p[horizon]) if method == "pearson" else p["x"].rank().corr(p[horizon].rank()) for p in parts if len(p) >= 3]
        r, mean, std = got[method, horizon], float(np.mean(ics)), float(np.std(ics, ddof=1)) if len(ics) > 1 else 0.0
        assert (r["ic_mean"], r["ic_std"]) == (pytest.approx(mean, abs=1e-6), pytest.approx(std, abs=1e-6))
        assert r["ic_ir"] == (pytest.approx(mean / std, abs=1e-4) if std else 0.0)
        assert (r["positive_days"], r["total_days"], r["is_full_sample"]) == (sum(i > 0 for i in ics), len(ics), len(ics) == 1)
    assert got["pearson", "far"]["is_full_sample"] and got["pearson", "near"]["total_days"] == 11
    curves = spark.createDataFrame([("A", 0.6, -0.1), ("B", -0.6, -0.5), ("C", 0.4, 0.0), ("D", 2.0, -0.6)], "ts_code string, sharpe double, max_drawdown double")
    summary = evaluate.ic_summary(df, "x", ["near", "far"])
    assert rows(evaluate.judge(curves, summary), "ts_code", "passed") == [("A", True), ("B", True), ("C", False), ("D", False)]
    assert not any(r["passed"] for r in evaluate.judge(curves, evaluate.ic_summary(df.limit(0), "x", ["near"])).collect())


def test_selection_by_one_job_equals_the_steps_one_by_one(spark):
    rnd = random.Random(3)
    names = ["f1", "f2", "f3", "f4", "f5", "flat"]
    data = []
    for _ in range(300):
        r, common = rnd.gauss(0, 1), rnd.gauss(0, 1)
        data.append((r + common, r + common + rnd.gauss(0, .2), r * .4 + rnd.gauss(0, 1), None if rnd.random() < .3 else r + rnd.gauss(0, 2), rnd.gauss(0, 1), 2.0, r))
    df = spark.createDataFrame(data, ", ".join(f"{n} double" for n in [*names, "ret"]))
    scores = {r["factor"]: r["ic"] for r in factor.filter_by_ic(df, names, "ret", 0.1).collect()}
    left = factor.mean_corr_filter(df, factor.uncorrelated(df, list(scores), scores, 0.7), 0.5)
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("selection", "one pass")
    picked = factor.select_factors(df, names, "ret", 0.1, 0.7, 0.5)
    jobs = len(seen.getJobIdsForGroup("selection"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert picked == [(f, scores[f]) for f in left] and len(picked) >= 2
    assert jobs <= 2  # a shuffle stage of the one aggregate, and its end
    assert factor.select_factors(df, [], "ret") == [] and factor.uncorrelated(df, []) == []
    assert factor.select_factors(df.limit(0), names, "ret") == []


# -- evaluation ------------------------------------------------------------------------------------


def test_returns_figures(spark):
    df = spark.createDataFrame([("A", 0.01 * (-1) ** i) for i in range(30)] + [("B", 0.01)] * 30 + [("C", 0.1)] * 3, "ts_code string, ret double")
    got = {r["ts_code"]: r for r in df.groupBy("ts_code").agg(evaluate.sharpe().alias("s"), evaluate.sharpe_population().alias("p"), evaluate.annual_return().alias("a")).collect()}
    assert got["A"]["s"] == pytest.approx(0, abs=1e-9) and got["B"]["s"] == 0 and got["C"]["s"] == 0 and got["C"]["p"] == 0
    assert got["C"]["a"] == pytest.approx(1.1 ** 252 - 1, rel=1e-9)


def test_drawdown_and_purge(panel, spark):
    dd = evaluate.max_drawdown(panel(nav=[1, 2, 1, 3]), "nav").first()["max_drawdown"]
    assert dd == -0.5
    assert evaluate.max_drawdown(panel(nav=[1]), "nav").first()["max_drawdown"] == 0
    df = spark.createDataFrame([(day(i), 0.1) for i in range(10)], "trade_date date, ret_3d double")
    r = evaluate.label_purge_check(df, ["ret_3d"], str(day(9))).first()
    assert (r["leaked"], r["safe"], r["recommended_purge"], r["clean"]) == (3, 7, 3, False)


def test_market_beta(panel, spark):
    stock = panel(ret=[0.02, None, 0.04, -0.02])
    market = spark.createDataFrame([(day(i), m) for i, m in enumerate([0.01, 0.5, 0.02, -0.01])], "trade_date date, market_ret double")
    got = [r["beta"] for r in evaluate.market_beta(stock, market, 3).orderBy("trade_date").collect()]
    assert got[:3] == [None] * 3 and got[3] == pytest.approx(2.0)


# -- portfolio -------------------------------------------------------------------------------------


def test_backtest_timing(spark):
    """Weights of day t earn from t+1; cost lowers the NAV, not the return."""
    days = [dt.date(2024, 1, 30), dt.date(2024, 1, 31), dt.date(2024, 2, 1)]
    ret = {"A": [None, 0.10, 0.10], "B": [None, 0.0, 0.20]}
    returns = spark.createDataFrame([(d, c, ret[c][i]) for i, d in enumerate(days) for c in "AB"], "trade_date date, ts_code string, ret double")
    score = {"A": [2.0, 1.0, None], "B": [1.0, 2.0, None]}
    signal = spark.createDataFrame([(d, c, score[c][i]) for i, d in enumerate(days) for c in "AB"], "trade_date date, ts_code string, signal double")
    curve = {r["trade_date"]: r for r in portfolio.backtest(returns, signal, 1).collect()}
    assert [curve[d]["ret"] for d in days] == pytest.approx([0.0, 0.1, 0.2])
    assert [curve[d]["turnover"] for d in days] == pytest.approx([0.0, 1.0, 0.5])  # all cash after the last rebalance
    assert curve[days[1]]["nav"] == pytest.approx(1.1 * (1 - 0.0031))
    assert curve[days[2]]["nav"] == pytest.approx(1.1 * (1 - 0.0031) * 1.2 * (1 - 0.00155))


def test_top_n_and_costs(spark):
    df = spark.createDataFrame([(1, "B", 1.0), (1, "A", 1.0), (1, "C", 3.0), (1, "D", None)], "d int, ts_code string, s double")
    assert rows(portfolio.top_n(df, "s", 2, ["d"]), "ts_code") == [("A",), ("C",)]
    t = spark.createDataFrame([(1000.0, 1e6, "buy"), (1e6, 1e6, "sell"), (0.0, 0.0, "sell")], "amount double, adv double, side string")
    got = rows(portfolio.trade_costs(t), "amount", "commission", "stamp", "impact")
    assert got[0] == (0.0, 5.0, 0.0, 0.0) and got[1][1] == 5.0 and got[2][2:] == pytest.approx((500.0, 100000.0))


def test_rebalance_weeks_keep_years_apart(spark):
    dates = spark.createDataFrame([(dt.date(2023, 1, 4),), (dt.date(2023, 1, 6),), (dt.date(2024, 1, 3),)], "trade_date date")
    assert rows(portfolio.rebalance_dates(dates, "W"), "rebalance_date") == [(dt.date(2023, 1, 4),), (dt.date(2023, 1, 6),), (dt.date(2024, 1, 3),)]


def test_set_turnover(spark):
    picks = spark.createDataFrame([(0, "A"), (0, "B"), (1, "B"), (1, "C")], "period int, ts_code string")
    assert rows(portfolio.set_turnover(picks), "period", "turnover") == [(0, 1.0), (1, 1.0)]


# -- risk ------------------------------------------------------------------------------------------


def test_var(spark):
    xs = [i / 100 for i in range(-10, 11)]
    df = spark.createDataFrame([(1, x) for x in xs] + [(2, 0.5)] * 5, "k int, ret double")
    h = {r["k"]: r for r in risk.var_historical(df, ["k"]).collect()}
    assert h[1]["var_95"] == pytest.approx(np.percentile(xs, 5)) and h[1]["cvar_95"] == pytest.approx(-0.095) and h[2]["var_95"] == 0
    p = {r["k"]: r for r in risk.var_parametric(df, ["k"]).collect()}
    assert p[1]["cvar_95"] < p[1]["var_95"] < 0 and p[2]["var_99"] == 0
    mc = risk.var_monte_carlo(spark, df.where("k = 1"), n=50_000).first()
    assert mc["var_95"] == pytest.approx(p[1]["var_95"], abs=0.003)


def test_stress(spark):
    out = risk.stress(spark.createDataFrame([(0.02,)], "vol double"), scenarios={"one": [-0.1], "two": [-0.1, 0.1]}).collect()
    got = {r["scenario"]: r for r in out}
    assert got["one"]["end_nav"] == 0.9 and got["one"]["max_drawdown"] == -0.1 and got["one"]["var_breaches"] == 1
    assert got["two"]["worst_day"] == -0.05  # scaled to half, the lower limit


def test_rules(spark):
    h = spark.createDataFrame([(day(0), "A", "x", 0.5, -0.09), (day(0), "B", "x", 0.2, 0.0), (day(0), "C", None, 0.3, 0.01)],
                              "trade_date date, ts_code string, industry string, weight double, ret double")
    assert rows(risk.single_stop(h), "ts_code", "new_weight") == [("A", 0.0), ("B", 0.2), ("C", 0.3)]
    assert rows(risk.daily_loss(h), "ts_code", "new_weight") == [("A", 0.25), ("B", 0.1), ("C", 0.15)]
    assert rows(risk.position_limits(h, risk.RiskLimits(max_positions=2)), "ts_code", "new_weight") == [("A", 0.1), ("B", 0.1), ("C", 0.0)]
    capped = dict(rows(risk.sector_cap(h), "ts_code", "new_weight"))
    assert capped["A"] == pytest.approx(0.5 * 0.3 / 0.7) and capped["C"] == 0.3
    assert risk.sector_hhi(h).first()["hhi"] == pytest.approx(0.7 ** 2 + 0.3 ** 2)
    pnl = spark.createDataFrame([(day(i), p) for i, p in enumerate([-1.0, -1.0, -1.0, -1.0, 1.0, -1.0])], "trade_date date, pnl double")
    assert [r["reduce"] for r in risk.loss_streak(pnl).orderBy("trade_date").collect()] == [False, False, True, False, False, False]
    stops = spark.createDataFrame([(day(i), "A", i == 0) for i in range(8)], "trade_date date, ts_code string, stopped boolean")
    assert [r["blacklisted"] for r in risk.blacklist(stops).orderBy("trade_date").collect()] == [False] + [True] * 5 + [False] * 2


# -- model -----------------------------------------------------------------------------------------


def test_splits(spark):
    df = spark.createDataFrame([(day(i), c, 1.0) for i in range(40) for c in "AB"], "trade_date date, ts_code string, y double")
    folds = model.fold_table(df, model.WalkForward(10, 10, 2, 5)).orderBy("fold").collect()
    assert [(f["train_end"], f["n_train"], f["n_val"]) for f in folds] == [(day(10), 22, 10), (day(20), 42, 10), (day(30), 62, 10)]
    assert model.chrono_split(df, 0.81).where("part = 'train'").count() == 64
    s = model.split_counts(df, model.purged_cv_splits(df)).orderBy("split").collect()
    assert [(r["n_train"], r["n_val"]) for r in s] == [(10, 20), (30, 20), (50, 18)]
    assert model.date_ratio_split(df).where("part = 'test'").count() == 16


def test_walk_forward_predicts_every_row_once(spark):
    days = [day(i + 2 * (i // 5)) for i in range(60)]  # weeks of five days
    data = [(d, c, math.sin(i * 1.7 + k), math.sin(i * 1.7 + k) / 50) for i, d in enumerate(days) for k, c in enumerate("ABCD")]
    df = spark.createDataFrame(data, "trade_date date, ts_code string, x double, y double")
    plan = model.WalkForward(20, 10, 2, 5, tile=True)
    folds = {f["fold"]: f for f in model.fold_table(df, plan).collect()}
    out, gains = model.walk_forward(df, ["x"], "y", plan, rounds=4, depth=2)
    got = out.groupBy("fold", "status").agg(F.count(F.lit(1)).alias("n"), F.count("prediction").alias("p"), F.count_distinct("trade_date", "ts_code").alias("k")).collect()
    want = sum(4 for d in days if d > folds[0]["val_after"])
    assert sum(r["n"] for r in got) == sum(f["n_val"] for f in folds.values()) == want == out.select("trade_date", "ts_code").distinct().count()
    by_fold = {r["fold"]: r for r in got}
    for k, f in folds.items():
        r, small = by_fold[k], f["n_train"] < 100
        assert (r["n"], r["k"]) == (f["n_val"], f["n_val"]) and r["p"] == (0 if small else r["n"])
        assert r["status"] == ("few training rows" if small else "ok")
    assert by_fold[0]["status"] == "few training rows" and by_fold[1]["status"] == "ok"
    assert {r["fold"]: r["gain"] for r in gains.collect()} == {k: None if f["n_train"] < 100 else 1.0 for k, f in folds.items()}


def test_chronological_cut_inside_a_date_that_holds_most_rows(spark):
    rnd = random.Random(5)
    data = [(day(0), f"c{rnd.randrange(40):02d}") for _ in range(50)] + [(day(1), f"c{rnd.randrange(40):02d}" if i % 2 else "c20") for i in range(900)] + [(day(2), "z")] * 50
    df = spark.createDataFrame(data, "trade_date date, ts_code string")
    numbered = model.row_numbers(df, "ts_code", "k").collect()
    assert sorted(r["k"] for r in numbered) == list(range(1, 1001))
    assert [r["ts_code"] for r in sorted(numbered, key=lambda r: r["k"])] == sorted(c for _, c in data)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as on a large table, whose ranges stay apart
    try:
        got = model.chrono_split(df, 0.5).collect()
        ranged = df.withColumn("_id", F.monotonically_increasing_id()).repartitionByRange("ts_code", "_id").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(r["count"] for r in ranged) < 400  # half of the rows have one code
    train = [r for r in got if r["part"] == "train"]
    assert len(got) == 1000 and len(train) == 500
    inside = sorted(c for d, c in data if d == day(1))
    assert sorted(r["ts_code"] for r in train if r["trade_date"] == day(1)) == inside[:450]
    assert model.chrono_split(df, 0.95).where("part = 'train'").count() == 950 and model.chrono_split(df.limit(0)).count() == 0


def test_boosting_goes_on_while_the_held_rows_improve(spark):
    data = [(day(i), c, float((i * 7 + k) % 10), ((i * 7 + k) % 10) / 100) for i in range(50) for k, c in enumerate("ABCD")]
    df = spark.createDataFrame(data, "trade_date date, ts_code string, x double, y double")
    assert model.train_trees(df, ["x"], "y", rounds=12).getNumTrees > 3


def test_risk_chain_takes_each_rule_on_what_the_last_one_left(spark):
    limits = risk.RiskLimits(max_positions=3, max_sector_position=0.5, max_top3_sector=0.9, max_single_position=0.4)
    rows = [  # day 0: A stops out, the rest loses 0.02 of 0.7; day 1: a calm day on which B is far below its peak
        (day(0), "A", "x", 0.3, -0.10), (day(0), "B", "x", 0.4, -0.02), (day(0), "C", "y", 0.2, 0.0), (day(0), "D", None, 0.1, None),
        (day(1), "A", "x", 0.4, 0.01), (day(1), "B", "x", 0.1, 0.0), (day(1), "C", "y", 0.3, 0.0), (day(1), "D", None, 0.1, 0.0)]
    h = spark.createDataFrame(rows, "trade_date date, ts_code string, industry string, weight double, ret double")
    curve = spark.createDataFrame([(day(0), 1.0), (day(1), 0.99)], "trade_date date, nav double")
    got = {(r["trade_date"], r["ts_code"]): (round(r["new_weight"], 6), r["fired"]) for r in risk.chain(h, curve, limits).collect()}
    # what is left after the stop is 0.7, of which B and C weigh more than 0.5 after scaling, so all are clipped at 0.4
    assert got == {
        (day(0), "A"): (0.0, "stop_loss_single"), (day(0), "B"): (0.4, ""), (day(0), "C"): (round(2 / 7, 6), ""), (day(0), "D"): (round(1 / 7, 6), ""),
        (day(1), "A"): (0.4, ""), (day(1), "B"): (0.0, "trailing_stop"), (day(1), "C"): (0.375, ""), (day(1), "D"): (0.125, "")}
    # limits that make the whole portfolio shrink: daily loss halves, the sector is cut to its cap, then all to what three sectors may weigh
    tight = risk.RiskLimits(daily_loss_limit=-0.001, max_sector_position=0.1, max_top3_sector=0.15, max_single_position=1.0)
    one = {r["ts_code"]: (round(r["new_weight"], 6), r["fired"]) for r in risk.chain(h.where(F.col("trade_date") == day(0)), curve, tight).collect()}
    # halves: B 0.2 (x: 0.2 -> 0.1), C 0.1, D 0.05; three sectors weigh 0.3 -> scaled by one half: 0.05, 0.05, 0.025
    assert {k: v[0] for k, v in one.items()} == {"A": 0.0, "B": 0.4, "C": 0.4, "D": 0.2}
    assert one["B"][1] == "daily_loss_limit,sector_limit,sector_concentration" and one["D"][1] == "daily_loss_limit,sector_concentration"


def test_first_cut_equals_a_search_over_all_cuts():
    import random

    import numpy as np

    from barloom.operators import boosting

    r = random.Random(5)
    x = np.array([[r.randint(0, 40) / 4 for _ in range(300)], [r.random() for _ in range(300)]])
    y = np.array([(v > 3) * 2.0 + r.random() for v in x[0]])
    edges = [boosting._edges(v) for v in x]
    feature, cut, value, gain, leaf = boosting._tree(np.stack([np.searchsorted(e, v) for e, v in zip(edges, x)]), edges, y, 1, 0.5)

    def loss(f, c):
        low = x[f] <= c
        return sum(((y[s] - y[s].mean()) ** 2).sum() for s in (low, ~low)) if min(low.sum(), (~low).sum()) >= boosting.MIN_LEAF else math.inf

    assert (feature[0], cut[0]) == min(((f, c) for f in (0, 1) for c in edges[f]), key=lambda fc: loss(*fc))
    low = x[feature[0]] <= cut[0]
    assert np.allclose(value[leaf], np.where(low, y[low].mean(), y[~low].mean()) / 2)
    assert math.isclose(gain.sum(), ((y - y.mean()) ** 2).sum() - loss(feature[0], cut[0]))


def test_fit_sample_is_bounded_and_nulls_get_no_prediction(spark):
    from barloom.operators import boosting

    df = spark.createDataFrame([(day(i), c, float(i), float(i)) for i in range(500) for c in "ABCD"], "trade_date date, ts_code string, x double, y double")
    key = ["trade_date", "ts_code"]
    rows = boosting.sampled(df, [(0, F.lit(True), 2000), (1, F.col("x") < 100, 400)], key, 500)
    sizes = {r["model"]: r["count"] for r in rows.groupBy("model").count().collect()}
    assert 400 < sizes[0] < 600 and sizes[1] == 400
    assert rows.where("model = 1").select(*key).exceptAll(df.where("x < 100").select(*key)).count() == 0
    trees = boosting.fit(rows, ["x"], "y", key, rounds=3)
    out = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 1.0), (None, 1.0), (0, None)], "m int, x double").select("m", "x", trees.predict(df, F.col("m")).alias("p")).collect()
    assert [r["p"] is not None for r in out] == [True, True, False, False, False]


def test_short_calendar_gives_empty_tables(spark):
    df = spark.createDataFrame([(day(i), "A", 1.0, 1.0) for i in range(5)], "trade_date date, ts_code string, x double, y double")
    predictions, gains = model.walk_forward(df, ["x"], "y")
    assert predictions.count() == gains.count() == 0 and predictions.columns == ["trade_date", "ts_code", "fold", "y", "prediction", "status"]


def test_small_splits_keep_a_status(spark):
    data = [(split, n, day(i), c, float(i + k), float(i + k)) for split, n, m in ((1, 50, 30), (2, 200, 30), (3, 200, 5)) for i in range(m) for k, c in enumerate("ABC")]
    df = spark.createDataFrame(data, "split int, n_train int, trade_date date, ts_code string, prediction double, fwd_ret double")
    got = {r["split"]: r for r in model.cv_split_scores(df, "fwd_ret").collect()}
    assert {k: (r["status"], r["n_val"], r["rmse"]) for k, r in got.items()} == {
        1: ("few training rows", 90, None), 2: ("ok", 90, 0.0), 3: ("few validation rows", 15, None)}
    assert model.cv_objective(df, "fwd_ret").first()["n_splits"] == 1


def test_blend_and_retrain(spark):
    a = spark.createDataFrame([(1, "A", 1.0), (1, "B", 2.0)], "trade_date int, ts_code string, prediction double")
    b = spark.createDataFrame([(1, "A", 2.0), (1, "C", 5.0)], "trade_date int, ts_code string, prediction double")
    assert [round(v, 6) for _, v in rows(model.blend(a, b), "ts_code", "prediction")] == [1.3, 2.0, 5.0]
    m = spark.createDataFrame([(3, 0.0, 0.1, 5, 99), (10, 0.0, 0.1, 5, 99), (10, 0.1, 0.1, 0, 1)],
                              "days_since int, current_ic double, baseline_ic double, n_drifted int, model_age_days int")
    assert rows(model.retrain_decision(m), "reasons", "retrain") == [("", False), ("ic,drift,age", True), ("interval", False)]


# -- signals, records, catalogue -------------------------------------------------------------------


def test_extract_json(spark):
    df = spark.createDataFrame([('x {"signal": "bullish", "confidence": 0.8, "risk_flags": ["a"]} y',), ("nothing",), ('{"confidence": 1}',), (None,)], "raw string")
    got = rows(signals.extract_json(df, "raw"), "signal", "confidence", "risk_flags")
    assert got == [("bullish", 0.8, ["a"])] + [("neutral", 0.5, ["parse_error"])] * 3


def test_risk_review(spark):
    df = spark.createDataFrame([(-0.005,), (-0.02,), (-0.04,), (-0.06,)], "var_95 double")
    assert rows(signals.risk_review(df), "var_95", "risk_level", "go_no_go") == [
        (-0.005, "low", "go"), (-0.02, "medium", "go"), (-0.04, "medium", "no_go"), (-0.06, "high", "no_go")]


def test_nearest(spark):
    df = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(5)], "vec_id int, embedding array<float>")
    near = records.nearest(df, F.array(F.lit(2.0), F.lit(0.0)), 3)
    assert [r["vec_id"] for r in near.collect()] == [2, 1, 3]


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "factor string, depends_on string")


def test_dependency_graph(spark):
    diamond = edges(spark, ("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"))
    pairs = catalog.closure(diamond)
    assert rows(catalog.all_dependencies(pairs, "d"), "depends_on") == [("a",), ("b",), ("c",)]
    assert rows(catalog.all_dependents(pairs, "a"), "factor") == [("b",), ("c",), ("d",)]
    assert rows(catalog.topological_levels(diamond), "node", "level") == [("a", 0), ("b", 1), ("c", 1), ("d", 2)]
    assert not catalog.has_cycle(diamond)
    loop = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("x", "a"), ("s", "s"))
    assert catalog.has_cycle(loop)
    assert rows(catalog.cyclic_nodes(loop), "node") == [("a",), ("b",), ("c",), ("s",)]
    with pytest.raises(ValueError):
        catalog.topological_levels(loop)
    assert catalog.remove_node(diamond, "b").count() == 2
    assert catalog.remove_edges(diamond, edges(spark, ("d", "b"))).count() == 3


def test_search_from_named_nodes(spark):
    g = edges(spark, ("d", "b"), ("d", "c"), ("b", "a"), ("c", "a"), ("x", "y"), ("y", "x"))
    assert rows(catalog.all_dependencies(g, "d"), "depends_on") == [("a",), ("b",), ("c",)] and rows(catalog.all_dependents(g, "a"), "factor") == [("b",), ("c",), ("d",)]
    seeds = spark.createDataFrame([("b",), ("x",), ("a",), ("none",)], "node string")
    assert rows(catalog.reachable(g, seeds), "seed", "node") == [("b", "a"), ("x", "x"), ("x", "y")]
    assert rows(catalog.closure(g, seeds), "factor", "depends_on") == [("b", "a"), ("x", "x"), ("x", "y")]


def test_cyclic_components_equal_mutual_reach(spark):
    r = random.Random(9)
    pairs = {(f"n{r.randint(0, 14):02d}", f"n{r.randint(0, 14):02d}") for _ in range(24)} | {("p", "q"), ("q", "p"), ("q", "r"), ("r", "s"), ("s", "r"), ("t", "t"), ("t", "u")}
    reach = set(pairs)
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in pairs if b == c}
        if more == reach:
            break
        reach = more
    want = sorted((a, min(b for x, b in reach if x == a and (b, a) in reach)) for a in {a for a, b in reach if a == b})
    assert rows(catalog.cyclic_components(edges(spark, *pairs)), "node", "component") == want
    assert catalog.cyclic_components(edges(spark, ("a", "b"), ("b", "c"))).count() == 0


def test_cycle_path(spark):
    g = edges(spark, ("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("d", "e"), ("e", "b"), ("z", "z"))
    assert catalog.cycle_path(g) == ["b", "c", "d", "b"]
    assert catalog.cycle_path(edges(spark, ("s", "s"), ("s", "t"))) == ["s", "s"] and catalog.cycle_path(edges(spark, ("a", "b"))) == []
    with pytest.raises(ValueError, match="b -> c -> d -> b"):
        catalog.topological_levels(g)


def test_catalogue(spark):
    schema = "name string, display_name string, category string, expression string, description string, tags array<string>, owner string, created_at double"
    old = spark.createDataFrame([("A", "a", "x", "e", "d", ["T1"], "o", 1.0)], schema)
    new = spark.createDataFrame([("a", "a2", "y", "e2", "d2", ["t2"], "p", 9.0), ("b", "b", "y", "e", "d", [], "p", 5.0)], schema)
    merged = catalog.upsert(old, new)
    assert rows(merged, "name", "display_name", "created_at") == [("A", "a2", 1.0), ("B", "b", 5.0)]
    assert catalog.find_by_category(merged, "Y").count() == 2 and catalog.find_by_tag(merged, "T2").count() == 1
    assert catalog.search(merged, "E2").count() == 1
    with pytest.raises(KeyError):
        catalog.Computations().compute("x", old)


def test_files_are_pruned_by_their_date_spans(spark):
    path = scratch_table(spark, "spans")
    for k in range(3):
        rows_of_file = [("S1", day(10 * k + i), float(i)) for i in range(5)]
        spark.createDataFrame(rows_of_file, "ts_code string, trade_date date, close double").coalesce(1).write.mode("append").parquet(path)
    spans = bars_io.file_spans(spark, path)
    assert sorted((r["first"], r["last"], r.n_rows) for r in spans.collect()) == [(day(10 * k), day(10 * k + 4), 5) for k in range(3)]
    assert len(bars_io.files_of_range(spans, str(day(4)), str(day(12)))) == 2
    got = bars_io.read_files_of_range(spark, path, spans, str(day(4)), str(day(12)))
    assert len(got.inputFiles()) == 2 and sorted(r.trade_date for r in got.collect()) == [day(i) for i in (4, 10, 11, 12)]
    assert bars_io.read_files_of_range(spark, path, spans, str(day(5)), str(day(9))).count() == 0
    spark.createDataFrame([("S2", day(99), 1.0)], "ts_code string, trade_date date, close double").coalesce(1).write.mode("append").parquet(path)
    assert bars_io.file_spans(spark, path, spans).count() == 4
    assert rows(bars_io.file_spans(spark, path, spans).where("n_rows = 1"), "first", "last") == [(day(99), day(99))]


def test_ranges_are_loaded_once(spark):
    path = scratch_table(spark, "ranges")
    source = spark.createDataFrame([("A", day(i), float(i)) for i in range(10)] + [("B", day(3), 1.0)], "ts_code string, trade_date date, close double")

    def ask(*requests):
        out = bars_io.load_ranges(spark, spark.createDataFrame([(c, str(day(a)), str(day(b))) for c, a, b in requests], "ts_code string, first_date string, last_date string"), source, path)
        return sorted((r.ts_code, r.n_rows) for r in out.collect())

    assert ask(("A", 0, 4), ("A", 3, 5), ("B", 5, 9), ("C", 0, 9)) == [("A", 3), ("A", 5), ("B", 0), ("C", 0)]
    assert ask(("A", 0, 4), ("A", 4, 8), ("A", 4, 8), ("B", 0, 9)) == [("A", -1), ("A", 5), ("B", 1)]
    assert sorted((r.ts_code, r.trade_date) for r in spark.read.parquet(f"{path}/bars").collect()) == [("A", day(i)) for i in range(9)] + [("B", day(3))]


def test_var_historical_of_one_hot_key(spark):
    rnd = random.Random(4)
    values = [round(rnd.gauss(0, 0.02), 3) for _ in range(3000)]  # many ties
    df = spark.createDataFrame([("hot", v) for v in values] + [("few", 0.1)] * 5 + [("hot", None)], "k string, ret double")
    got = {r.k: r for r in risk.var_historical(df, ["k"]).collect()}
    q95, q99 = np.quantile(values, [0.05, 0.01])
    assert got["hot"].var_95 == pytest.approx(q95, abs=1e-6) and got["hot"].var_99 == pytest.approx(q99, abs=1e-6)
    assert got["hot"].cvar_99 == pytest.approx(np.mean([v for v in values if v <= q99 + 1e-12]), abs=1e-6)
    assert got["few"].var_95 == 0.0
