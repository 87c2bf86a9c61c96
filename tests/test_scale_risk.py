"""Risk and ranking plans that must read their input once and leave large tables where they are."""

import pandas as pd
from pyspark.sql import functions as F

from barloom.functions import section
from barloom.operators import evaluate, risk
from barloom.session import materialize


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_var_all_reads_its_series_once(spark):
    series = spark.range(977).select((F.sin("id") / 50).alias("ret"))
    out = risk.var_all(spark, series)
    assert "Range (0, 977" not in _plan(out)
    got = {r["method"]: r for r in out.collect()}
    assert set(got) == {"historical", "parametric", "monte_carlo"} and all(r["var_99"] < r["var_95"] < 0 for r in got.values())


def test_sums_per_date_are_broadcast(spark):
    rows = [("2024-01-01", "A", 1.0), ("2024-01-01", "B", 3.0), ("2024-01-02", "A", 5.0)]
    df = spark.createDataFrame(rows, "trade_date string, ts_code string, v double")
    out = section.with_stats(df, ["trade_date"], _m=F.avg("v"))
    assert "strategy=broadcast" in _plan(out)
    assert sorted((r["ts_code"], r["_m"]) for r in out.collect()) == [("A", 2.0), ("A", 5.0), ("B", 2.0)]
    assert "strategy=broadcast" not in _plan(section.with_stats(df, ["ts_code"], _m=F.avg("v")))


def test_rank_sum_computes_its_columns_once(spark):
    df = spark.range(983).select(F.lit("d").alias("trade_date"), F.col("id").cast("string").alias("ts_code"), (F.col("id") % 5).cast("double").alias("a"), F.col("id").cast("double").alias("b"))
    out = section.rank_sum(df, {"a": 1.0, "b": -1.0}, "s")
    assert "Range (0, 983" not in _plan(out) and out.count() == 983


def test_market_beta_broadcasts_the_market(panel):
    stock = panel(close=[1.0, 2.0, 3.0], ret=[0.1, 0.2, 0.3])
    market = panel(close=[1.0, 2.0, 3.0], market_ret=[0.1, 0.2, 0.3])
    out = evaluate.market_beta(stock, market, 2)
    assert "strategy=broadcast" in _plan(out)
    assert [r["beta"] if r["beta"] is None else round(r["beta"], 9) for r in out.orderBy("trade_date").collect()] == [None, 1.0, 1.0]


def test_the_chain_writes_its_rows_once(spark, monkeypatch):
    written = []

    def noted(df, name):
        written.append((name, df.columns))
        return materialize(df, name)

    monkeypatch.setattr(risk, "materialize", noted)
    rows = [(f"2024-01-0{d}", c, i, w, r) for d in (1, 2) for c, i, w, r in [("A", "x", 0.5, -0.2), ("B", "x", 0.3, 0.1), ("C", "y", 0.2, 0.0)]]
    h = spark.createDataFrame(rows, "trade_date string, ts_code string, industry string, weight double, ret double").withColumn("trade_date", F.to_date("trade_date"))
    curve = h.select("trade_date", F.lit(1.0).alias("nav")).distinct()
    few = risk.chain(h, curve, risk.RiskLimits(max_positions=2)).orderBy("trade_date", "ts_code").collect()
    assert [n for n, c in written if "given" in c] == ["risk-chain"]
    monkeypatch.setattr(risk, "BROADCAST_POSITIONS", 1)
    assert risk.chain(h, curve, risk.RiskLimits(max_positions=2)).orderBy("trade_date", "ts_code").collect() == few


def test_rank_sum_deals_small_sections_once_and_slices_hot_ones(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(d, f"{i:03d}", v, float((i * 7) % 5) if i % 9 else None) for d, n in (("a", 300), ("b", 20), (None, 30)) for i in range(n)
            for v in [nan if i % 11 == 3 else inf if i % 11 == 4 else float(i % 13)]]
    df = spark.createDataFrame(rows, "trade_date string, ts_code string, a double, b double")
    got = [sorted((str(r[0]), r[1], r[2] if r[2] is None else round(r[2], 12)) for r in section.rank_sum(df, {"a": 1.0, "b": -1.0}, "s", hot_rows=h).collect()) for h in (0, 25, 1000)]
    frame = pd.DataFrame(rows, columns=["d", "c", "a", "b"]).replace([inf], nan)
    ranks = frame.groupby("d", dropna=False)[["a", "b"]].rank(pct=True)
    want = sorted((str(d), c, None if v != v else round(v, 12)) for d, c, v in zip([r[0] for r in rows], frame["c"], ranks["a"] - ranks["b"]))
    assert [g for g in got[2] if g[0] != "None"] == [w for w in want if w[0] != "None"] and got[2] == want
    assert [g for g in got[1] if g[0] != "None"] == [w for w in want if w[0] != "None"]
    plan = section.rank_sum(df, {"a": 1.0, "b": -1.0}, "s")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_summary_deals_rows_once_with_all_horizons(spark, monkeypatch):
    written = []

    def noted(df, name):
        written.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return materialize(df, name)

    monkeypatch.setattr(evaluate, "materialize", noted)
    # one date holds all rows, and half of them one factor value
    rows = [("d", f"{i:04d}", 1.0 if i % 2 else float(i), float(i % 17), None if i % 5 == 0 else float(i % 3)) for i in range(2000)]
    df = spark.createDataFrame(rows, "trade_date string, ts_code string, x double, near double, far double")
    got = {(r["method"], r["horizon"]): r["ic_mean"] for r in evaluate.ic_summary(df, "x", ["near", "far"]).collect()}
    frame = pd.DataFrame(rows, columns=["d", "c", "x", "near", "far"])
    for h in ("near", "far"):
        known = frame.dropna(subset=[h])
        assert abs(got["pearson", h] - known["x"].corr(known[h])) < 2e-6 and abs(got["spearman", h] - known["x"].rank().corr(known[h].rank())) < 2e-6
    (name, plan), = written
    assert name == "pairs" and plan.count("Exchange hashpartitioning") == 1 and plan.index("Exchange") > plan.index("Generate")


def test_evaluation_queries_deal_raw_rows_by_security_only(spark, monkeypatch):
    import os

    import pytest

    from barloom.plans import research_queries

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    written = []

    def noted(df, name):
        written.append(df._jdf.queryExecution().executedPlan().toString())
        return materialize(df, name)

    monkeypatch.setattr(evaluate, "materialize", noted)
    for build in (research_queries.evaluate_summary, research_queries.factor_verdict):
        written.clear()
        build(spark, folder)
        assert written[0].count("Exchange hashpartitioning") == 2  # raw rows by security, dated rows by value
