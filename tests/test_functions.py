"""Function library on small literal series."""

import math

import pytest
from pyspark.sql import functions as F

from barloom.functions import expr, indicators, scalar, section, series, stats
from barloom.functions.library import FunctionLibrary, UnknownFunction
from barloom.operators.recursive import Recursive, with_recursive

N = None


@pytest.mark.parametrize("fn, w, given, wanted", [
    (stats.mean, 3, [1, 2, 3, 4], [N, N, 2, 3]),
    (stats.mean, 2, [1, N, 3, 4], [N, N, N, 3.5]),          # a missing value empties its windows
    (stats.mean, 0, [1, N, 3, 5], [3, 3, 3, 3]),            # whole series skips missing values
    (stats.mean, 4, [1, N, 3, 5], [3, 3, 3, 3]),            # a covering window is the whole series
    (stats.mean, 9, [7], [7]),
    (stats.std, 2, [1, 3, 3], [N, 1.414214, 0]),
    (stats.var, 0, [1, 3], [2, 2]),
    (stats.total, 0, [N, N], [0, 0]),
    (stats.total, 2, [1, 2, 3], [N, 3, 5]),
    (stats.count, 2, [1, N, 3, 4], [N, N, N, 2]),
    (stats.count, 0, [1, N, 3], [2, 2, 2]),
    (stats.highest, 2, [1, 5, 2], [N, 5, 5]),
    (stats.lowest, 2, [4, 5, 2], [N, 4, 2]),
    (stats.median, 3, [5, 1, 9, 2], [N, N, 5, 2]),
    (stats.product, 2, [2, 3, 4], [N, 6, 12]),
    (stats.zscore, 0, [1, 1, 1], [0, 0, 0]),
    (stats.dense_rank, 0, [2, 1, 2], [2, 1, 2]),
    (stats.dense_rank, 3, [2, 1, 2, 2], [N, N, 2, 2]),
    (stats.rank, 0, [3, N, 1], [2 / 3, 1, 1 / 3]),
    (stats.rank, 2, [3, 1, 1, 5], [N, 0.5, 1, 1]),
])
def test_statistics(panel, column, fn, w, given, wanted):
    got = column(panel(x=given), fn("x", w))
    assert got == [N if v is N else round(v, 6) for v in wanted]


def test_percentile_and_scale(panel, column):
    df = panel(x=[1, 2, 3, 4])
    assert column(df, stats.percentile("x", 25)) == [1.75] * 4
    assert column(df, stats.scale("x", 2, -1)) == [-1, -0.333333, 0.333333, 1]
    assert column(panel(x=[5, 5]), stats.scale("x")) == [0.5, 0.5]


def test_steps(panel, column):
    df = panel(x=[2, 4, 0, 0, 5, N])
    assert column(df, series.delta("x")) == [N, 1, -1, N, 0, N]
    assert column(df, series.delay("x", -3)) == [2, 4, 0, 0, 5, N]
    assert column(df, series.diff("x", 2)) == [N, N, -2, -4, 5, N]
    assert column(df, series.fill_forward("x")) == [2, 4, 0, 0, 5, 5]
    assert column(panel(x=[N, 1, N]), series.fill_backward("x")) == [1, 1, N]
    assert column(panel(x=[-9, 0.5, 9, N]), series.clip("x", -2, 2)) == [-2, 0.5, 2, N]


def test_two_series(panel, column):
    df = panel(x=[1, 2, 3, 5], y=[2, 4, 6, 6])
    assert column(df, series.corr("x", "y", 3)) == [N, N, 1, 0.755929]
    assert column(df, series.covariance("x", "y", 2)) == [N, 1, 1, 0]
    assert column(df, series.beta("x", "y", 2)) == [N, 0.5, 0.5, 0]
    assert column(panel(x=[1, 1], y=[1, 2]), series.corr("x", "y", 2)) == [N, N]


def test_expression_rules(panel, column):
    df = panel(a=[6, 0, N, -7], b=[0, 0, 2, 3])
    assert column(df, expr.div("a", "b")) == [0, 0, 0, -2.333333]
    assert column(df, expr.mod("a", "b")) == [N, N, N, 2]
    assert column(df, expr.power("a", 0.5)) == [2.44949, 0, N, N]
    assert column(df, expr.gt("a", "b")) == [1, 0, 0, 0]
    assert column(df, expr.ne("a", "b")) == [1, 0, 1, 1]
    assert column(df, expr.eq("a", "b")) == [0, 1, 0, 0]
    assert column(df, expr.both("a", "b")) == [0, 0, 1, 1]      # missing counts as true
    assert column(df, expr.either("a", "b")) == [1, 0, 1, 1]
    assert column(df, expr.negate("a")) == [0, 1, 0, 0]
    assert column(df, expr.choose("a", 1.0)) == [1, N, 1, 1]
    assert column(df, expr.choose("a", 1.0, "b")) == [1, 0, 1, 1]


def test_scalar_rules(panel, column):
    df = panel(x=[4, 0, -1, N])
    floor = round(math.log(1e-10), 6)
    assert column(df, scalar.log("x")) == [1.386294, floor, floor, floor]
    assert column(df, scalar.log10("x"))[1:] == [-10, -10, -10]
    assert column(df, scalar.sqrt("x")) == [2, 0, 0, 0]
    assert column(df, scalar.sign_pow("x")) == [2, 0, -1, N]
    assert column(df, scalar.when("x", 7.0)) == [7, 0, 7, 7]
    assert column(df, scalar.keep_between("x", low=0)) == [4, 0, N, N]
    assert column(df, scalar.keep_every("x", 2)) == [4, N, -1, N]
    assert column(df, scalar.leverage("x", F.lit(0.0))) == [N] * 4
    assert column(panel(x=[1, 2, 3, 4, 2]), scalar.growth("x")) == [N, N, N, N, 1]


def test_window_indicators(panel, column):
    df = panel(high=[10, 12, 13], low=[8, 9, 12], close=[9, 11, 12])
    tr = df.withColumn("tr", indicators.true_range("high", "low", "close"))
    assert column(tr, indicators.atr_of("tr", 2)) == [N, N, 2.5]
    assert column(panel(x=[1, 2, N]), indicators.wma("x", 2)) == [N, 1.666667, 0.666667]
    assert column(panel(x=[1, 3]), indicators.boll("x", 2, 2)) == [N, round(2 + 2 * math.sqrt(2), 6)]
    obv = panel(c=[1, 2, 2, 1], v=[5, 6, 7, 8]).withColumn("s", indicators.obv_step("c", "v"))
    assert column(obv, indicators.obv_of("s")) == [5, 11, 11, 3]


def test_recursive_indicators(panel, column):
    close = [10, 11, 10.5, 12, 11]
    df = panel({"A": {"high": [c + 1 for c in close], "low": [c - 1 for c in close], "close": close},
                "B": {"high": [2], "low": [1], "close": [1.5]}})
    out = with_recursive(df, [Recursive("EMA", "ema", {"w": 3}), Recursive("RSI", "rsi", {"w": 2}), Recursive("SAR", "sar"),
                              Recursive("KDJ", "k", {"n": 2}), Recursive("MACD", "macd")])
    a = out.where("ts_code = 'A'")
    assert column(a, F.col("ema")) == [10, 10.5, 10.5, 11.25, 11.125]
    # gains 0,1 seed 0.5; then (0.5+0)/2, ...; losses likewise
    assert column(a, F.col("rsi"))[:3] == [99.009901, 99.009901, 50]
    assert column(a, F.col("sar"))[:2] == [9, 9]
    assert column(a, F.col("k"))[0] == 50
    b = out.where("ts_code = 'B'")
    assert column(b, F.col("rsi")) == [N] and column(b, F.col("sar")) == [N] and column(b, F.col("k")) == [50]


def test_ema_gap_decays(panel, column):
    out = with_recursive(panel(close=[1, N, 3]), [Recursive("EMA", "ema", {"w": 3})])
    assert column(out, F.col("ema")) == [1, 1, 2.333333]


def test_recursions_equal_a_walk_over_long_series(spark):
    import random

    import numpy as np
    import pandas as pd

    from barloom.operators import recursive

    r = random.Random(4)
    closes = {"L": [100 + r.gauss(0, 5) + i / 50 for i in range(9000)], "G": [None if r.random() < 0.4 or 300 < i < 900 else r.uniform(50, 60) for i in range(1500)],
              "Z": [0.0] * 700 + [1.0] * 700, "N": [None, None, 3.0], "V": [None] * 4}
    rows = [(c, i, None if v is None else float(v), None if v is None else v + r.random(), None if v is None else v - r.random()) for c, vs in closes.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "ts_code string, trade_date int, close double, high double, low double")
    out = with_recursive(df, [Recursive("EMA", "ema", {"w": 12}), Recursive("EMA", "slow", {"w": 500}), Recursive("EMA", "one", {"w": 1}),
                              Recursive("MACD", "macd"), Recursive("RSI", "rsi"), Recursive("KDJ", "k")])
    assert out.columns == [*df.columns, "ema", "slow", "one", "macd", "rsi", "k"]
    got = out.toPandas().sort_values(["ts_code", "trade_date"])

    def average(x, a):
        return x.ewm(alpha=1 - a, adjust=False).mean()

    for code, g in got.groupby("ts_code"):
        x, n = g["close"].astype(float).reset_index(drop=True), len(g)
        np.testing.assert_allclose(g["ema"], average(x, 11 / 13), rtol=1e-9)
        np.testing.assert_allclose(g["slow"], average(x, 499 / 501), rtol=1e-9)
        np.testing.assert_allclose(g["one"], x.ffill())
        np.testing.assert_allclose(g["macd"], average(average(x, 11 / 13) - average(x, 25 / 27), 0.8), atol=1e-9)
        move = x.diff().fillna(0.0)
        sides = []
        for side in (move.clip(lower=0), (-move).clip(lower=0)):
            e = [0.0] * min(n, 13) + ([side[:14].mean()] if n >= 14 else [])
            for v in side[14:]:
                e.append((e[-1] * 13 + v) / 14)
            sides.append(np.array(e))
        want = [100 - 100 / (1 + (u / d if d else 100)) for u, d in zip(*sides)] if n >= 14 else [np.nan] * n
        np.testing.assert_allclose(g["rsi"], want, rtol=1e-8)
        top, bottom = g["high"].astype(float).rolling(9).max(), g["low"].astype(float).rolling(9).min()
        raw = np.where(top.isna(), 0.0, np.where(top == bottom, 50.0, (g["close"].astype(float) - bottom) / (top - bottom) * 100))
        raw[0] = 50.0
        np.testing.assert_allclose(g["k"], average(pd.Series(raw), 2 / 3), rtol=1e-9, atol=1e-12)
    plan = with_recursive(df, [Recursive("MACD", "m"), Recursive("KDJ", "k")])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and recursive.block_rows(0.5) == 256


def sections(spark, values):
    return spark.createDataFrame([(1, f"S{i:03d}", None if v is None else float(v)) for i, v in enumerate(values)],
                                 "trade_date int, ts_code string, x double")


@pytest.mark.parametrize("values", [
    [3, 1, 2], [1, 1, 1], [N, 2, N, 1], [0, -0.0, 5, -5], [1e-300, 1e300, -1e300, 0, 7, 8, 8.0000001],
    [2 ** k for k in range(-20, 20)] + [-(2 ** k) for k in range(-20, 20)], [5], [N, N], [100 + i / 1000 for i in range(200)] + [0] * 100,
])
def test_ranks_match_brute_force(spark, values):
    df = sections(spark, values)
    known = sorted(v for v in values if v is not N)
    rows = section.pct_rank(df, "x", "r").collect()
    for r in rows:
        if r["x"] is None:
            assert r["r"] is None
        else:
            less, upto = sum(v < r["x"] for v in known), sum(v <= r["x"] for v in known)
            assert r["r"] == pytest.approx((less + upto + 1) / 2 / len(known))
    places = {r["ts_code"]: r["r"] for r in section.ordinal_rank(df, "x", "r").collect()}
    order = sorted(range(len(values)), key=lambda i: (values[i] is None, values[i] if values[i] is not None else 0, i))
    assert places == {f"S{i:03d}": pytest.approx((k + 1) / len(values)) for k, i in enumerate(order)}


def test_section_scores(spark):
    df = sections(spark, [1, 2, 3, 10, N])
    assert {r["d"] for r in section.demedian(df, "x", "d").collect()} == {-1.5, -0.5, 0.5, 7.5, None}
    assert [r["z"] for r in section.zscore(df, "x", "z").collect() if r["x"] is None] == [0.0]
    assert sorted(r["s"] for r in section.scale(sections(spark, [4, 4]), "x", "s").collect()) == [0.5, 0.5]


def test_library(spark):
    lib = FunctionLibrary()
    assert len(lib.names()) == 55 and lib.names() == sorted(lib.names())
    assert lib.has("mean") and lib.has("cs_rank") and not lib.has("roc")
    lib.register("twice", lambda c: F.col(c) * 2)
    assert spark.range(3).select(lib.call("TWICE", "id").alias("v")).collect()[2]["v"] == 4
    with pytest.raises(UnknownFunction):
        lib.call("nope", "x")
    with pytest.raises(UnknownFunction):
        lib.call("EMA", "x")
    with pytest.raises(UnknownFunction):
        lib.add(spark.range(1), "o", "nope")


ARGS = {"PERCENTILE": ("close", 50.0), "CORR": ("close", "vol", 2), "COVARIANCE": ("close", "vol", 2), "BETA": ("close", "vol", 2),
        "WHEN": ("close", "vol"), "LEVERAGE": ("close", "vol"), "DEBT_RATIO": ("close", "vol"), "ROIC": ("close", "vol"),
        "KDJ": ("high", "low", "close"), "SAR": ("high", "low"), "ATR": ("high", "low", "close", 2), "NATR": ("high", "low", "close", 2),
        "OBV": ("close", "vol"), "RSI": ("close", 2), "MA": ("close", 2), "BOLL": ("close", 2), "WMA": ("close", 2)}


def test_every_function_by_name(panel):
    lib = FunctionLibrary()
    df = panel({c: {"high": [11, 12, 14, 13, 15, 16], "low": [9, 10, 11, 11, 12, 13], "close": [10, 11, 13, 12, 14, 15],
                    "vol": [5, 7, 6, 9, 8, 4]} for c in "AB"})
    for name in lib.names():
        last = lib.add(df, "out", name, *ARGS.get(name, ("close",))).where("ts_code = 'B' and trade_date = '2024-01-06'").collect()
        assert len(last) == 1 and (last[0]["out"] is not None or name == "KEEP"), name


def test_ranks_with_nan_inf_ties_and_one_big_date(spark):
    rows = [("d1", f"S{i:04d}", 5.0) for i in range(900)] + [("d1", "X1", float("nan")), ("d1", "X2", float("inf")), ("d1", "X3", None), ("d1", "X4", -1.0), ("d1", "X5", 7.0)]
    rows += [("d2", "A", None), ("d2", "B", None), ("d3", "A", 2.0)]
    df = spark.createDataFrame(rows, "trade_date string, ts_code string, x double")
    pct = {(r["trade_date"], r["ts_code"]): r["r"] for r in section.pct_rank(df, "x", "r").collect()}
    assert pct["d1", "X4"] == 1 / 902 and pct["d1", "X5"] == 1.0 and pct["d1", "S0003"] == (1 + 901 + 1) / 2 / 902
    assert pct["d1", "X1"] is pct["d1", "X2"] is pct["d1", "X3"] is pct["d2", "A"] is None and pct["d3", "A"] == 1.0
    place = {(r["trade_date"], r["ts_code"]): round(r["r"] * 905) for r in section.ordinal_rank(df.where("trade_date = 'd1'"), "x", "r").collect()}
    assert [place["d1", c] for c in ("X4", "S0000", "S0899", "X5", "X1", "X2", "X3")] == [1, 2, 901, 902, 903, 904, 905]
    mid = {r["trade_date"]: r["m"] for r in section.group_quantile(df, ["trade_date"], "x", 0.5, "m").collect()}
    assert mid == {"d1": 5.0, "d3": 2.0}
