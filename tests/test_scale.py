"""Plans that must keep their tasks small on large tables."""

import datetime as dt
import os
import timeit

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import core, expr, section, stats
from barloom.operators import boosting, evaluate, factor, model, signals
from barloom.operators import panel as pn
from barloom.plans import catalogue


def test_series_sorts_spread_over_partitions(panel):
    """AQE must not merge the tasks of plans that sort each series in several orders."""
    df = panel({c: dict(close=[100.0 + (i * 7 + k) % 13 for i in range(30)], vol=[1.0] * 30) for k, c in enumerate("ABCDEF")})
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranked = expr.factor_table(core.by_series(df), {"r": stats.rank("close"), "d": stats.dense_rank("close", 5)})
    bundle = signals.factor_bundle(df)
    for out in (evaluate.evaluate_factor(df, "close", "close"), ranked, pn.market_snapshot(df), signals.snapshot_vector(bundle, ["MA_5"])):
        assert out.rdd.getNumPartitions() == n


def test_ranks_among_known_rows_share_a_sort(panel):
    df = panel(close=[3.0, 1.0, 2.0, 2.0, 5.0, 2.0], vol=[1.0, None, 1.0, 1.0, None, 1.0])
    known = F.col("vol").isNotNull()
    both = df.withColumns({"a": evaluate.series_rank(F.col("close"), core.SERIES, known), "b": evaluate.series_rank_among(F.col("close"), core.SERIES, known)})
    assert [(r["a"], r["b"]) for r in both.orderBy("trade_date").collect()] == [(4.0, 4.0), (None, None), (2.0, 2.0), (2.0, 2.0), (None, None), (2.0, 2.0)]


def test_market_snapshot_takes_the_last_bar(panel):
    df = panel({"A": dict(close=[1.0, 2.0, 4.0]), "B": dict(close=[5.0])})
    assert [(r["ts_code"], r["close"], r["data_rows"], r["returns_1d"]) for r in pn.market_snapshot(df).orderBy("ts_code").collect()] == [
        ("A", 4.0, 3, 1.0), ("B", 5.0, 1, 0.0)]


def test_rank_correlations_join_distinct_pairs_only(spark):
    """Copies of a pair are counted before ranks are joined; the base rows meet no rank."""
    data = [(float(x), float((x * 7) % 5)) for x in range(10)] * 200
    df = spark.createDataFrame(data, "a double, b double").repartition(4)
    pairs = section.value_pairs(df, [], F.col("a"), F.col("b"))
    assert pairs.count() == 10 and pairs.agg(F.sum("_w")).first()[0] == 2000
    want = pd.DataFrame(data, columns=["a", "b"]).rank().corr().iloc[0, 1]
    got = factor.corr_matrix(df, ["a", "b"], "spearman")
    assert abs(got.first()["corr"] - want) < 1e-12


def test_pair_moments_are_those_of_the_rows_that_have_both(spark):
    """Figures of all pairs come from one narrow row per pair and task, not from an aggregate of hundreds of numbers."""
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(3000, 4)) @ rnd.normal(size=(4, 4)) + [1e7, 0, 100, 0]
    frame = pd.DataFrame(x, columns=list("abcd")).assign(flat=0.1, once=[4.0] + [None] * 2999, odd=[float("nan"), float("inf")] + [1.0, 2.0] * 1499)
    frame.loc[rnd.random(3000) < 0.3, "b"] = None
    frame.loc[0, ["a", "b"]] = [1e15, None]  # no part of the pairs of b
    data = [tuple(None if pd.isna(v) and c != "odd" else float(v) for c, v in zip(frame.columns, r)) for r in frame.itertuples(index=False)]
    df = spark.createDataFrame(data, ", ".join(f"{c} double" for c in frame)).repartition(7)
    names = list(frame.columns)
    plan = factor.corr_matrix(df, names)
    got = {(r["left"], r["right"]): r["corr"] for r in plan.collect()}
    for i, a in enumerate(names):
        for b in names[i + 1:]:
            if "odd" in (a, b) and "once" not in (a, b):
                assert np.isnan(got[a, b])
            elif {"flat", "once"} & {a, b}:
                assert got[a, b] is None or "odd" in (a, b)
            else:
                both = frame[[a, b]].dropna().astype(float)
                assert got[a, b] == pytest.approx(np.corrcoef((both - both.median()).T)[0, 1], abs=1e-9)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("covar") == 0 and len(got) == 21
    found = factor._numbers(df, names, "d")
    assert found["std"]["flat"] == found["std"]["once"] == 0.0 and np.isnan(found["std"]["odd"])
    assert found["std"]["c"] == pytest.approx(frame["c"].std(), rel=1e-12) and found["ic"]["b"][2] == frame["b"].count() and found["ic"]["odd"][2] == 3000
    assert factor.corr_matrix(df.limit(0), ["a", "b"]).collect() == [("a", "b", None)] and factor.corr_matrix(df, ["a"]).collect() == []


def test_pair_correlations_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 1.0, 2.0), (1, 2.0, 4.0), (1, 4.0, 5.0), (1, nan, 1.0), (1, inf, 1.0), (1, None, 3.0), (2, 0.1, 1.0), (2, 0.1, 2.0), (2, 0.1, 3.0), (3, 1.0, 1.0)]
    pairs = section.value_pairs(spark.createDataFrame(rows, "g int, a double, b double"), ["g"], F.col("a"), F.col("b"))
    got = {r["g"]: (r["n"], r["pearson"], r["spearman"]) for r in section.pair_correlations(pairs, ["g"]).collect()}
    assert got[1][0] == 3 and abs(got[1][1] - np.corrcoef([1, 2, 4], [2, 4, 5])[0, 1]) < 1e-12 and abs(got[1][2] - 1) < 1e-12
    assert got[2] == (3, None, None) and got[3] == (1, None, None)


def test_oof_metrics_counts_copies(spark):
    rows = [(1, 0.1, 0.2), (1, -0.1, 0.3), (2, 0.4, 0.1), (2, None, 0.1)] * 50
    df = spark.createDataFrame(rows, "fold int, prediction double, y double")
    got = model.oof_metrics(df, "y").first()
    plain = pd.DataFrame(rows, columns=["fold", "p", "y"]).dropna()
    assert (got["n_folds"], got["n"]) == (2, 150)
    assert abs(got["ic"] - plain["p"].corr(plain["y"])) < 1e-9 and abs(got["rank_ic"] - plain["p"].rank().corr(plain["y"].rank())) < 1e-9
    assert abs(got["hit_rate"] - 2 / 3) < 1e-12 and abs(got["rmse"] - ((plain["p"] - plain["y"]) ** 2).mean() ** 0.5) < 1e-12
    empty = model.oof_metrics(df.limit(0), "y").first()
    assert (empty["n_folds"], empty["n"], empty["rmse"], empty["rank_ic"]) == (0, 0, None, None)


def test_scores_by_look_up_are_those_of_the_walk():
    rnd = np.random.default_rng(3)
    x = np.round(rnd.normal(size=(4, 6000)), 2)
    y, at = x[0] * x[1] + np.sin(3 * x[2]), np.round(rnd.normal(size=(4, 5000)), 2)
    at[:, :3] = [[np.inf, -np.inf, 0.0]] * 4
    for depth in (1, 3, 5, 6, 7):
        trees = boosting.Trees(list("abcd"), {0: boosting._grow(x, y, 60, 0.05, depth)}, depth)

        def walk():
            return sum((value[boosting._leaf(at, feature, cut, depth)] for feature, cut, value, *_ in trees.models[0]), np.zeros(at.shape[1]))

        score = trees.scorer(0)
        assert (score(at) == walk()).all()
        if depth == 5:
            assert min(timeit.repeat(lambda: score(at), number=3)) < 0.6 * min(timeit.repeat(walk, number=3))


def test_scores_by_cells_are_those_of_the_walk():
    rnd = np.random.default_rng(5)
    for n_features in (1, 2, 3, 4, 5):
        x = np.round(rnd.normal(size=(n_features, 6000)), 2)
        y, at = np.sin(3 * x[0]) * x[-1] + x.sum(axis=0), np.round(rnd.normal(size=(n_features, 10_000)), 2)
        at[:, :3] = [[np.inf, -np.inf, 0.0]] * n_features
        rounds = boosting._grow(x, y, 60, 0.05, 5)
        looked_up = boosting._lookup(rounds, n_features, 5)
        cells = boosting._cells(*looked_up, boosting._CELLS)
        walk = sum((value[boosting._leaf(at, feature, cut, 5)] for feature, cut, value, *_ in rounds), np.zeros(at.shape[1]))
        assert len(cells) == len(rounds) and (boosting._cell_scores(at, looked_up[0], cells) == walk).all()
        assert boosting._cells(*looked_up, sum(value.size for _, value in cells) - 1) is None  # no room: bit sets
        assert (boosting.Trees([""] * n_features, {0: rounds}, 5).scorer(0)(at) == walk).all()
    bits = timeit.repeat(lambda: boosting._scores(at, *looked_up), number=3)
    assert min(timeit.repeat(lambda: boosting._cell_scores(at, looked_up[0], cells), number=3)) < 0.8 * min(bits)


def test_scores_are_not_written_before_they_are_read(spark):
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    for name in ("score_factors", "score_rows"):
        rows = catalogue()[name].run(spark, folder)
        assert not any("scores-" in f for f in rows.inputFiles())
        assert rows._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_rows_in_no_sample_meet_no_group(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 10).alias("g"))
    groups = [(k, F.col("g") <= k, 2000 * (k + 1)) for k in range(10)]
    out = boosting.sampled(df, groups, ["id"], 100)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "Filter" in plan[plan.index("Generate"):]
    draw = {r["id"]: r["d"] for r in df.select("id", F.pmod(F.xxhash64("id"), F.lit(1 << 31)).alias("d")).collect()}
    want = {(i, k) for i in range(20_000) for k, _, n in groups if i % 10 <= k and draw[i] < int((1 << 31) * 100 / n)}
    assert {(r["id"], r["model"]) for r in out.collect()} == want and len(want) > 300


def test_series_bars_are_the_bars_dealt_once(spark):
    """Also with securities summed ahead of the exchange; the factors need no exchange behind it."""
    from barloom.plans.research_queries import factor_frame
    from barloom.sources.panel_tables import bars, series_bars

    folder = "/root/testdata/sf0.001"
    want = sorted(bars(spark, folder).withColumn("amount", F.round("amount", 6)).collect())
    for hot_rows in (0, 600, 10 ** 6):
        got = series_bars(spark, folder, hot_rows).withColumn("amount", F.round("amount", 6)).select(*bars(spark, folder).columns)
        assert sorted(got.collect()) == want and len(want) > 1000
    plan = factor_frame(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_walk_forward_scores_rows_where_they_lie(spark):
    start = dt.date(2024, 1, 1)
    rows = [(start + dt.timedelta(days=d), f"S{c}", float((d * 7 + c) % 11), float((d * 3 + c * c) % 7) / 100) for d in range(60) for c in range(12)]
    df = spark.createDataFrame(rows, "trade_date date, ts_code string, x double, y double")
    plan = model.WalkForward(min_train_days=20, step_days=10, tile=True)
    predictions, _ = model.walk_forward(df, ["x"], "y", plan, rounds=3, depth=2)
    assert "Exchange hashpartitioning(trade_date" not in predictions._jdf.queryExecution().executedPlan().toString()
    assert predictions.count() == predictions.dropDuplicates(["trade_date", "ts_code"]).count() == 12 * sum(d > 25 for d in range(60))


def test_leaves_of_growing_are_those_of_the_walk():
    rnd = np.random.default_rng(6)
    x = np.round(rnd.normal(size=(3, 4000)), 1)
    y = np.where(x[0] > 1, 5.0, x[1] * x[2])
    edges = [boosting._edges(row) for row in x]
    bins = np.stack([np.searchsorted(e, row) for e, row in zip(edges, x)])
    for depth in (1, 4, 8):  # some nodes are not split
        feature, cut, value, gains, at = boosting._tree(bins, edges, y, depth, 1.0)
        assert (at == boosting._leaf(x, feature, cut, depth)).all() and len(set(at.tolist())) > 1
        assert all(value[k] == pytest.approx(y[at == k].mean(), abs=1e-9) for k in set(at.tolist()))


def test_models_are_those_of_all_rows_whatever_the_partitioning(spark):
    rnd, start, rows = np.random.default_rng(1), dt.date(2024, 1, 1), []
    for d in range(40):
        for c in range(60):
            a, b = float(rnd.integers(1, 30)), float(rnd.integers(-8, 9))
            rows.append((start + dt.timedelta(days=d), f"S{c:02d}", a, b, np.sin(a) + b / 5 + rnd.normal()))
    rows = [(*r[:4], float(r[4])) for r in rows]
    kind, ends, key = "trade_date date, ts_code string, a double, b double, y double", {7: rows[15 * 60][0], 9: rows[27 * 60][0], 11: None}, ["trade_date", "ts_code"]
    first, second = (boosting.fit_upto(df, ends, ["a", "b"], "y", key, rounds=20) for df in (
        spark.createDataFrame(rows, kind).repartition(5), spark.createDataFrame(rows[::-1], kind).repartition(3, "ts_code")))
    for model_no, end in ends.items():
        own = np.array([r[2:] for r in rows if end is None or r[0] <= end]).T
        want = boosting._grow(own[:2], own[2], 20, boosting.RATE, boosting.DEPTH)
        assert len(want) == len(first.models[model_no])
        for w, g, h in zip(want, first.models[model_no], second.models[model_no]):
            assert (w[0] == g[0]).all() and (w[1] == g[1]).all() and np.allclose(w[2], g[2], atol=1e-12)
            assert all(np.array_equal(a, b) for a, b in zip(g, h))


def test_a_model_of_many_rows_takes_them_all(spark):
    n = 300_000
    df = spark.range(n, numPartitions=3).select(
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") / 1000).cast("int")).alias("trade_date"), F.format_string("%06d", "id").alias("ts_code"),
        (F.col("id") % 97).cast("double").alias("x"), F.pmod(F.xxhash64("id"), F.lit(1 << 20)).cast("double").alias("y"))
    trees = model.train_trees(df, ["x"], "y", rounds=2)
    total = df.where(F.col("ts_code") < f"{n * 4 // 5:06d}").agg(F.sum("y")).first()[0]
    assert trees.models[0][0][2][0] == total / (n * 4 // 5)  # the mean of the first four fifths


def test_edges_are_at_most_an_eighth_of_a_bin_off(spark):
    rnd = np.random.default_rng(2)
    x = np.stack([rnd.normal(size=20_000) ** 3, 108 + rnd.normal(size=20_000) / 1e6, np.where(rnd.random(20_000) < 0.5, 0.0, rnd.random(20_000)), np.zeros(20_000)])
    df = spark.createDataFrame(pd.DataFrame(x.T, columns=list("abcd"))).withColumn("_segment", F.lit(0))
    edges, = boosting._edges_of(df, list("abcd"), 1)
    for own, e in zip(x, edges):
        own = np.sort(own)
        for q in range(1, 64):
            at = e[np.searchsorted(e, own[int((own.size - 1) * q / 64)])]
            first, behind = np.searchsorted(own, at), np.searchsorted(own, at, side="right")
            assert first - own.size / 512 - 1 <= (own.size - 1) * q / 64 <= behind
    assert edges[3].tolist() == [0.0]
