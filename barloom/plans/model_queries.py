"""Queries for folds and splits, boosted trees, scoring and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.core import ratio
from barloom.operators import model, panel
from barloom.operators.model import WalkForward
from barloom.plans.base import query
from barloom.plans.research_queries import FACTORS, factor_frame
from barloom.plans.tables import TABLES
from barloom.session import materialize
from barloom.sources.panel_tables import bars

KEY = "trade_date:d ts_code"
FEATURES = ["mom5", "vola20", "volume_ratio", "day_span"]
TILED = WalkForward(tile=True)

TABLES["day_rows"] = ("bars", """
    SELECT *, sum(n) OVER (ORDER BY trade_date) AS upto, row_number() OVER (ORDER BY trade_date) - 1 AS day_no
    FROM (SELECT trade_date, count(*) AS n FROM bars GROUP BY 1)""")


@query("walk_forward_folds", "fold:i train_end:d val_after:d val_until:d n_train:i n_val:i", uses="day_rows", sql="""
    SELECT (d.day_no - 252) // 60 AS fold, d.trade_date AS train_end, d.trade_date + 5 AS val_after, d.trade_date + 65 AS val_until, d.upto AS n_train,
           (SELECT coalesce(sum(n), 0) FROM day_rows v WHERE v.trade_date > d.trade_date + 5 AND v.trade_date <= d.trade_date + 65) AS n_val
    FROM day_rows d WHERE day_no >= 252 AND (day_no - 252) % 60 = 0 AND day_no < (SELECT count(*) FROM day_rows) - 60""")
def walk_forward_folds(spark, folder):
    return model.fold_table(bars(spark, folder))


@query("chrono_split", KEY + " part", uses="bars", sql="""
    SELECT trade_date, ts_code, CASE WHEN row_number() OVER (ORDER BY trade_date, ts_code) <= floor(0.8 * (SELECT count(*) FROM bars)) THEN 'train' ELSE 'eval' END AS part FROM bars""")
def chrono_split(spark, folder):
    return model.chrono_split(bars(spark, folder))


@query("purged_cv_splits", "split:i train_before:d val_from:d val_until:d n_train:i n_val:i", uses="day_rows", sql="""
    p AS (SELECT k AS split, k * z AS a, CASE WHEN k * z > 5 THEN k * z - 5 ELSE k * z END AS b, least((k + 1) * z, n - 1) AS c
          FROM (SELECT count(*) AS n, count(*) // 4 AS z FROM day_rows), (SELECT unnest([1, 2, 3]) AS k))
--
SELECT split, tb.trade_date AS train_before, vf.trade_date AS val_from, vu.trade_date AS val_until, tb.upto - tb.n AS n_train,
       (vu.upto - vu.n) - (vf.upto - vf.n) AS n_val
FROM p JOIN day_rows tb ON tb.day_no = b JOIN day_rows vf ON vf.day_no = a JOIN day_rows vu ON vu.day_no = c""")
def purged_cv_splits(spark, folder):
    b = bars(spark, folder)
    return model.split_counts(b, model.purged_cv_splits(b))


@query("date_ratio_split", KEY + " part", uses="bars day_rows", sql="""
    SELECT trade_date, ts_code, CASE WHEN day_no < floor(0.8 * (SELECT count(*) FROM day_rows)) THEN 'train' ELSE 'test' END AS part
    FROM bars JOIN day_rows USING (trade_date)""")
def date_ratio_split(spark, folder):
    return model.date_ratio_split(bars(spark, folder))


@query("head_tail_dates", "trade_date:d part", uses="day_rows", sql="""
    SELECT trade_date, 'tail' AS part FROM day_rows WHERE day_no >= (SELECT count(*) FROM day_rows) - 30
    UNION ALL SELECT trade_date, 'head' FROM day_rows WHERE day_no < (SELECT count(*) FROM day_rows) // 2""")
def head_tail_dates(spark, folder):
    b = bars(spark, folder)
    tail = model.recent_dates(b).withColumn("part", F.lit("tail"))
    half = model.date_ratio_split(panel.dates(b), 0.5).where("part = 'train'").select("trade_date", F.lit("head").alias("part"))
    return tail.unionByName(half)


@query("gbt_walk_forward", KEY + " fold:i prediction:8 status")
def gbt_walk_forward(spark, folder):
    return model.walk_forward(factor_frame(spark, folder), FEATURES, "fwd_ret", TILED)[0]


@query("feature_importance", "feature gain:6")
def feature_importance(spark, folder):
    return model.mean_importance(model.walk_forward(factor_frame(spark, folder), FEATURES, "fwd_ret", TILED)[1])


_USABLE = "mom5 IS NOT NULL AND vola20 IS NOT NULL AND volume_ratio IS NOT NULL AND day_span IS NOT NULL AND fwd_ret IS NOT NULL"


@query("gbt_fold_rows", "fold:i status n_val:i n_predicted:i n_finite:i importance:6 positive:b", uses="factors", sql=f"""
    ud AS (SELECT *, sum(n) OVER (ORDER BY trade_date) AS upto, row_number() OVER (ORDER BY trade_date) - 253 AS since, max(trade_date) OVER () AS last
           FROM (SELECT trade_date, count(*) AS n FROM factors WHERE {_USABLE} GROUP BY 1)),
    st AS (SELECT since // 60 AS fold, upto AS n_train, trade_date + 5 AS val_after, coalesce(lead(trade_date + 5) OVER (ORDER BY trade_date), last) AS val_until
           FROM ud WHERE since >= 0 AND since % 60 = 0),
    fo AS (SELECT fold, n_train, (SELECT coalesce(sum(n), 0) FROM ud WHERE trade_date > val_after AND trade_date <= val_until) AS n_val FROM st WHERE val_after < val_until)
--
SELECT fold, CASE WHEN n_train < 100 THEN 'few training rows' WHEN n_val < 10 THEN 'few validation rows' ELSE 'ok' END AS status, n_val,
       CASE WHEN n_train >= 100 AND n_val >= 10 THEN n_val ELSE 0 END AS n_predicted, n_predicted AS n_finite,
       CASE WHEN n_predicted > 0 THEN 1.0 END AS importance, CASE WHEN n_predicted > 0 THEN true END AS positive
FROM fo WHERE n_val > 0""")
def gbt_fold_rows(spark, folder):
    """What holds of every fold whatever the trees: all rows predicted once and finite, importances that are not negative and add up to 1."""
    predictions, gains = model.walk_forward(factor_frame(spark, folder), FEATURES, "fwd_ret", TILED)
    rows = predictions.dropDuplicates(["trade_date", "ts_code"]).groupBy("fold", "status").agg(
        F.count(F.lit(1)).alias("n_val"), F.count("prediction").alias("n_predicted"), F.count_if(F.abs("prediction") < 10).alias("n_finite"))
    shares = gains.groupBy("fold").agg(F.sum("gain").alias("importance"), F.every(F.col("gain") >= 0).alias("positive"))
    return rows.join(shares, "fold")


@query("importance_mean", "feature gain:6", uses="factors", sql="""
    SELECT feature, avg(gain) AS gain FROM (
        SELECT year(trade_date) AS fold, 'mom5' AS feature, abs(corr(mom5, fwd_ret)) AS gain FROM factors GROUP BY 1
        UNION ALL SELECT year(trade_date), 'day_span', abs(corr(day_span, fwd_ret)) FROM factors GROUP BY 1) GROUP BY 1""")
def importance_mean(spark, folder):
    from barloom.functions.core import pearson
    f = factor_frame(spark, folder).groupBy(F.year("trade_date").alias("fold")).agg(
        *(F.abs(pearson(c, "fwd_ret")).alias(c) for c in ("mom5", "day_span")))
    return model.mean_importance(f.unpivot(["fold"], ["mom5", "day_span"], "feature", "gain"))


@query("score_factors", KEY + " predict_score:8")
def score_factors(spark, folder):
    f = materialize(factor_frame(spark, folder).select("trade_date", "ts_code", *FEATURES, "fwd_ret"), "factors")  # counted, fitted on and scored
    return model.score_factors(model.train_trees(f, FEATURES, "fwd_ret"), f, FEATURES)


@query("score_rows", KEY + " scored:b near:b", uses="bars", sql="SELECT trade_date, ts_code, true AS scored, true AS near FROM bars")
def score_rows(spark, folder):
    """Every row of the table gets one score, also where features are missing, and scores are of the label's size."""
    rows = score_factors(spark, folder)
    return rows.select("trade_date", "ts_code", F.col("predict_score").isNotNull().alias("scored"), (F.abs("predict_score") < 1).alias("near"))


def linear_scores(spark, folder):
    """Scores of a fixed formula, yearly folds: stands in for a fitted model where SQL must agree."""
    f = factor_frame(spark, folder)
    return f.select("trade_date", "ts_code", "fwd_ret", F.year("trade_date").alias("fold"),
                    (F.col("mom5") * -0.5 + F.col("day_span")).alias("prediction"))


_SCORES = "scores AS (SELECT trade_date, ts_code, fwd_ret, year(trade_date) AS fold, mom5 * -0.5 + day_span AS prediction FROM factors)"


@query("oof_metrics", "n_folds:i n:i rmse:6 ic:6 rank_ic:6 hit_rate:6", uses="factors", sql=f"""{_SCORES},
    r AS (SELECT *, rank() OVER (ORDER BY prediction) + (count(*) OVER (PARTITION BY prediction) - 1) / 2 AS rp,
                 rank() OVER (ORDER BY fwd_ret) + (count(*) OVER (PARTITION BY fwd_ret) - 1) / 2 AS ry
          FROM scores WHERE prediction IS NOT NULL AND fwd_ret IS NOT NULL)
--
SELECT count(DISTINCT fold) AS n_folds, count(*) AS n, sqrt(avg((prediction - fwd_ret) * (prediction - fwd_ret))) AS rmse,
       corr(prediction, fwd_ret) AS ic, corr(rp, ry) AS rank_ic, avg(CASE WHEN sign(prediction) = sign(fwd_ret) THEN 1 ELSE 0 END) AS hit_rate FROM r""")
def oof_metrics(spark, folder):
    return model.oof_metrics(linear_scores(spark, folder), "fwd_ret")


@query("blend_predictions", KEY + " prediction:6", uses="bars", sql="""
    SELECT trade_date, ts_code, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE a * 0.7 + b * 0.3 END AS prediction FROM (
        SELECT trade_date, ts_code, CASE WHEN vol > 10 THEN close END AS a, CASE WHEN vol < 40 THEN open END AS b FROM bars)""")
def blend_predictions(spark, folder):
    b = bars(spark, folder)
    first = b.where("vol > 10").select("trade_date", "ts_code", F.col("close").alias("prediction"))
    second = b.where("vol < 40").select("trade_date", "ts_code", F.col("open").alias("prediction"))
    return model.blend(first, second)


@query("cv_objective", "n_splits:i mean_ic:6 mean_rmse:6 score:6", uses="factors", sql=f"""{_SCORES},
    known AS (SELECT * FROM scores WHERE prediction IS NOT NULL AND fwd_ret IS NOT NULL),
    dr AS (SELECT *, sum(n) OVER (ORDER BY trade_date) AS upto, row_number() OVER (ORDER BY trade_date) - 1 AS day_no
           FROM (SELECT trade_date, count(*) AS n FROM known GROUP BY 1)),
    p AS (SELECT k AS split, k * z AS a, k * z - 5 AS b, least((k + 1) * z, n - 1) AS c
          FROM (SELECT count(*) AS n, count(*) // 4 AS z FROM dr), (SELECT unnest([1, 2, 3]) AS k)),
    s AS (SELECT split, vf.trade_date AS f, vu.trade_date AS u FROM p JOIN dr vf ON vf.day_no = a JOIN dr vu ON vu.day_no = c),
    v AS (SELECT split, known.* FROM known JOIN s ON trade_date >= f AND trade_date < u),
    m AS (SELECT split, sqrt(avg((prediction - fwd_ret) * (prediction - fwd_ret))) AS rmse FROM v GROUP BY 1),
    i AS (SELECT split, avg(ic) AS ic FROM (SELECT split, trade_date, CASE WHEN count(*) > 2 THEN corr(prediction, fwd_ret) END AS ic FROM v GROUP BY 1, 2)
          WHERE NOT isnan(ic) GROUP BY 1)
--
SELECT count(*) AS n_splits, avg(ic) AS mean_ic, avg(rmse) AS mean_rmse, avg(ic) * 100 - avg(rmse) * 10 AS score FROM m JOIN i USING (split)""")
def cv_objective(spark, folder):
    known = linear_scores(spark, folder).dropna(subset=["prediction", "fwd_ret"])
    splits = model.split_counts(known, model.purged_cv_splits(known)).select(
        "split", "n_train", F.explode(F.sequence("val_from", F.date_sub("val_until", 1))).alias("trade_date"))
    return model.cv_objective(known.join(splits, "trade_date"), "fwd_ret")


_DRIFT = "d AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS factor, abs(avg({f}) FILTER (trade_date >= '2001-01-01') - avg({f}) FILTER (trade_date < '1998-01-01')) "
    f"/ nullif(stddev_samp({f}) FILTER (trade_date < '1998-01-01'), 0) AS shift FROM factors" for f in FACTORS) + ")"


def drift_of(spark, folder):
    f = factor_frame(spark, folder)
    return model.feature_drift(f.where("trade_date < '1998-01-01'"), f.where("trade_date >= '2001-01-01'"), FACTORS)


@query("feature_drift", "factor shift:6 drifted:b", uses="factors", sql=f"""{_DRIFT}
--
SELECT factor, shift, coalesce(shift > 2, false) AS drifted FROM d""")
def feature_drift(spark, folder):
    return drift_of(spark, folder)


_DAILY = f"""{_SCORES}, di AS (SELECT trade_date, CASE WHEN n > 2 AND NOT isnan(c) THEN c END AS ic FROM (SELECT trade_date, corr(prediction, fwd_ret) AS c,
    count(*) FILTER (prediction IS NOT NULL AND fwd_ret IS NOT NULL) AS n FROM scores GROUP BY 1)),
    yearly AS (SELECT year(trade_date) AS yr, avg(ic) AS ic FROM di GROUP BY 1),
    pairs AS (SELECT yr, ic, first_value(ic) OVER (ORDER BY yr) AS base FROM yearly)"""


def yearly_ic(spark, folder):
    """Mean daily IC per year next to the first year's."""
    from pyspark.sql import Window
    from barloom.operators.evaluate import daily_ic
    years = daily_ic(linear_scores(spark, folder), "prediction", "fwd_ret").groupBy(F.year("trade_date").alias("yr")).agg(F.avg("ic").alias("ic"))
    return years.withColumn("base", F.first("ic").over(Window.partitionBy(F.lit(0)).orderBy("yr")))


@query("ic_degradation", "yr:i ic:6 monitor:b retrain:b", uses="factors", sql=f"""{_DAILY}
--
SELECT yr, ic, coalesce(ic - base < -0.3, false) AS monitor, coalesce(ic - base < -0.05, false) AS retrain FROM pairs""")
def ic_degradation(spark, folder):
    y = yearly_ic(spark, folder)
    return y.withColumns({"monitor": model.ic_degraded(F.col("ic"), F.col("base")),
                          "retrain": model.ic_degraded(F.col("ic"), F.col("base"), model.IC_RETRAIN)})


@query("current_ic", "n_rows:i current_ic:6", uses="factors", sql=f"""{_SCORES},
    k AS (SELECT * FROM scores WHERE fwd_ret IS NOT NULL),
    r AS (SELECT * FROM k WHERE trade_date IN (SELECT DISTINCT trade_date FROM k ORDER BY trade_date DESC LIMIT 30)),
    i AS (SELECT trade_date, count(*) AS n, CASE WHEN count(prediction) > 2 AND NOT isnan(corr(prediction, fwd_ret)) THEN corr(prediction, fwd_ret) END AS ic FROM r GROUP BY 1)
--
SELECT sum(n) AS n_rows, CASE WHEN sum(n) >= 100 THEN avg(ic) END AS current_ic FROM i""")
def current_ic(spark, folder):
    return model.current_ic(linear_scores(spark, folder), "prediction", "fwd_ret")


@query("retrain_decision", "yr:i reasons retrain:b", uses="factors", sql=f"""{_DAILY}, {_DRIFT},
    m AS (SELECT yr, ic, base, (SELECT count(*) FILTER (shift > 2) FROM d) + (yr % 5) AS n_drifted, (yr - 1995) * 6 AS days_since, (yr - 1995) * 10 AS age FROM pairs),
    t AS (SELECT yr, days_since < 7 AS waits, concat_ws(',', CASE WHEN ic - base < -0.05 THEN 'ic' END, CASE WHEN n_drifted >= 3 THEN 'drift' END,
                 CASE WHEN age > 30 THEN 'age' END) AS why FROM m)
--
SELECT yr, CASE WHEN waits THEN 'interval' ELSE why END AS reasons, NOT waits AND why <> '' AS retrain FROM t""")
def retrain_decision(spark, folder):
    drifted = model.drift_triggered(drift_of(spark, folder)).select("n_drifted").scalar()
    monitor = yearly_ic(spark, folder).withColumnsRenamed({"ic": "current_ic", "base": "baseline_ic"}).withColumns({
        "n_drifted": drifted + F.col("yr") % 5, "days_since": (F.col("yr") - 1995) * 6, "model_age_days": (F.col("yr") - 1995) * 10})
    return model.retrain_decision(monitor)
