"""Model data: folds and splits, walk-forward boosted trees, scoring, drift and retrain decisions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.core import finite, or_zero, ratio
from barloom.functions.section import pair_correlations
from barloom.operators import boosting
from barloom.operators.evaluate import daily_ic
from barloom.operators.factor import FINE
from barloom.operators.panel import calendar
from barloom.session import materialize

# Columns that are never features, and the thresholds of monitoring.
NOT_FEATURES = {"ts_code", "trade_date", "industry", "circ_mv", "log_mv", "fwd_ret_5d"}
MIN_TRAIN, MIN_VALIDATE, MIN_CV_VALIDATE = 100, 10, 50
DRIFT_SIGMAS, DRIFT_COLUMNS = 2.0, 3
IC_MONITOR, IC_RETRAIN = -0.3, -0.05
RECENT_DATES, RECENT_ROWS = 30, 100
RETRAIN_INTERVAL_DAYS, MODEL_MAX_AGE_DAYS = 7, 30
BLEND_WEIGHTS = (0.7, 0.3)
_ROW_KEY = ["trade_date", "ts_code"]


def feature_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in NOT_FEATURES]


def numbered_dates(df: DataFrame) -> DataFrame:
    """(trade_date, day_no, n_rows, rows_upto): one row per date with running row counts."""
    per_day = df.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n_rows"))
    order = Window.partitionBy(F.lit(0)).orderBy("trade_date")
    return per_day.withColumns({
        "day_no": F.row_number().over(order) - 1,
        "rows_upto": F.sum("n_rows").over(order.rowsBetween(Window.unboundedPreceding, 0))})


@dataclass(frozen=True)
class WalkForward:
    """Expanding training window: first train end, step and validation length.

    ``step_days`` and ``min_train_days`` count trading dates; purge and validation are calendar days.
    With ``tile`` a fold validates until the next one starts, the last fold until the last date, and ``val_days``
    has no effect: every date after the first purge belongs to exactly one fold, whatever the calendar's gaps.
    """

    min_train_days: int = 252
    step_days: int = 60
    purge_days: int = 5
    val_days: int = 60
    tile: bool = False


def fold_table(df: DataFrame, plan: WalkForward = WalkForward()) -> DataFrame:
    """(fold, train_end, val_after, val_until, n_train, n_val): training takes dates up to train_end,
    validation the dates after val_after up to val_until. Counts come from per-date counts; the rows
    themselves are never multiplied by folds."""
    days = numbered_dates(df)
    n_dates = df.agg(F.count_distinct("trade_date")).scalar()
    since = F.col("day_no") - plan.min_train_days
    start = F.date_add("trade_date", plan.purge_days)
    started = days.where((since >= 0) & (since % plan.step_days == 0))
    if plan.tile:
        last = days.agg(F.max("trade_date")).scalar()
        until = F.coalesce(F.lead(start).over(Window.partitionBy(F.lit(0)).orderBy("trade_date")), last)
        started = started.withColumn("_until", until).where(start < F.col("_until"))
    else:
        started = started.where(F.col("day_no") < n_dates - plan.val_days).withColumn("_until", F.date_add(start, plan.val_days))
    folds = started.select(
        (since / plan.step_days).cast("int").alias("fold"), F.col("trade_date").alias("train_end"), start.alias("val_after"),
        F.col("_until").alias("val_until"), F.col("rows_upto").alias("n_train"))
    held = validation_dates(folds).join(days.select("trade_date", "n_rows"), "trade_date").groupBy("fold").agg(F.sum("n_rows").alias("n_val"))
    return folds.join(held, "fold", "left").fillna(0, subset=["n_val"])


def validation_dates(folds: DataFrame) -> DataFrame:
    """(fold, trade_date) for every calendar day a fold validates on: an equality key for the rows."""
    return folds.select("fold", F.explode(F.sequence(F.date_add("val_after", 1), F.col("val_until"))).alias("trade_date"))


def validation_rows(df: DataFrame, folds: DataFrame) -> DataFrame:
    """Rows with the fold that validates on them."""
    return df.join(validation_dates(folds), "trade_date")


def row_numbers(df: DataFrame, order: str, out: str) -> DataFrame:
    """Add ``out``: 1, 2, 3 … in the order of one column over the whole table, which no task ever holds.

    The rows are dealt by ranges of (column, row id) and written once; each range is numbered by itself and starts after
    the counts of the ranges below. Equal values, however many, are told apart by the row id and spread as well.
    """
    stored = materialize(df.withColumn("_id", F.monotonically_increasing_id()), "rows")
    ranged = materialize(stored.repartitionByRange(order, "_id").withColumn("_range", F.spark_partition_id()), "ranges")
    below = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select("_range", below.alias("_start"))  # one row per range
    place = F.col("_start") + F.row_number().over(Window.partitionBy("_range").orderBy(order, "_id"))
    return ranged.join(starts, "_range").withColumn(out, place).drop("_range", "_id", "_start")


def chrono_split(df: DataFrame, share: float = 0.8, tie: str = "ts_code") -> DataFrame:
    """Add ``part``: the first share of the rows by date is ``train``, the rest ``eval``.

    Running counts per date place every row but those of the one date the cut falls into; only these
    are numbered, in ranges, so that the date may hold most of the rows.
    """
    cut = F.floor(F.max("rows_upto").over(Window.partitionBy(F.lit(0))) * share)
    days = numbered_dates(df).select("trade_date", (F.col("rows_upto") - F.col("n_rows")).alias("_before"), "rows_upto", cut.alias("_cut"))
    rows = df.join(days, "trade_date")
    split_day = (F.col("_before") < F.col("_cut")) & (F.col("rows_upto") > F.col("_cut"))
    whole = rows.where(~split_day).withColumn("part", F.when(F.col("rows_upto") <= F.col("_cut"), F.lit("train")).otherwise(F.lit("eval")))
    place = F.col("_before") + F.col("_place")
    split = row_numbers(rows.where(split_day), tie, "_place").withColumn("part", F.when(place <= F.col("_cut"), F.lit("train")).otherwise(F.lit("eval"))).drop("_place")
    return whole.unionByName(split).drop("_before", "rows_upto", "_cut")


def purged_cv_splits(df: DataFrame, n_splits: int = 3, horizon: int = 5) -> DataFrame:
    """(split, train_before, val_from, val_until): training stops ``horizon`` dates ahead of the
    validation block [val_from, val_until)."""
    days = calendar(df)
    plan = days.agg(F.count(F.lit(1)).alias("_n")).select(
        "_n", F.floor(F.col("_n") / (n_splits + 1)).alias("_size"), F.explode(F.sequence(F.lit(1), F.lit(n_splits))).alias("split"))
    at = F.col("split") * F.col("_size")
    plan = plan.withColumns({"_from": at, "_before": F.when(at > horizon, at - horizon).otherwise(at),
                             "_until": F.least((F.col("split") + 1) * F.col("_size"), F.col("_n") - 1)})
    for name, out in (("_before", "train_before"), ("_from", "val_from"), ("_until", "val_until")):
        plan = plan.join(days.select(F.col("day_no").alias(name), F.col("trade_date").alias(out)), name)
    return plan.select("split", "train_before", "val_from", "val_until")


def split_counts(df: DataFrame, splits: DataFrame) -> DataFrame:
    """Splits with their training and validation row counts, read off running counts per date."""
    days = numbered_dates(df).select("trade_date", (F.col("rows_upto") - F.col("n_rows")).alias("_below"))
    out = splits
    for name in ("train_before", "val_from", "val_until"):
        out = out.join(days.select(F.col("trade_date").alias(name), F.col("_below").alias(f"_{name}")), name)
    return out.withColumns({"n_train": F.col("_train_before"), "n_val": F.col("_val_until") - F.col("_val_from")}).drop(
        "_train_before", "_val_from", "_val_until")


def date_ratio_split(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Add ``part``: the first share of the distinct dates is ``train``."""
    n = df.agg(F.count_distinct("trade_date")).scalar()
    days = calendar(df).withColumn("part", F.when(F.col("day_no") < F.floor(n * share), F.lit("train")).otherwise(F.lit("test")))
    return df.join(days.select("trade_date", "part"), "trade_date")


def recent_dates(df: DataFrame, n: int = RECENT_DATES) -> DataFrame:
    """The last n distinct dates."""
    return df.select("trade_date").distinct().orderBy(F.col("trade_date").desc()).limit(n)


# -- boosted trees --------------------------------------------------------------------------------


def train_trees(train: DataFrame, features: list[str], label: str, **tree_args) -> boosting.Trees:
    """One model of all complete rows; the last fifth by date picks the best round. The rows are read several times."""
    return boosting.fit_upto(train, {0: None}, features, label, _ROW_KEY, **tree_args)


def walk_forward(df: DataFrame, features: list[str], label: str, plan: WalkForward = WalkForward(), **tree_args) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions and feature importances of one model per fold.

    All folds are fitted together, each on all of its training rows (``boosting.fit_upto``); all rows are scored where they lie: the folds'
    days, one row per calendar day, are broadcast. The usable rows are written once to the shared folder, so that no job computes the factors
    again; each file is in date order, so that a batch of rows meets few models. A fold with too little data keeps its rows with a NULL
    prediction, its importances are NULL, and ``status`` says which part was too small. Without any fold both tables are empty.
    """
    spark = df.sparkSession
    usable = materialize(df.dropna(subset=[*features, label]).select(*_ROW_KEY, *features, label).sortWithinPartitions("trade_date"), "training")
    status = F.when(F.col("n_train") < MIN_TRAIN, "few training rows").when(F.col("n_val") < MIN_VALIDATE, "few validation rows").otherwise("ok")
    folds = fold_table(usable, plan).withColumn("status", status).orderBy("fold").collect()  # one row per fold
    fitted = {f["fold"]: f["train_end"] for f in folds if f["status"] == "ok"}
    trees = boosting.fit_upto(usable, fitted, features, label, _ROW_KEY, **tree_args) if fitted else boosting.Trees(features, {}, 0)
    states = spark.createDataFrame([tuple(f) for f in folds], "fold int, train_end date, val_after date, val_until date, n_train long, n_val long, status string")
    days = validation_dates(states).join(F.broadcast(states.select("fold", "status")), "fold")
    predictions = usable.join(F.broadcast(days), "trade_date").select(
        "trade_date", "ts_code", "fold", label, trees.predict(usable, F.col("fold")).alias("prediction"), "status")
    shares = trees.importances()
    gains = [(f["fold"], n, g, f["status"]) for f in folds for n, g in zip(features, shares.get(f["fold"], [None] * len(features)))]
    return predictions, spark.createDataFrame(gains, "fold int, feature string, gain double, status string")


def mean_importance(importances: DataFrame) -> DataFrame:
    """(feature, gain): mean over folds, most important first."""
    return importances.groupBy("feature").agg(F.avg("gain").alias("gain")).orderBy(F.col("gain").desc(), "feature")


def oof_metrics(predictions: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """One row: folds, rows, error, correlations and hit rate of out-of-fold predictions.

    The rows are counted by (fold, prediction, label) and written once; all figures come from these counts.
    """
    rows = predictions.select("fold", F.col(prediction).alias("_p"), F.col(label).alias("_y")).dropna()
    stored = materialize(rows.groupBy("fold", "_p", "_y").agg(F.count(F.lit(1)).alias("_n")), "scored")
    n, error = F.col("_n"), F.col("_p") - F.col("_y")
    plain = stored.agg(
        F.count_distinct("fold").alias("n_folds"), F.coalesce(F.sum(n), F.lit(0)).alias("n"), F.sqrt(ratio(F.sum(n * error * error), F.sum(n))).alias("rmse"),
        ratio(F.sum(F.when(F.signum("_p") == F.signum("_y"), n).otherwise(0)), F.sum(n)).alias("hit_rate")).withColumn("_all", F.lit(1))
    counted = stored.where(finite(F.col("_p")).isNotNull() & finite(F.col("_y")).isNotNull()).groupBy(
        F.lit(1).alias("_all"), F.col("_p").cast("double").alias("_x"), F.col("_y").cast("double").alias("_y")).agg(F.sum("_n").alias("_w"))
    found = pair_correlations(counted, ["_all"], FINE).select("_all", F.col("pearson").alias("ic"), F.col("spearman").alias("rank_ic"))
    return plain.join(found, "_all", "left").select("n_folds", "n", "rmse", "ic", "rank_ic", "hit_rate")


def blend(first: DataFrame, second: DataFrame, weights: tuple[float, float] = BLEND_WEIGHTS) -> DataFrame:
    """Weighted mean of two prediction tables; where one has no prediction the other counts alone."""
    keys = ["trade_date", "ts_code"]
    both = first.select(*keys, F.col("prediction").alias("_a")).join(second.select(*keys, F.col("prediction").alias("_b")), keys, "full")
    wa, wb = (F.when(F.col(c).isNotNull(), F.lit(w)).otherwise(0.0) for c, w in zip(("_a", "_b"), weights))
    return both.withColumn("prediction", ratio(or_zero(F.col("_a")) * wa + or_zero(F.col("_b")) * wb, wa + wb)).drop("_a", "_b")


def score_factors(trees: boosting.Trees, df: DataFrame, features: list[str]) -> DataFrame:
    """(ts_code, trade_date, predict_score); missing features count as 0."""
    rows = df.fillna(0.0, subset=features)
    return rows.select("ts_code", "trade_date", trees.predict(rows, F.lit(0)).alias("predict_score"))


def cv_split_scores(scored: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """(split, n_train, n_val, rmse, ic, status) of every split; figures are NULL where it has too few rows.

    ``scored`` holds validation rows with ``split`` and the split's ``n_train``.
    """
    sizes = scored.groupBy("split").agg(
        F.max("n_train").alias("n_train"), F.count(F.lit(1)).alias("n_val"),
        F.sqrt(F.avg((F.col(prediction) - F.col(label)) ** 2)).alias("rmse"))
    keyed = scored.withColumn("_k", F.struct("split", "trade_date"))
    ics = daily_ic(keyed, prediction, label, by="_k").groupBy(F.col("_k.split").alias("split")).agg(F.avg("ic").alias("ic"))
    status = F.when(F.col("n_train") < MIN_TRAIN, "few training rows").when(F.col("n_val") < MIN_CV_VALIDATE, "few validation rows").otherwise("ok")
    ok = F.col("status") == "ok"
    return sizes.join(ics, "split", "left").withColumn("status", status).select(
        "split", "n_train", "n_val", F.when(ok, F.col("rmse")).alias("rmse"), F.when(ok, F.col("ic")).alias("ic"), "status")


def cv_objective(scored: DataFrame, label: str, prediction: str = "prediction") -> DataFrame:
    """One row: mean daily IC times 100 minus mean error times 10 over splits with enough rows; ``cv_split_scores`` has the others too."""
    good = cv_split_scores(scored, label, prediction).where("status = 'ok'")
    return good.agg(F.count(F.lit(1)).alias("n_splits"), F.avg("ic").alias("mean_ic"), F.avg("rmse").alias("mean_rmse")).withColumn(
        "score", F.when(F.col("n_splits") > 0, F.col("mean_ic") * 100 - F.col("mean_rmse") * 10).otherwise(-999.0))


# -- monitoring -----------------------------------------------------------------------------------


def describe(df: DataFrame, features: list[str]) -> DataFrame:
    """(factor, mean, std) in one pass over the rows."""
    aggs = [a for i, f in enumerate(features) for a in (F.avg(f).alias(f"m{i}"), F.stddev_samp(f).alias(f"s{i}"))]
    cells = [F.struct(F.lit(f).alias("factor"), F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std")) for i, f in enumerate(features)]
    return df.agg(*aggs).select(F.explode(F.array(*cells)).alias("_c")).select("_c.*")


def feature_drift(baseline: DataFrame, current: DataFrame, features: list[str]) -> DataFrame:
    """(factor, shift, drifted): mean shift in baseline deviations, and whether it exceeds two."""
    now = describe(current, features).select("factor", F.col("mean").alias("_now"))
    shift = ratio(F.abs(F.col("_now") - F.col("mean")), F.when(F.col("std") > 0, F.col("std")))
    return describe(baseline, features).join(now, "factor").select(
        "factor", shift.alias("shift"), F.coalesce(shift > DRIFT_SIGMAS, F.lit(False)).alias("drifted"))


def drift_triggered(drift: DataFrame) -> DataFrame:
    """One row: number of drifted features and whether they call for retraining."""
    return drift.agg(F.count_if("drifted").alias("n_drifted")).withColumn("triggered", F.col("n_drifted") >= DRIFT_COLUMNS)


def ic_degraded(current: Column, baseline: Column, threshold: float = IC_MONITOR) -> Column:
    return F.coalesce(current - baseline < threshold, F.lit(False))


def current_ic(df: DataFrame, prediction: str, label: str, n_dates: int = RECENT_DATES, min_rows: int = RECENT_ROWS) -> DataFrame:
    """One row: mean daily IC over the last dates, NULL when they hold too few rows."""
    known = df.where(F.col(label).isNotNull())
    recent = known.join(recent_dates(known, n_dates), "trade_date")
    n = recent.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n_rows"))
    return daily_ic(recent, prediction, label).join(n, "trade_date").agg(
        F.sum("n_rows").alias("n_rows"), F.avg("ic").alias("_ic")).select(
        "n_rows", F.when(F.col("n_rows") >= min_rows, F.col("_ic")).alias("current_ic"))


def retrain_decision(monitor: DataFrame) -> DataFrame:
    """Add ``reasons`` and ``retrain`` to monitoring rows (days_since, current_ic, baseline_ic,
    n_drifted, model_age_days)."""
    reasons = F.concat_ws(
        ",", F.when(ic_degraded(F.col("current_ic"), F.col("baseline_ic"), IC_RETRAIN), F.lit("ic")),
        F.when(F.col("n_drifted") >= DRIFT_COLUMNS, F.lit("drift")),
        F.when(F.col("model_age_days") > MODEL_MAX_AGE_DAYS, F.lit("age")))
    waits = F.coalesce(F.col("days_since") < RETRAIN_INTERVAL_DAYS, F.lit(False))
    return monitor.withColumn("reasons", F.when(waits, F.lit("interval")).otherwise(reasons)).withColumn(
        "retrain", ~waits & (F.col("reasons") != ""))
