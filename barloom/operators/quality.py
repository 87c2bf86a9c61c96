"""Data-quality checks. Each answers with one row, or one row per security."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.core import ratio

# The columns a bar table must have and the limits of a plausible one.
REQUIRED = ("open", "high", "low", "close", "vol")
MAX_MISSING = 0.1
PRICE_RANGE = (0.01, 10000.0)


class QualityError(ValueError):
    """A loaded table failed its checks."""


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in REQUIRED if c not in df.columns]


def columns_check(df: DataFrame) -> DataFrame:
    """One row: are there rows with all required columns (a schema check and a count without columns)."""
    absent = missing_columns(df)
    return df.agg((F.lit(not absent) & (F.count(F.lit(1)) > 0)).alias("ok")).withColumn("absent", F.lit(",".join(absent)))


def _missing(c: str) -> Column:
    return F.avg(F.col(c).isNull().cast("double"))


def missing_ratio(df: DataFrame, columns: tuple[str, ...] = REQUIRED) -> DataFrame:
    """Largest share of NULLs over the columns; an empty table fails."""
    worst = reduce(F.greatest, [_missing(c) for c in columns]) if len(columns) > 1 else _missing(columns[0])
    return df.agg(worst.alias("missing_ratio"), F.count(F.lit(1)).alias("n")).withColumn(
        "ok", F.coalesce(F.col("missing_ratio") <= MAX_MISSING, F.lit(False)) & (F.col("n") > 0))


def price_range(df: DataFrame, low: float = PRICE_RANGE[0], high: float = PRICE_RANGE[1]) -> DataFrame:
    """Counts of prices outside the plausible range, per column, and the verdict."""
    cols = ("open", "high", "low", "close")
    counts = [F.count_if(F.col(c) < low).alias(f"{c}_low") for c in cols]
    counts += [F.count_if(F.col(c) > high).alias(f"{c}_high") for c in cols]
    total = reduce(lambda a, b: a + b, [F.col(f"{c}_{s}") for c in cols for s in ("low", "high")])
    return df.agg(*counts).withColumn("ok", total == 0)


def date_sorted(df: DataFrame, key: str, value: str, seq: str, block: int = 100_000) -> DataFrame:
    """Per key: does ``value`` never fall when rows are read in ``seq`` order?

    Spark rows have no order of their own, hence the explicit sequence. A key may own a large part
    of all rows, so its rows are checked in blocks of the sequence, and the blocks against each
    other by their extremes.
    """
    blocked = df.withColumn("_block", F.floor(F.col(seq) / block))
    inside = Window.partitionBy(key, "_block").orderBy(seq)
    fell = F.lag(value).over(inside) > F.col(value)
    per_block = blocked.withColumn("_fell", F.coalesce(fell, F.lit(False))).groupBy(key, "_block").agg(
        F.max("_fell").alias("_fell"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    crossed = F.coalesce(F.max("_hi").over(before) > F.col("_lo"), F.lit(False))
    return per_block.withColumn("_bad", F.col("_fell") | crossed).groupBy(key).agg((~F.max("_bad")).alias("is_sorted"))


def report(df: DataFrame) -> DataFrame:
    """One row with every check, the overall verdict and a text of warnings."""
    absent = missing_columns(df)
    have = [c for c in REQUIRED if c not in absent]
    cols = [c for c in have if c != "vol"]
    outside = [F.count_if((F.col(c) < PRICE_RANGE[0]) | (F.col(c) > PRICE_RANGE[1])) for c in cols]
    worst = [_missing(c) for c in have]
    row = df.agg(
        F.count(F.lit(1)).alias("n"),
        (reduce(F.greatest, worst) if len(worst) > 1 else worst[0]).alias("missing_ratio"),
        reduce(lambda a, b: a + b, outside).alias("n_outside"),
    )
    checks = {
        "columns_ok": F.lit(not absent),
        "missing_ok": F.coalesce(F.col("missing_ratio") <= MAX_MISSING, F.lit(False)),
        "price_ok": F.col("n_outside") == 0,
    }
    warn = [F.when(~c, F.lit(name.replace("_ok", ""))) for name, c in checks.items()]
    passed = reduce(lambda a, b: a & b, checks.values())
    return row.select("n", "missing_ratio", "n_outside", *(c.alias(n) for n, c in checks.items()),
                      passed.alias("passed"), F.concat_ws(",", *warn).alias("warnings"))


def require_quality(df: DataFrame) -> DataFrame:
    """The table itself, or an error when its report does not pass (reads one row)."""
    verdict = report(df).first()
    if not verdict["passed"]:
        raise QualityError(f"failed checks: {verdict['warnings']}")
    return df


def diagnose(panel: DataFrame) -> DataFrame:
    """One row: sizes, date range, missing share of the grid, NULLs, securities per day."""
    per_day = panel.groupBy("trade_date").agg(F.count("close").alias("n_day"), F.count_if(F.col("close").isNull()).alias("n_null"))
    days = per_day.agg(
        F.count(F.lit(1)).alias("n_dates"), F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"),
        F.sum("n_day").alias("n_values"), F.sum("n_null").alias("n_null"), F.avg("n_day").alias("day_mean"),
        F.min("n_day").alias("day_min"), F.max("n_day").alias("day_max"))
    n_stocks = panel.agg(F.count_distinct("ts_code")).scalar()
    return days.withColumn("n_stocks", n_stocks).withColumn(
        "missing_ratio", 1 - ratio(F.col("n_values"), F.col("n_dates") * F.col("n_stocks")))


def date_gaps(panel: DataFrame) -> DataFrame:
    """Largest and mean number of calendar days between trading dates."""
    in_order = Window.partitionBy(F.lit(0)).orderBy("trade_date")
    gaps = panel.select("trade_date").distinct().select(
        F.datediff("trade_date", F.lag("trade_date").over(in_order)).alias("gap_days"))
    return gaps.agg(F.max("gap_days").alias("max_gap"), F.avg("gap_days").alias("mean_gap"))
