"""Cross-section functions: each date's rows against each other.

A date may hold a large part of all rows, so no function here gathers a date in one task:

* means, deviations and extremes come from a ``groupBy`` with map-side partial sums, joined back;
  the joined side has one row per date, and AQE broadcasts it when its measured size allows;
* ranks work on a date's distinct values with their counts, cut into slices that are ranked apart and shifted by
  the counts of the slices below. A slice is a function of the value alone (its binary order of magnitude and the
  leading part of its mantissa), so it needs no pass for cut points and is the same wherever it is
  computed. The answer is exact whatever the distribution; the slices only spread the work.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.session import materialize

from .core import finite, or_zero, ratio

PER_OCTAVE = 64
TIE_PREFIX = 6


def with_stats(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    """Add per-group aggregates to every row. Those of dates are as many as the calendar has days and are broadcast, so the rows stay where they are."""
    found = df.groupBy(*by).agg(*(c.alias(n) for n, c in aggs.items()))
    return df.join(F.broadcast(found) if by == ["trade_date"] else found, by, "left")


def slice_of(v: Column, per_octave: int = PER_OCTAVE) -> Column:
    """Number of a value's slice; never falls as the value grows.

    Rounding in the logarithm may move a power of two one exponent up or down; the mantissa part then
    overflows into the same slice number, so the order holds.
    """
    size = F.abs(v)
    exponent = F.floor(F.log2(size))
    part = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * per_octave)
    number = (exponent + 1100) * per_octave + part + 1
    return F.when(v == 0, F.lit(0)).otherwise((F.signum(v) * number).cast("long"))


def value_counts(df: DataFrame, by: list[str], *more: str) -> DataFrame:
    """(by…, _v, more…, _n): the distinct values of a column ``_v`` with their counts. Everything about ranks is derived from
    this table; copies of a value collapse map-side."""
    return df.groupBy(*by, "_v", *more).agg(F.count(F.lit(1)).alias("_n"))


def value_ranks(counts: DataFrame, by: list[str], per_octave: int = PER_OCTAVE) -> DataFrame:
    """(by…, _v, n_less, n_upto) of the distinct values of a table of ``value_counts``.

    Slices hold distinct values only, so neither equal values nor a date with most of the rows gather in one task.
    """
    cut = counts.where(F.col("_v").isNotNull()).groupBy(*by, "_v").agg(F.sum("_n").alias("_c")).withColumn("_slice", slice_of(F.col("_v"), per_octave))
    n = F.col("_n")
    below = F.coalesce(F.sum(n).over(Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = cut.groupBy(*by, "_slice").agg(F.sum("_c").alias("_n")).select(*by, "_slice", below.alias("_below"))
    inside = Window.partitionBy(*by, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_below") + F.sum("_c").over(inside)
    return cut.join(offsets, [*by, "_slice"]).select(*by, "_v", (upto - F.col("_c")).alias("n_less"), upto.alias("n_upto"))


def with_ranks(df: DataFrame, by: list[str], value: str, tie: str | None = None, per_octave: int = PER_OCTAVE) -> DataFrame:
    """Add ``n_less``, ``n_upto`` (values not above), ``n_total`` (values) and ``n_rows`` of the group.

    NaN and the infinities count as NULL. With ``tie`` also ``place``, the ordinal position with ties in that order
    and NULLs last; rows of one value are numbered in slices by the first characters of the tie key.
    """
    base = df.withColumn("_v", finite(F.col(value).cast("double")))
    keys = ["_v"]
    if tie is not None:
        base = base.withColumn("_t", F.substring(F.col(tie).cast("string"), 1, TIE_PREFIX))
        keys.append("_t")
    counts = value_counts(base, by, *keys[1:])
    if tie is not None:  # read four times; without ties the join deals the rows by the same keys as the counts, and Spark reuses that exchange
        counts = materialize(counts, "values")
    totals = counts.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))), F.lit(0)).alias("n_total"), F.sum("_n").alias("n_rows"))
    ranks = value_ranks(counts, by, per_octave)
    if tie is None:
        return base.join(ranks, [*by, "_v"], "left").join(totals, by).drop("_v")
    group = Window.partitionBy(*by, "_v").orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    looked = counts.withColumn("_before", F.coalesce(F.sum("_n").over(group), F.lit(0))).drop("_n").join(ranks, [*by, "_v"], "left").join(totals, by)
    looked = looked.withColumnsRenamed({c: f"_r{c}" for c in [*by, *keys]})
    same = F.col("_v").eqNullSafe(F.col("_r_v")) & F.col("_t").eqNullSafe(F.col("_r_t"))
    for c in by:
        same = same & (F.col(c) == F.col(f"_r{c}"))
    own = F.row_number().over(Window.partitionBy(*by, "_v", "_t").orderBy(tie))
    ranked = base.join(looked, same).withColumn("place", F.coalesce("n_less", "n_total") + F.col("_before") + own)
    return ranked.drop("_v", "_t", "_before", *[f"_r{c}" for c in [*by, *keys]])


def value_pairs(df: DataFrame, by: list[str], x: Column, y: Column) -> DataFrame:
    """(by…, _x, _y, _w): the distinct complete pairs of two values with their counts, written once. NaN and the infinities are missing."""
    rows = df.select(*by, finite(x.cast("double")).alias("_x"), finite(y.cast("double")).alias("_y")).where("_x is not null and _y is not null")
    return materialize(rows.groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("_w")), "pairs")


def pair_correlations(pairs: DataFrame, by: list[str], per_octave: int = PER_OCTAVE) -> DataFrame:
    """(by…, n, pearson, spearman) of a table of ``value_pairs``; NULL without variance.

    Ranks are looked up by value, so rows that share a pair are joined once. Values are taken from their mean before they are multiplied;
    the mean of average-tie ranks is known to be (n + 1) / 2.
    """
    w = F.col("_w")
    spread = F.max("_x") > F.min("_x"), F.max("_y") > F.min("_y")
    means = pairs.groupBy(*by).agg(F.sum(w).alias("n"), (F.sum(w * F.col("_x")) / F.sum(w)).alias("_mx"), (F.sum(w * F.col("_y")) / F.sum(w)).alias("_my"),
                                   (spread[0] & spread[1]).alias("_varies"))
    rows = pairs
    for side in ("_x", "_y"):
        ranks = value_ranks(pairs.select(*by, F.col(side).alias("_v"), w.alias("_n")), by, per_octave)
        rows = rows.join(ranks.select(*by, F.col("_v").alias(side), average_rank().alias(f"{side}r")), [*by, side])

    def corr(x: Column, y: Column) -> Column:
        return ratio(F.sum(w * x * y), F.sqrt(F.sum(w * x * x)) * F.sqrt(F.sum(w * y * y)))

    mid = (F.col("n") + 1) / 2
    return rows.join(means, by).groupBy(*by, "n", "_varies").agg(
        corr(F.col("_x") - F.col("_mx"), F.col("_y") - F.col("_my")).alias("_p"), corr(F.col("_xr") - mid, F.col("_yr") - mid).alias("spearman"),
    ).select(*by, "n", F.when(F.col("_varies"), F.col("_p")).alias("pearson"), "spearman")


_RANK_COLUMNS = ("n_less", "n_upto", "n_total", "n_rows")


def average_rank() -> Column:
    """Average-tie rank from the columns of ``with_ranks``."""
    return (F.col("n_less") + F.col("n_upto") + 1) / 2


def pct_rank(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Average-tie rank divided by the number of values; NULLs stay NULL and do not count."""
    ranked = with_ranks(df, by or ["trade_date"], value)
    return ranked.withColumn(out, average_rank() / F.col("n_total")).drop(*_RANK_COLUMNS)


def ordinal_rank(df: DataFrame, value: str, out: str, by: list[str] | None = None, tie: str = "ts_code") -> DataFrame:
    """Ordinal rank divided by the row count; ties by ``tie``, NULLs last and counted."""
    ranked = with_ranks(df, by or ["trade_date"], value, tie)
    return ranked.withColumn(out, F.col("place") / F.col("n_rows")).drop(*_RANK_COLUMNS, "place")


def zscore(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    x = with_stats(df, by or ["trade_date"], _m=F.avg(value), _s=F.stddev_samp(value))
    return x.withColumn(out, or_zero(ratio(F.col(value) - F.col("_m"), F.col("_s")))).drop("_m", "_s")


def scale(df: DataFrame, value: str, out: str, a: float = 1.0, b: float = 0.0, by: list[str] | None = None) -> DataFrame:
    x = with_stats(df, by or ["trade_date"], _lo=F.min(value), _hi=F.max(value))
    lo, hi = F.col("_lo"), F.col("_hi")
    mapped = F.when(hi == lo, F.lit(b + a / 2)).otherwise(a * ratio(F.col(value) - lo, hi - lo) + b)
    return x.withColumn(out, mapped).drop("_lo", "_hi")


def group_quantiles(df: DataFrame, by: list[str], value: str, points: dict[str, float], per_octave: int = PER_OCTAVE) -> DataFrame:
    """Linearly interpolated quantiles per group, named by ``points``, all read off one table of ranks instead of a per-group list."""
    counts = materialize(value_counts(df.select(*by, finite(F.col(value).cast("double")).alias("_v")), by), "values")
    totals = counts.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))), F.lit(0)).alias("n_total"))
    v = F.col("_v")
    covers = lambda i: (F.col("n_less") <= i) & (i < F.col("n_upto"))
    picked, values = [], []
    for k, (out, q) in enumerate(points.items()):
        at = (F.col("n_total").cast("double") - 1) * q
        lo = F.floor(at)
        picked += [F.max(F.when(covers(lo), v)).alias(f"_l{k}"), F.max(F.when(covers(lo + 1), v)).alias(f"_h{k}"), F.max(at - lo).alias(f"_f{k}")]
        low, high, part = (F.col(f"_{c}{k}") for c in "lhf")
        values.append((low + F.when(part > 0, part * (high - low)).otherwise(0.0)).alias(out))
    return value_ranks(counts, by, per_octave).join(totals, by).groupBy(*by).agg(*picked).select(*by, *values)


def group_quantile(df: DataFrame, by: list[str], value: str, q: float, out: str, per_octave: int = PER_OCTAVE) -> DataFrame:
    """One quantile per group, as ``group_quantiles`` finds it."""
    return group_quantiles(df, by, value, {out: q}, per_octave)


def demedian(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Distance from the cross-section median."""
    by = by or ["trade_date"]
    mid = group_quantile(df, by, value, 0.5, "_mid")
    return df.join(mid, by, "left").withColumn(out, F.col(value) - F.col("_mid")).drop("_mid")


#: A section with more rows is ranked by slices of distinct values, not in one task.
HOT_ROWS = 1_000_000


def rank_sum(df: DataFrame, signs: dict[str, float], out: str, by: str = "trade_date", key: str = "ts_code", hot_rows: int = HOT_ROWS) -> DataFrame:
    """(by, key, out): signed sum of the percentile ranks of several columns, NULL if one is NULL.

    The columns are written once. Sections of up to ``hot_rows`` rows are dealt once and ranked by windows, all columns behind the same exchange; the columns of
    larger ones become rows and are ranked together by slices of their distinct values.
    """
    df = materialize(df.select(by, key, *(finite(F.col(n).cast("double")).alias(n) for n in signs)), "signals")
    hot = [r[0] for r in df.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).collect()]
    is_hot = F.coalesce(F.col(by).isin([d for d in hot if d is not None]), F.lit(None in hot))
    ranks = []
    for n in signs:
        order = Window.partitionBy(by).orderBy(F.col(n).asc_nulls_last())
        known = F.count(n).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        ranks.append(F.when(F.col(n).isNotNull(), (F.rank().over(order) + F.count(n).over(order)) / 2 / known))
    total = reduce(Column.__add__, [F.lit(float(w)) * r for w, r in zip(signs.values(), ranks)])
    n_parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # AQE would merge sections by compressed bytes, and they are sorted once a column
    small = df.where(~is_hot).repartition(n_parts, by).select(by, key, total.alias(out))
    return small.unionByName(_rank_sum_by_slices(df.where(is_hot), signs, out, by, key)) if hot else small


def _rank_sum_by_slices(df: DataFrame, signs: dict[str, float], out: str, by: str, key: str) -> DataFrame:
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("_name"), F.col(n).alias("_v"), F.lit(float(w)).alias("_w")) for n, w in signs.items())))
    long = df.select(by, key, cells.alias("_c")).select(by, key, "_c.*")
    ranked = pct_rank(long, "_v", "_r", [by, "_name"])
    return ranked.groupBy(by, key).agg(
        F.when(F.count("_r") == len(signs), F.sum(F.col("_w") * F.col("_r"))).alias(out))
