"""Neutralising factors and choosing among them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.core import or_zero, pairs, pearson, ratio
from barloom.functions.section import average_rank, pair_correlations, value_pairs, with_ranks

# Thresholds of the neutralisation and selection rules.
HUGE = 1e15
MIN_ROWS = 3
MIN_PERIODS = 20
MIN_ABS_IC = 0.02
MAX_CORR = 0.70
MAX_MEAN_CORR = 0.50
EPS = 1e-10
NO_INDUSTRY = "nan"
FINE = 4096  # slices per octave where one group holds the whole table


def neutralize(df: DataFrame, factor: str, out: str, industry: str | None = None, cap: str | None = None,
               intercept: bool = False, by: str = "trade_date") -> DataFrame:
    """Residual of the factor on industry dummies and/or log market cap, section by section.

    The default design has no intercept and no dummy for the first industry of a section, so that
    industry is not demeaned; ``intercept=True`` demeans all. By Frisch-Waugh the residual needs only
    group means and, for the size slope, centred cross products per (date, industry). These are
    partial aggregates of a few numbers per group; the panel itself is only joined to them, never
    gathered by date. A section that is too small keeps its raw values; unusable rows become NULL.
    """
    if industry is None and cap is None:
        return df.withColumn(out, F.col(factor))
    y = F.col(factor)
    x = F.log(F.when(F.col(cap) > 0, F.col(cap))) if cap else F.lit(0.0)
    usable = y.isNotNull() & x.isNotNull() & (F.abs(x) < HUGE)
    group = F.coalesce(F.col(industry), F.lit(NO_INDUSTRY)) if industry else F.lit("")
    rows = df.withColumns({"_y": F.when(usable, y), "_x": F.when(usable, x), "_g": group})

    n, yy, xx = F.count("_y"), F.col("_y"), F.col("_x")
    groups = rows.groupBy(by, "_g").agg(
        n.alias("_n"), F.avg(yy).alias("_my"), F.avg(xx).alias("_mx"),
        or_zero(F.covar_pop(yy, xx) * n).alias("_cyx"), or_zero(F.var_pop(xx) * n).alias("_cxx"),
        or_zero(F.sum(yy * xx)).alias("_ryx"), or_zero(F.sum(xx * xx)).alias("_rxx"))
    # one row per (date, industry): small, so the per-date totals may use a window
    section = Window.partitionBy(by)
    plain = (F.col("_g") == F.min("_g").over(section)) & F.lit(not (intercept and industry is not None))
    groups = groups.withColumn("_plain", plain)
    pick = lambda raw, centred: F.sum(F.when(F.col("_plain"), F.col(raw)).otherwise(F.col(centred))).over(section)
    n_cols = (F.count(F.lit(1)).over(section) - 1 if industry else F.lit(0)) + (1 if cap else 0)
    total = F.sum("_n").over(section)
    groups = groups.select(
        by, "_g", "_plain", "_my", "_mx", or_zero(ratio(pick("_ryx", "_cyx"), pick("_rxx", "_cxx"))).alias("_slope"),
        ((total >= MIN_ROWS) & (total >= n_cols + 1)).alias("_fit"))

    centre = lambda v, m: v - F.when(F.col("_plain"), F.lit(0.0)).otherwise(or_zero(F.col(m)))
    resid = centre(yy, "_my") - (F.col("_slope") * centre(xx, "_mx") if cap else F.lit(0.0))
    return rows.join(groups, [by, "_g"]).withColumn(out, F.when(F.col("_fit"), resid).otherwise(y)).drop(
        "_y", "_x", "_g", "_plain", "_my", "_mx", "_slope", "_fit")


def neutralize_aligned(df: DataFrame, factor: str, out: str, industry: DataFrame | None = None,
                       cap: DataFrame | None = None) -> DataFrame:
    """Join the industry map and the market caps to a factor table first; rows missing in either go."""
    keys = ["trade_date", "ts_code"]
    if industry is not None:
        df = df.join(industry.select("ts_code", "industry").dropna(), "ts_code")
    if cap is not None:
        df = df.join(cap.select(*keys, "market_cap").dropna(), keys)
    return neutralize(df, factor, out, "industry" if industry is not None else None, "market_cap" if cap is not None else None)


def _rows(df_one: DataFrame, cells: list[tuple[dict[str, str], str]], names: list[str]) -> DataFrame:
    """One-row aggregate to one row per cell: constant labels plus the named value columns."""
    structs = [F.struct(*(F.lit(v).alias(k) for k, v in labels.items()), *(F.col(f"{p}_{n}").alias(n) for n in names))
               for labels, p in cells]
    return df_one.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*")


def ic_table(df: DataFrame, factors: list[str], ret: str) -> DataFrame:
    """(factor, ic, n): full-sample correlation of each factor with the forward return, in one pass."""
    aggs = [a for i, f in enumerate(factors) for a in (pearson(f, ret).alias(f"c{i}_ic"), pairs(f, ret).alias(f"c{i}_n"))]
    return _rows(df.agg(*aggs), [({"factor": f}, f"c{i}") for i, f in enumerate(factors)], ["ic", "n"])


def filter_by_ic(df: DataFrame, factors: list[str], ret: str, min_abs_ic: float = MIN_ABS_IC,
                 min_periods: int = MIN_PERIODS) -> DataFrame:
    """Factors with enough pairs and a strong enough IC, strongest first."""
    ic = ic_table(df, factors, ret).where((F.col("n") >= min_periods) & F.col("ic").isNotNull())
    strong = ic.where(F.abs("ic") >= min_abs_ic)
    return strong.withColumn("ic", F.round("ic", 6)).orderBy(F.abs("ic").desc(), "factor")


_PART = "left string, right string, n double, mx double, my double, xx double, yy double, xy double, odd double"


def _merged(one: tuple, two: tuple) -> tuple:
    """Counts, means, centred squares and products, and odd pairs of two sets of rows, each [i, j] over the rows that have both i and j."""
    n1, m1, q1, p1, o1 = one
    n2, m2, q2, p2, o2 = two
    n, off = n1 + n2, m2 - m1
    share = n2 / np.maximum(n, 1)
    return n, m1 + off * share, q1 + q2 + off * off * n1 * share, p1 + p2 + off * off.T * n1 * share, o1 + o2


def _batch_moments(batch: pa.RecordBatch) -> tuple:
    x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
    there = np.stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns])
    usable = np.isfinite(x)
    odd, known = (there & ~usable).astype(float), there.astype(float)
    centre = np.zeros((len(x), 1))
    for i, u in enumerate(usable):
        v = x[i, u]
        if v.size:
            centre[i] = np.partition(v, v.size // 2)[v.size // 2]
    # a value that occurs, near the middle: constants become exactly 0, and single huge values do not spoil the others' digits
    d, m = np.where(usable, x, centre) - centre, usable.astype(float)
    n, s = m @ m.T, d @ m.T
    mean = s / np.maximum(n, 1)
    odds = odd @ known.T
    return n, np.where(n > 0, centre + mean, 0.0), (d * d) @ m.T - s * mean, d @ d.T - s * mean.T, odds + odds.T


def pair_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(left, right, n, xx, yy, xy, odd) for every two columns and for every column with itself, over the rows that have both: their number, sums of
    squares and products about the means, and the number of rows (not in ``n``) where a value is NaN or infinite.

    A task adds its rows up by a few matrix products per Arrow batch and sends one row per pair. As one aggregate per figure the pairs make a
    buffer of hundreds of numbers, and its update for every row took most of a selection's time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = _batch_moments(batch)
                total = part if total is None else _merged(total, part)
        if total is not None:
            n, mean, squares, products, odd = total
            at = [(i, j) for i in range(len(columns)) for j in range(i, len(columns)) if n[i, j] + odd[i, j] > 0]
            rows = [(columns[i], columns[j], n[i, j], mean[i, j], mean[j, i], squares[i, j], squares[j, i], products[i, j], odd[i, j]) for i, j in at]
            names = ["left", "right", "n", "mx", "my", "xx", "yy", "xy", "odd"]
            yield pa.RecordBatch.from_pylist([dict(zip(names, map(lambda v: v if isinstance(v, str) else float(v), r))) for r in rows], schema=pa.schema(
                [(c, pa.string() if c in ("left", "right") else pa.float64()) for c in names]))

    parts = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]).mapInArrow(run, _PART)
    pair = Window.partitionBy("left", "right")  # one row per task
    for c in ("mx", "my"):
        base = F.min(F.when(F.col("n") > 0, F.col(c))).over(pair)
        parts = parts.withColumn(f"_{c}", F.col(c) - base - ratio(F.sum(F.col("n") * (F.col(c) - base)).over(pair), F.sum("n").over(pair)))
    off_x, off_y, n = or_zero(F.col("_mx")), or_zero(F.col("_my")), F.col("n")
    return parts.groupBy("left", "right").agg(
        F.sum("n").cast("long").alias("n"), F.sum(F.col("xx") + n * off_x * off_x).alias("xx"), F.sum(F.col("yy") + n * off_y * off_y).alias("yy"),
        F.sum(F.col("xy") + n * off_x * off_y).alias("xy"), F.sum("odd").cast("long").alias("odd"))


def _correlation() -> Column:
    """Of a row of ``pair_moments``: NULL without variance, NaN if a value is NaN or infinite."""
    return F.when(F.col("odd") > 0, F.lit(float("nan"))).otherwise(ratio(F.col("xy"), F.sqrt("xx") * F.sqrt("yy")))


def corr_matrix(df: DataFrame, factors: list[str], method: str = "pearson") -> DataFrame:
    """(left, right, corr) for every pair of factors, over the rows that have both.

    Pearson takes one pass for all pairs (``pair_moments``). For Spearman the complete rows of all pairs become rows of one table of distinct values with
    counts, so that two rankings (one for each side) serve all of them.
    """
    both = list(combinations(factors, 2))
    pair = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right")) for a, b in both]
    if not pair:
        return df.sparkSession.createDataFrame([], "left string, right string, corr double")
    names = df.sparkSession.range(1).select(F.inline(F.array(*pair)))  # a pair without complete rows has a NULL
    if method == "pearson":
        return names.join(pair_moments(df, factors).select("left", "right", _correlation().alias("corr")), ["left", "right"], "left")
    cells = F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")) for a, b in both))
    counted = value_pairs(df.select(F.inline(cells)), ["left", "right"], F.col("_a"), F.col("_b"))
    found = pair_correlations(counted, ["left", "right"], FINE).select("left", "right", F.col("spearman").alias("corr"))
    return names.join(found, ["left", "right"], "left")


def overall_rank(df: DataFrame, value: str, out: str, per_octave: int = FINE) -> DataFrame:
    """Average-tie rank over the whole table; needs a constant ``_all`` column. Finer slices than for a
    date, because there is only one group."""
    ranked = with_ranks(df, ["_all"], value, per_octave=per_octave)
    return ranked.withColumn(out, average_rank()).drop("n_less", "n_upto", "n_total", "n_rows")


def spreads(df: DataFrame, factors: list[str]) -> DataFrame:
    """(factor, std)."""
    aggs = [F.stddev_samp(f).alias(f"c{i}_std") for i, f in enumerate(factors)]
    return _rows(df.agg(*aggs), [({"factor": f}, f"c{i}") for i, f in enumerate(factors)], ["std"])


def _numbers(df: DataFrame, factors: list[str], ret: str | None = None) -> dict:
    """All that a selection asks, by one job and one row per pair: the spread of each factor, the correlation of each pair and, with
    ``ret``, each factor's IC (also rounded) and number of pairs."""
    columns = list(dict.fromkeys([*factors, *([] if ret is None else [ret])]))
    spread = F.when(F.col("odd") > 0, F.lit(float("nan"))).otherwise(F.sqrt(ratio(F.col("xx"), F.col("n") - 1)))
    rows = pair_moments(df, columns).select(
        "left", "right", (F.col("n") + F.col("odd")).alias("n"), spread.alias("std"), _correlation().alias("corr"), F.round(_correlation(), 6).alias("near"))
    found = {frozenset((r["left"], r["right"])): r for r in rows.collect()}
    at = lambda a, b, name: found[key][name] if (key := frozenset((a, b))) in found else None
    out = {"std": {f: at(f, f, "std") or 0.0 for f in factors},
           "corr": {frozenset(pair): at(*pair, "corr") for pair in combinations(factors, 2)}}
    if ret is not None:
        out["ic"] = {f: (at(f, ret, "corr"), at(f, ret, "near"), at(f, ret, "n") or 0) for f in factors}
    return out


def _apart(names: list[str], corr: dict, scores: dict[str, float], max_corr: float) -> list[str]:
    """By falling score, the names that are not too close to one that stayed."""
    kept: list[str] = []
    for name in sorted(names, key=lambda f: -abs(scores.get(f, 0.0))):
        if not any(abs(corr[frozenset((name, k))] or 0.0) > max_corr for k in kept):
            kept.append(name)
    return kept


def uncorrelated(df: DataFrame, factors: list[str], scores: dict[str, float] | None = None, max_corr: float = MAX_CORR,
                 method: str = "pearson") -> list[str]:
    """Names left after dropping near-copies: by falling score, a factor stays if it is not too close to
    one that stayed. The driver reads one number per factor and per pair of factors."""
    if not factors:
        return []
    found = _numbers(df, factors)
    names = [f for f in factors if found["std"][f] > EPS]
    corr = found["corr"]
    if method != "pearson" and len(names) > 1:
        corr = {frozenset((r["left"], r["right"])): r["corr"] for r in corr_matrix(df, names, method).collect()}
    return names if len(names) < 2 else _apart(names, corr, scores or {}, max_corr)


def mean_corr(df: DataFrame, factors: list[str]) -> DataFrame:
    """(factor, mean_corr): mean absolute correlation of each factor with the others."""
    m = corr_matrix(df, factors)
    both_ways = m.select(F.col("left").alias("factor"), "corr").unionByName(m.select(F.col("right").alias("factor"), "corr"))
    return both_ways.groupBy("factor").agg(F.avg(F.abs("corr")).alias("mean_corr"))


def mean_corr_filter(df: DataFrame, factors: list[str], limit: float = MAX_MEAN_CORR) -> list[str]:
    """Names whose mean absolute correlation stays within the limit."""
    if len(factors) < 2:
        return list(factors)
    ok = {r["factor"] for r in mean_corr(df, factors).where(F.col("mean_corr") <= limit).collect()}
    return [f for f in factors if f in ok]


def select_factors(df: DataFrame, factors: list[str], ret: str, min_abs_ic: float = MIN_ABS_IC, max_corr: float = MAX_CORR,
                   mean_limit: float = MAX_MEAN_CORR) -> list[tuple[str, float]]:
    """IC filter, then near-copies out, then the mean-correlation filter: (factor, ic) strongest first.

    One pass over the table answers all three steps.
    """
    if not factors:
        return []
    found = _numbers(df, factors, ret)
    corr = found["corr"]
    scores = {f: near for f, (ic, near, n) in found["ic"].items() if ic is not None and n >= MIN_PERIODS and abs(ic) >= min_abs_ic}
    names = sorted(scores, key=lambda f: (-abs(scores[f]), f))
    varied = [f for f in names if found["std"][f] > EPS]
    names = varied if len(varied) < 2 else _apart(varied, corr, scores, max_corr)
    if len(names) < 2:
        return [(f, scores[f]) for f in names]
    kept = []
    for f in names:
        others = [abs(c) for g in names if g != f and (c := corr[frozenset((f, g))]) is not None]
        if others and sum(others) / len(others) <= mean_limit:
            kept.append((f, scores[f]))
    return kept
