"""Bars panel from the given sales tables: securities are suppliers, industries are regions."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.core import Axis
from barloom.functions.series import pct_change
from barloom.session import materialize

KEYS = ["trade_date", "ts_code"]
BY_SUPPLIER = Axis(key="l_suppkey")


# Column types of the given tables; stating them spares a footer-reading job per read.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "conversations": "conv_id long, turn long, role string, text string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    return reader.parquet(f"{folder}/{name}.parquet")


def security_dim(spark: SparkSession, folder: str) -> DataFrame:
    """(ts_code, industry)."""
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, folder, "region").select("r_regionkey", F.col("r_name").alias("industry"))
    where = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        table(spark, folder, "supplier")
        .join(where, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("ts_code"), "industry")
    )


def bars(spark: SparkSession, folder: str, industry: bool = False, dates: tuple[str, str] | None = None) -> DataFrame:
    """One row per (ts_code, trade_date); the industry is joined only where it is asked for.

    A date range (both ends included) is put on the raw time column, where the Parquet reader can
    skip row groups by it; on the derived date it could not.

    The raw rows collapse to bars before any join or window: partial aggregation on the map side
    turns a security or date with a third of all rows into at most one row per day and task, so the
    exchanges behind it carry bars only. A security then has at most one row per trading day.

    First and last trade of a day go by order key, line and part packed into one long: a number
    keeps the aggregation hash-based, a struct would make Spark sort all raw rows.
    """
    daily = _daily(_ticks(spark, folder, dates)).drop("l_suppkey")
    return daily.join(security_dim(spark, folder), "ts_code") if industry else daily


#: A security with more raw rows is added up per day before it is dealt.
HOT_ROWS = 1_000_000


def series_bars(spark: SparkSession, folder: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The same bars with ``l_suppkey``, each security whole in one partition: for plans with windows per ``BY_SUPPLIER``.

    The raw rows are dealt once, by security, over all ``spark.sql.shuffle.partitions`` partitions; bars and windows need no further exchange. Days hold
    few rows of one security, so sums on the map side would save little and hold a table of all bars. Only the securities with very many
    rows, at most one per ``hot_rows`` rows of the table, are first summed to one row per day.
    """
    ticks = _ticks(spark, folder)
    many = table(spark, folder, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows)
    hot = [r["l_suppkey"] for r in many.collect()]
    if hot:
        is_hot = F.coalesce(F.col("l_suppkey").isin([k for k in hot if k is not None]), F.lit(None in hot))
        summed = ticks.where(is_hot).groupBy("l_suppkey", "trade_date").agg(*_tick_sums())
        ticks = ticks.where(~is_hot).unionByName(summed)
    return _daily(ticks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_suppkey"))


def _ticks(spark: SparkSession, folder: str, dates: tuple[str, str] | None = None) -> DataFrame:
    """Raw rows as bars of one trade each: ``_first`` and ``_last`` order the trades of a day."""
    ext = F.col("l_extendedprice")
    shut = 100 + F.sqrt(ext) / 20
    start = 100 + F.sqrt(ext * (1 - F.col("l_discount"))) / 20
    part_bits = F.lit(2 ** 20)
    seq = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * part_bits + F.col("l_partkey") % part_bits
    raw = table(spark, folder, "lineitem")
    if dates is not None:
        start_at, end_at = (F.to_timestamp_ntz(F.lit(d)) for d in (dates[0], str(date.fromisoformat(dates[1]) + timedelta(days=1))))
        raw = raw.where((F.col("l_shipdate") >= start_at) & (F.col("l_shipdate") < end_at))
    return raw.select(
        "l_suppkey", F.to_date("l_shipdate").alias("trade_date"),
        start.alias("_o"), shut.alias("_c"), seq.alias("_first"), seq.alias("_last"), F.col("l_quantity").alias("_q"),
        (shut * (1 + F.col("l_tax") / 20)).alias("_h"), (start * (1 - F.col("l_tax") / 20)).alias("_l"),
        (shut * F.col("l_quantity")).alias("_a"), F.lit(1).cast("long").alias("_n"))


def _tick_sums() -> list[Column]:
    return [F.min_by("_o", "_first").alias("_o"), F.max("_h").alias("_h"), F.min("_l").alias("_l"), F.max_by("_c", "_last").alias("_c"),
            F.min("_first").alias("_first"), F.max("_last").alias("_last"), F.sum("_q").alias("_q"), F.sum("_a").alias("_a"), F.sum("_n").alias("_n")]


def _daily(ticks: DataFrame) -> DataFrame:
    names = {"_o": "open", "_h": "high", "_l": "low", "_c": "close", "_q": "vol", "_a": "amount", "_n": "n_rows"}
    return (
        ticks.groupBy("l_suppkey", "trade_date").agg(*_tick_sums()).drop("_first", "_last").withColumnsRenamed(names)
        .withColumn("ts_code", F.concat(F.lit("S"), F.col("l_suppkey")))
        .withColumn("gap", F.when(F.col("vol") >= 12, F.col("close")))
    )


def returns(spark: SparkSession, folder: str, industry: bool = False) -> DataFrame:
    """Bars with ``ret``, the change against the security's previous bar."""
    return bars(spark, folder, industry).withColumn("ret", pct_change("close"))


def stored_returns(spark: SparkSession, folder: str, industry: bool = False) -> DataFrame:
    """The same, written once to the shared folder: for plans that read it several times, which would
    otherwise scan and aggregate the raw rows each time."""
    cols = ["trade_date", "ts_code", "close", "vol", "amount", "ret", *(["industry"] if industry else [])]
    return materialize(returns(spark, folder, industry).select(cols), "returns")
