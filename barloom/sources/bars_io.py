"""Reading, normalising, merging and writing daily bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import materialize
from barloom.sources.store import exists

NUMERIC = ("open", "high", "low", "close", "vol", "amount")


def scan_range(df: DataFrame, start, end, date: str = "trade_date") -> DataFrame:
    """Rows of a date range, both ends included. On a Parquet scan the predicate is pushed down; on a
    date-partitioned table it prunes partitions."""
    return df.where(F.col(date).between(F.lit(start), F.lit(end)))


def read_bars(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """All bar files under a path within a date range. An unreadable file fails the read, as a result without it would be incomplete."""
    df = spark.read.parquet(path)
    return df if start is None else scan_range(df, start, end)


def file_spans(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """(file, first, last, n_rows): date range and size of every bar file below a path.

    With the spans ``known`` from before only files they lack are read, and spans of files that are gone are dropped; the rest
    is a listing. Files have unique names and do not change, as Spark writes them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select(F.col("path").alias("file"))
    if known is None:
        new = [r.file for r in files.collect()]
    else:
        new = [r.file for r in files.join(known, "file", "left_anti").collect()]
        known = known.join(files, "file", "left_semi")
    if not new:
        return known if known is not None else spark.createDataFrame([], "file string, first date, last date, n_rows long")
    spans = spark.read.option("basePath", path).parquet(*new).groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min("trade_date").alias("first"), F.max("trade_date").alias("last"), F.count(F.lit(1)).alias("n_rows"))
    return materialize(spans if known is None else known.unionByName(spans), "spans")


def files_of_range(spans: DataFrame, start: str, end: str) -> list[str]:
    """Files that hold a date of the range."""
    hit = spans.where((F.col("first") <= F.lit(end)) & (F.col("last") >= F.lit(start)))
    return sorted(r.file for r in hit.select("file").collect())


def read_files_of_range(spark: SparkSession, path: str, spans: DataFrame, start: str, end: str) -> DataFrame:
    """The bars of a date range; files without one of its dates are not opened. Without any such file the first one gives the columns."""
    files = files_of_range(spans, start, end)
    df = spark.read.option("basePath", path).parquet(*files) if files else spark.read.parquet(path).limit(0)
    return scan_range(df, start, end)


def normalize(raw: DataFrame, names: dict[str, str], code: Column) -> DataFrame:
    """Vendor columns to bar columns: constant code, compact dates, bad numbers NULL, no bar without close."""
    kept = {new: F.col(old) for old, new in names.items() if old in raw.columns}
    out = raw.select(code.alias("ts_code"), *(c.alias(n) for n, c in kept.items()))
    out = out.withColumn("trade_date", F.regexp_replace(F.col("trade_date").cast("string"), "-", ""))
    out = out.withColumns({c: F.nanvl(F.col(c).cast("string").try_cast("double"), F.lit(None).cast("double"))
                           for c in NUMERIC if c in kept})
    return out.dropna(subset=["close"])


def union_bars(*parts: DataFrame) -> DataFrame:
    """Bars of several symbols or sources one below the other. Sort only when writing for people."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def first_per_key(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """First row per key in ``seq`` order, by aggregation: copies of one key collapse on the map side,
    so a key with a third of all rows costs one row per task. ``seq`` must be a number."""
    rest = [c for c in df.columns if c not in (*keys, seq)]
    return df.groupBy(*keys).agg(*(F.min_by(c, seq).alias(c) for c in rest)).select(*keys, *rest)


def incremental_merge(old: DataFrame, new: DataFrame, seq: str) -> DataFrame:
    """Old bars plus the new ones after each symbol's last stored date; of several new rows for a
    date the first stays. Stored bars are never replaced."""
    last = old.groupBy("ts_code").agg(F.max("trade_date").alias("_last"))
    fresh = new.join(last, "ts_code", "left").where(
        F.col("_last").isNull() | (F.col("trade_date") > F.col("_last"))).drop("_last")
    return old.unionByName(first_per_key(fresh, ["ts_code", "trade_date"], seq).select(*old.columns))


def write_panel(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by year; a year's rows land together, large years split by size."""
    years = df.withColumn("year", F.year("trade_date"))
    years.hint("rebalance", "year").write.mode(mode).partitionBy("year").parquet(path)


def load_if_missing(requested: DataFrame, stored: DataFrame, source: DataFrame) -> DataFrame:
    """(ts_code, n_rows): -1 for symbols already stored, else the number of rows loaded for them."""
    have = stored.select("ts_code").distinct()
    found = source.groupBy("ts_code").agg(F.count(F.lit(1)).alias("_n"))
    return (
        requested.select("ts_code").distinct()
        .join(have.withColumn("_have", F.lit(True)), "ts_code", "left")
        .join(found, "ts_code", "left")
        .select("ts_code", F.when(F.col("_have"), F.lit(-1)).otherwise(F.coalesce("_n", F.lit(0))).alias("n_rows"))
    )


def load_ranges(spark: SparkSession, requested: DataFrame, source: DataFrame, path: str) -> DataFrame:
    """Load the requested (ts_code, first_date, last_date) ranges into the bar store; answers each request with n_rows.

    n_rows is -1 for a request that was loaded before, else the number of source rows in its range (0: nothing found, so it is
    asked again next time). Only bars that the store lacks are appended, whichever request brought the others. Bars are written before
    the requests are noted: a run that is repeated after a failure finds the bars and adds none twice.
    """
    rows, noted = f"{path}/bars", f"{path}/requests"
    asked = requested.select("ts_code", "first_date", "last_date").distinct()
    keys = ["ts_code", "first_date", "last_date"]
    done = materialize(spark.read.parquet(noted), "noted") if exists(spark, noted) else asked.limit(0)
    todo = materialize(asked.join(done, keys, "left_anti"), "todo")
    wanted = todo.select(F.col("ts_code").alias("_code"), "first_date", "last_date")
    inside = (F.col("ts_code") == F.col("_code")) & F.col("trade_date").between(F.col("first_date"), F.col("last_date"))
    found = materialize(source.join(wanted, inside, "left_semi"), "found")
    missing = found.join(spark.read.parquet(rows).select("ts_code", "trade_date"), ["ts_code", "trade_date"], "left_anti") if exists(spark, rows) else found
    missing.select(*source.columns).write.mode("append").parquet(rows)
    counts = materialize(found.join(wanted, inside).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")), "counts")
    counts.select(*keys).write.mode("append").parquet(noted)
    return asked.join(counts, keys, "left").join(done.select(*keys, F.lit(-1).cast("long").alias("_done")), keys, "left").select(
        *keys, F.coalesce("_done", "_n", F.lit(0)).alias("n_rows"))


def stock_universe(active: DataFrame, paused: DataFrame, delisted: DataFrame) -> DataFrame:
    """Stock list with ``list_status`` L, P or D; a delisted code counts only if no other list has it."""
    known = active.withColumn("list_status", F.lit("L")).unionByName(paused.withColumn("list_status", F.lit("P")))
    extra = delisted.join(known.select("ts_code"), "ts_code", "left_anti").withColumn("list_status", F.lit("D"))
    return known.unionByName(extra, allowMissingColumns=True)


def open_days(bars: DataFrame, start, end) -> DataFrame:
    """Trading calendar from the bars themselves: every raw day of the range with its open flag."""
    raw = bars.agg(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)))).alias("cal_date"))
    traded = scan_range(bars, start, end).select(F.col("trade_date").alias("cal_date")).distinct()
    return raw.join(traded.withColumn("is_open", F.lit(True)), "cal_date", "left").select(
        "cal_date", F.coalesce("is_open", F.lit(False)).alias("is_open"))
