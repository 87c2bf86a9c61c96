"""Parquet-backed stores: keyed datasets, factor columns, append-only records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["trade_date", "ts_code"]
# The wording of the record texts below, and the length of the reasoning kept in one.


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete one dataset or partition folder; true if it was there."""
    fs, p = _fs(spark, path)
    return fs.delete(p, True) if fs.exists(p) else False


class DatasetStore:
    """Datasets under names, one Parquet folder each."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def _at(self, name: str) -> str:
        return f"{self.root}/dataset={name}"

    def put(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self._at(name))

    def get(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(self._at(name)) if exists(self.spark, self._at(name)) else None

    def clear(self) -> None:
        remove(self.spark, self.root)

    def stats(self) -> DataFrame:
        """(dataset, n_files, n_bytes) from the file listing; contents are not read."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self.root)
        return files.groupBy("dataset").agg(F.count("length").alias("n_files"), F.sum("length").alias("n_bytes"))


class FactorStore:
    """Factor columns as a long table partitioned by factor name."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def write(self, factors: DataFrame, names: list[str]) -> None:
        """Store the named columns; an existing factor is replaced."""
        long = factors.select(*KEYS, F.explode(F.array(*(
            F.struct(F.lit(n).alias("factor"), F.col(n).cast("double").alias("value")) for n in names))).alias("_c"))
        # rebalanced first: else every task would write a small file for every factor
        (long.select(*KEYS, "_c.factor", "_c.value").hint("rebalance", "factor").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("factor").parquet(self.root))

    def read(self, names: list[str]) -> DataFrame:
        """Long rows of the named factors (partition pruning); unknown names are skipped."""
        return self.spark.read.parquet(self.root).where(F.col("factor").isin(names))

    def read_wide(self, names: list[str]) -> DataFrame:
        """One column per named factor: a single aggregation, no join per factor."""
        cells = [F.max(F.when(F.col("factor") == n, F.col("value"))).alias(n) for n in names]
        return self.read(names).groupBy(*KEYS).agg(*cells)

    def names(self) -> DataFrame:
        return self.spark.read.parquet(self.root).select("factor").distinct()

    def has(self, name: str) -> bool:
        return exists(self.spark, f"{self.root}/factor={name}")

    def delete(self, name: str) -> bool:
        return remove(self.spark, f"{self.root}/factor={name}")

    def info(self) -> DataFrame:
        return self.spark.read.parquet(self.root).groupBy("factor").agg(F.count(F.lit(1)).alias("n_rows"))


def _meta(**fields: Column) -> Column:
    return F.create_map(*(x for k, v in fields.items() for x in (F.lit(k), v.cast("string"))))


def decision_record(code: Column, agent: Column, signal: Column, confidence: Column, reasoning: Column, at: Column) -> list[Column]:
    """Record columns of one decision."""
    text = F.concat(F.lit("股票:"), code, F.lit(" Agent:"), agent, F.lit(" 信号:"), F.coalesce(signal, F.lit("?")),
                    F.lit(" 置信度:"), F.coalesce(confidence.cast("string"), F.lit("0")), F.lit(" 分析:"), F.coalesce(reasoning, F.lit("")))
    return [F.concat_ws("_", code, agent, at).alias("id"), F.lit("agent_decisions").alias("collection"),
            text.alias("document"), _meta(stock_code=code, agent_name=agent, timestamp=at).alias("metadata"),
            F.lit(None).cast("array<float>").alias("embedding")]


def snapshot_record(code: Column, features: Column, at: Column) -> list[Column]:
    """Record columns of one market snapshot vector."""
    return [F.concat_ws("_", code, at).alias("id"), F.lit("market_patterns").alias("collection"),
            F.concat(F.lit("Market snapshot for "), code).alias("document"),
            _meta(stock_code=code, timestamp=at).alias("metadata"), features.cast("array<float>").alias("embedding")]


def reflection_record(code: Column, prediction: Column, actual: Column, lesson: Column, at: Column) -> list[Column]:
    """Record columns of one look back at a prediction."""
    text = F.concat(F.lit("预测:"), prediction, F.lit(" → 实际:"), actual, F.lit(" | 教训:"), lesson)
    return [F.concat_ws("_", F.lit("reflection"), code, at).alias("id"), F.lit("reflections").alias("collection"),
            text.alias("document"), _meta(stock_code=code, prediction=prediction, actual=actual, timestamp=at).alias("metadata"),
            F.lit(None).cast("array<float>").alias("embedding")]


def append(df: DataFrame, path: str) -> None:
    """Add records to a table partitioned by collection."""
    df.write.mode("append").partitionBy("collection").parquet(path)
