"""Incremental bar loading as a stream: new files in, merged bars out.

The batch rule is ``barloom.sources.bars_io.incremental_merge``: bars after a symbol's last stored
date are added, stored bars never change, of several new rows for one date the first stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from barloom.sources.bars_io import first_per_key
from barloom.sources.store import exists

BARS = ["ts_code", "trade_date", "close", "vol"]


def fresh_rows(stored: DataFrame | None, batch: DataFrame, seq: str) -> DataFrame:
    """Rows of a batch that go behind the stored ones."""
    if stored is not None:
        last = stored.groupBy("ts_code").agg(F.max("trade_date").alias("_last"))
        batch = batch.join(last, "ts_code", "left").where(
            F.col("_last").isNull() | (F.col("trade_date") > F.col("_last"))).drop("_last")
    return first_per_key(batch, ["ts_code", "trade_date"], seq)


def merge_batch(store: str, seq: str):
    """``foreachBatch`` function that appends a batch's fresh rows to the Parquet store.

    Each batch writes its own ``batch=<id>`` folder with overwrite, and reads only the earlier ones: a
    batch that is run again after a failure replaces its own rows instead of adding them twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = spark.read.parquet(store).where(F.col("batch") < batch_id) if exists(spark, store) else None
        fresh_rows(stored, batch, seq).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return write


def start_merge(spark: SparkSession, inbox: str, schema: str, store: str, checkpoint: str, seq: str = "seq",
                files_per_batch: int | None = None) -> StreamingQuery:
    """Merge every bar file that lands in ``inbox`` into the store, then stop when it is drained."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return (
        reader.parquet(inbox).writeStream.foreachBatch(merge_batch(store, seq))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
