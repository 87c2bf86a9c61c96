"""Searching stored records: nearest vectors, lookup by security, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two arrays, summed in double precision."""
    gaps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v)


def nearest(vectors: DataFrame, query: Column, k: int = 5, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """The k stored vectors nearest to one query vector, ties by key. Each task keeps k rows; no shuffle
    of the vectors. ``query`` is an array literal or a scalar subquery."""
    scored = vectors.withColumn("_query", query).withColumn("distance", squared_distance(F.col(vector), F.col("_query"))).drop("_query")
    return scored.orderBy("distance", key).limit(k)


def by_stock(records: DataFrame, code: str, limit: int) -> DataFrame:
    """The ``limit`` newest records of one security."""
    return records.where(F.col("metadata")["stock_code"] == code).orderBy(F.col("metadata")["timestamp"].desc(), "id").limit(limit)


def collection_stats(records: DataFrame) -> DataFrame:
    return records.groupBy("collection").agg(F.count(F.lit(1)).alias("n"))
