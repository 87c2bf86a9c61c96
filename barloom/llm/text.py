"""Text helpers that the operators share, all built-in Spark functions."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = "[ \\t-\\r]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def words(c: Column) -> Column:
    """Maximal runs of characters other than space and U+0009 to U+000D; null and blank texts have none."""
    inner = F.btrim(F.coalesce(c, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANK_CLASS))


def bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where a lambda inside refers to it many times."""
    return F.element_at(F.transform(F.array(value), use), 1)


def packed(docs: DataFrame, *wanted: str) -> DataFrame:
    """``row``, the given rows as structs, beside the columns an operator works on: no working name meets one of the caller's."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *wanted)


def unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The packed rows' own columns again, some of them changed."""
    return rows.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in columns])
