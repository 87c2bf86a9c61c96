"""Registration of the runnable queries and of the SQL they are checked against.

A query states its output columns once, as ``name:kind`` words. Kinds: ``d`` date, ``i`` integer,
``b`` boolean, ``s`` text (default), or a number of decimals for a double. The same list shapes the
Spark result and the SQL result, so both round and cast alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.plans.tables import with_tables

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    cols: str
    sql: str | None
    uses: str

    def run(self, spark: SparkSession, folder: str) -> DataFrame:
        return shape(self.build(spark, folder), self.cols)

    def oracle(self) -> str | None:
        return None if self.sql is None else with_tables(self.uses, self.sql, shape_sql(self.cols))


REGISTRY: dict[str, Query] = {}


def query(name: str, cols: str, sql: str | None = None, uses: str = ""):
    """Decorator that registers ``build(spark, folder)`` under ``name``."""

    def add(build: Build) -> Build:
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, build, cols, sql, uses)
        return build

    return add


def _spec(cols: str) -> list[tuple[str, str]]:
    return [(w.split(":")[0], w.split(":")[1] if ":" in w else "s") for w in cols.split()]


def shape(df: DataFrame, cols: str) -> DataFrame:
    out = []
    for name, kind in _spec(cols):
        c = F.col(name)
        if kind == "d":
            c = F.date_format(c, "yyyy-MM-dd")
        elif kind == "i":
            c = c.cast("bigint")
        elif kind == "b":
            c = c.cast("boolean")
        elif kind != "s":
            c = F.round(F.nanvl(c.cast("double"), F.lit(None).cast("double")), int(kind)) + F.lit(0.0)
        out.append(c.alias(name))
    return df.select(*out)


def shape_sql(cols: str) -> str:
    out = []
    for name, kind in _spec(cols):
        if kind == "d":
            out.append(f"strftime({name}, '%Y-%m-%d') AS {name}")
        elif kind == "i":
            out.append(f"CAST({name} AS BIGINT) AS {name}")
        elif kind == "b":
            out.append(f"CAST({name} AS BOOLEAN) AS {name}")
        elif kind == "s":
            out.append(name)
        else:
            v = f"CAST({name} AS DOUBLE)"
            out.append(f"round(CASE WHEN isnan({v}) THEN NULL ELSE {v} END, {kind}) + 0.0 AS {name}")
    return ", ".join(out)
