"""Run queries on Spark and their SQL on DuckDB over the same tables and compare the rows.

    python -m tests.oracle_check --sf 0.01 fn_mean cs_   # names or prefixes
"""

from __future__ import annotations

import argparse
import math
import time
from collections import Counter

import duckdb

import __spark_entry__ as entry
from barloom.session import build_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def rows_of(rows, names) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple("NaN" if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in rows)


def compare(spark, con, name: str, folder: str) -> str:
    """Empty when equal, else what differs."""
    df = entry.queries()[name](spark, folder)
    got = rows_of(df.collect(), df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return "" if got else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(cur.fetchall(), names)
    if sorted(names) != sorted(df.columns):
        return f"columns {df.columns} != {names}"
    if got != want:
        return (f"{sum(got.values())} rows against {sum(want.values())}; only here "
                f"{list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}")
    return "" if got else "no rows on both sides"


def main() -> None:
    p = argparse.ArgumentParser()
    p.add_argument("prefixes", nargs="*")
    p.add_argument("--sf", default="0.01")
    a = p.parse_args()
    folder = f"/root/testdata/sf{a.sf}"
    spark = build_session("oracle-check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in entry.queries():
        if a.prefixes and not any(name.startswith(x) for x in a.prefixes):
            continue
        t = time.time()
        try:
            diff = compare(spark, con, name, folder)
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        bad += bool(diff)
        print(f"{'FAIL' if diff else 'ok'} {name} {time.time() - t:.1f}s {diff}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
