"""SQL side of the shared inputs: each entry is a WITH item over the given tables."""

from __future__ import annotations

# name -> (inputs it needs, SQL)
TABLES: dict[str, tuple[str, str]] = {
    "bars": ("", """
        SELECT ts_code, trade_date, industry, open, high, low, close, vol, amount, n_rows,
               CASE WHEN vol >= 12 THEN close END AS gap
        FROM (
            SELECT 'S' || l_suppkey AS ts_code, CAST(l_shipdate AS DATE) AS trade_date,
                   arg_min(100 + sqrt(l_extendedprice * (1 - l_discount)) / 20, seq) AS open,
                   max((100 + sqrt(l_extendedprice) / 20) * (1 + l_tax / 20)) AS high,
                   min((100 + sqrt(l_extendedprice * (1 - l_discount)) / 20) * (1 - l_tax / 20)) AS low,
                   arg_max(100 + sqrt(l_extendedprice) / 20, seq) AS close,
                   sum(l_quantity) AS vol,
                   sum((100 + sqrt(l_extendedprice) / 20) * l_quantity) AS amount,
                   count(*) AS n_rows
            FROM (SELECT *, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS seq FROM lineitem)
            GROUP BY 1, 2) g
        JOIN (SELECT 'S' || s_suppkey AS ts_code, r_name AS industry
              FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
        USING (ts_code)"""),
    "days": ("bars", """
        SELECT trade_date, row_number() OVER (ORDER BY trade_date) - 1 AS day_no
        FROM (SELECT DISTINCT trade_date FROM bars)"""),
    "rets": ("bars", """
        SELECT *, close / lag(close) OVER (PARTITION BY ts_code ORDER BY trade_date) - 1 AS ret FROM bars"""),
    "holdings": ("rets", """
        SELECT *, amount / sum(amount) OVER (PARTITION BY trade_date) AS weight FROM rets"""),
    "labelled": ("rets", """
        SELECT *, lead(close, 5) OVER (PARTITION BY ts_code ORDER BY trade_date) / close - 1 AS fwd_ret FROM rets"""),
}


def _needed(names: str) -> list[str]:
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in TABLES[name][0].split():
            visit(dep)
        if name not in order:
            order.append(name)

    for n in names.split():
        visit(n)
    return order


def with_tables(uses: str, body: str, outer: str) -> str:
    """Full statement: shared inputs, the query body, the shaped output.

    A body that starts with WITH items of its own puts them before a line ``--`` .
    """
    items = [f"{n} AS ({TABLES[n][1].strip()})" for n in _needed(uses)]
    own, _, main = body.rpartition("\n--\n")
    if own.strip():
        items.append(own.strip())
    items.append(f"result_rows AS ({main.strip()})")
    return "WITH RECURSIVE " + ",\n".join(items) + f"\nSELECT {outer} FROM result_rows"
