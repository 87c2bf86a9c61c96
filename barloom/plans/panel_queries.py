"""Queries for sources, sinks, quality checks and panel construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions.series import pct_change
from barloom.operators import panel, quality
from barloom.plans.base import query
from barloom.session import materialize, scratch_table
from barloom.sources import bars_io, store
from barloom.sources.panel_tables import bars, returns, security_dim, table

KEY = "trade_date:d ts_code"
START, END = "1997-01-01", "1999-12-31"
ORDERED = "PARTITION BY ts_code ORDER BY trade_date"


def raw_trades(spark, folder):
    """Unaggregated sales as new price rows: several may fall on one security and day."""
    seq = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 2 ** 20 + F.col("l_partkey") % 2 ** 20
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey")).alias("ts_code"), F.to_date("l_shipdate").alias("trade_date"),
        (101 + F.sqrt("l_extendedprice") / 20).alias("close"), seq.alias("seq"))


def order_bars(spark, folder):
    """A second source: customers as securities."""
    price = 100 + F.sqrt("o_totalprice") / 20
    return table(spark, folder, "orders").groupBy(
        F.concat(F.lit("C"), F.col("o_custkey")).alias("ts_code"), F.to_date("o_orderdate").alias("trade_date")).agg(
        F.max(price).alias("close"), F.count(F.lit(1)).cast("double").alias("vol"))


ORDER_BARS = """order_bars AS (SELECT 'C' || o_custkey AS ts_code, CAST(o_orderdate AS DATE) AS trade_date,
    max(100 + sqrt(o_totalprice) / 20) AS close, CAST(count(*) AS DOUBLE) AS vol FROM orders GROUP BY 1, 2)"""

# -- sources and sinks ----------------------------------------------------------------------------


@query("scan_bars_range", KEY + " close:6 vol:2", uses="bars",
       sql=f"SELECT trade_date, ts_code, close, vol FROM bars WHERE trade_date BETWEEN '{START}' AND '{END}'")
def scan_bars_range(spark, folder):
    return bars(spark, folder, dates=(START, END))


@query("scan_bars_files", KEY + " close:6 vol:2", uses="bars",
       sql=f"SELECT trade_date, ts_code, close, vol FROM bars WHERE trade_date BETWEEN '{START}' AND '{END}'")
def scan_bars_files(spark, folder):
    path = scratch_table(spark, "files")
    bars_io.write_panel(bars(spark, folder).select("trade_date", "ts_code", "close", "vol"), path)
    return bars_io.read_files_of_range(spark, path, bars_io.file_spans(spark, path), START, END).drop("year")


@query("normalize_bars", "trade_date ts_code open:4 close:4 vol:2", sql="""
    SELECT strftime(l_shipdate, '%Y%m%d') AS trade_date, '600000.SH' AS ts_code,
           CASE WHEN l_returnflag <> 'A' THEN l_extendedprice END AS open, l_extendedprice AS close, l_quantity AS vol
    FROM lineitem WHERE l_linestatus <> 'O'""")
def normalize_bars(spark, folder):
    vendor = table(spark, folder, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("日期"),
        F.when(F.col("l_returnflag") == "A", F.lit("--")).otherwise(F.col("l_extendedprice").cast("string")).alias("开盘"),
        F.when(F.col("l_linestatus") == "O", F.lit("NaN")).otherwise(F.col("l_extendedprice").cast("string")).alias("收盘"),
        F.col("l_quantity").cast("string").alias("成交量"))
    names = {"日期": "trade_date", "开盘": "open", "收盘": "close", "成交量": "vol"}
    return bars_io.normalize(vendor, names, F.lit("600000.SH"))


@query("union_bars", KEY + " close:6 vol:2 open:6", uses="bars", sql=f"""{ORDER_BARS}
--
SELECT trade_date, ts_code, close, vol, open FROM bars
UNION ALL SELECT trade_date, ts_code, close, vol, NULL FROM order_bars""")
def union_bars(spark, folder):
    return bars_io.union_bars(bars(spark, folder).select("trade_date", "ts_code", "close", "vol", "open"),
                              order_bars(spark, folder))


@query("incremental_merge", KEY + " close:6", uses="bars", sql="""
    SELECT trade_date, ts_code, close FROM bars WHERE trade_date < '1999-06-01'
    UNION ALL
    SELECT trade_date, ts_code, arg_min(price, seq) FROM (
        SELECT CAST(l_shipdate AS DATE) AS trade_date, 'S' || l_suppkey AS ts_code, 101 + sqrt(l_extendedprice) / 20 AS price,
               l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS seq FROM lineitem) n
    LEFT JOIN (SELECT ts_code, max(trade_date) AS last_date FROM bars WHERE trade_date < '1999-06-01' GROUP BY 1) o
    USING (ts_code) WHERE last_date IS NULL OR trade_date > last_date GROUP BY 1, 2""")
def incremental_merge(spark, folder):
    old = bars(spark, folder).where("trade_date < '1999-06-01'").select("trade_date", "ts_code", "close")
    return bars_io.incremental_merge(old, raw_trades(spark, folder), "seq")


@query("write_panel", "year:i n:i total:2", uses="bars",
       sql="SELECT year(trade_date) AS year, count(*) AS n, sum(close) AS total FROM bars GROUP BY 1")
def write_panel(spark, folder):
    path = scratch_table(spark, "panel")
    bars_io.write_panel(bars(spark, folder), path)
    return bars_io.read_bars(spark, path).groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("close").alias("total"))


@query("dataset_stats", "dataset has_files:b n:i", uses="bars", sql="""
    SELECT 'bars' AS dataset, true AS has_files, count(*) AS n FROM bars
    UNION ALL SELECT 'days', true, count(DISTINCT trade_date) FROM bars""")
def dataset_stats(spark, folder):
    cache = store.DatasetStore(spark, scratch_table(spark, "datasets"))
    cache.put("bars", bars(spark, folder))
    cache.put("days", panel.dates(cache.get("bars")))
    counted = [cache.get(n).agg(F.count(F.lit(1)).alias("n")).withColumn("dataset", F.lit(n)) for n in ("bars", "days")]
    return cache.stats().join(counted[0].unionByName(counted[1]), "dataset").withColumn(
        "has_files", (F.col("n_files") > 0) & (F.col("n_bytes") > 0))


@query("factor_store_roundtrip", KEY + " factor value:6", uses="rets", sql="""
    SELECT trade_date, ts_code, 'ret' AS factor, ret AS value FROM rets
    UNION ALL SELECT trade_date, ts_code, 'gap', gap FROM rets""")
def factor_store_roundtrip(spark, folder):
    factors = store.FactorStore(spark, scratch_table(spark, "factors"))
    factors.write(returns(spark, folder), ["ret", "gap", "vol"])
    factors.delete("vol")
    return factors.read(["ret", "gap", "vol", "absent"])


@query("stock_universe", "ts_code list_status", sql="""
    SELECT 'S' || s_suppkey AS ts_code, CASE WHEN s_acctbal >= 1000 THEN 'L' WHEN s_acctbal >= 0 THEN 'P' ELSE 'D' END AS list_status
    FROM supplier WHERE s_acctbal >= 0 OR s_suppkey IN (SELECT l_suppkey FROM lineitem)""")
def stock_universe(spark, folder):
    listed = table(spark, folder, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey")).alias("ts_code"), "s_acctbal")
    traded = table(spark, folder, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey")).alias("ts_code")).distinct()
    bal = F.col("s_acctbal")
    return bars_io.stock_universe(listed.where(bal >= 1000).select("ts_code"),
                                  listed.where((bal >= 0) & (bal < 1000)).select("ts_code"), traded)


@query("market_returns", "trade_date:d ret:6", uses="bars", sql="""
    SELECT trade_date, close / lag(close) OVER (ORDER BY trade_date) - 1 AS ret
    FROM (SELECT trade_date, avg(close) AS close FROM bars GROUP BY 1)""")
def market_returns(spark, folder):
    index = bars(spark, folder).groupBy("trade_date").agg(F.avg("close").alias("close")).withColumn("ts_code", F.lit("000300.SH"))
    return index.withColumn("ret", pct_change("close"))


@query("industry_dim", "ts_code industry", sql="""
    SELECT 'S' || s_suppkey AS ts_code, r_name AS industry
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def industry_dim(spark, folder):
    return security_dim(spark, folder)


@query("training_frame", KEY + " mom5:6 fwd_ret:6", uses="labelled", sql=f"""
    SELECT * FROM (SELECT trade_date, ts_code, close / lag(close, 5) OVER ({ORDERED}) - 1 AS mom5, fwd_ret FROM labelled)
    WHERE fwd_ret IS NOT NULL""")
def training_frame(spark, folder):
    b = bars(spark, folder)
    factors = b.select("trade_date", "ts_code", pct_change("close", 5).alias("mom5"))
    labels = panel.forward_returns(b, (5,)).select("trade_date", "ts_code", F.col("ret_5d").alias("fwd_ret"))
    return factors.join(labels, panel.KEYS).dropna(subset=["fwd_ret"])


@query("trade_calendar", "cal_date:d is_open:b", uses="bars", sql=f"""
    SELECT cal_date, cal_date IN (SELECT trade_date FROM bars) AS is_open
    FROM (SELECT CAST(unnest(generate_series(DATE '{START}', DATE '{END}', INTERVAL 1 DAY)) AS DATE) AS cal_date)""")
def trade_calendar(spark, folder):
    return bars_io.open_days(bars(spark, folder), START, END)


@query("records_append", "id collection document stock_code prediction", sql="""
    WITH r AS (SELECT 'S' || l_suppkey AS code, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS stamp, * FROM lineitem)
    SELECT code || '_technical_' || stamp AS id, 'agent_decisions' AS collection,
           '股票:' || code || ' Agent:technical 信号:' || l_returnflag || ' 置信度:' || l_linenumber || ' 分析:'
           || repeat(l_linestatus || '-' || l_returnflag || ' ', 60) AS document,
           code AS stock_code, CAST(NULL AS VARCHAR) AS prediction FROM r
    UNION ALL
    SELECT 'reflection_' || code || '_' || stamp, 'reflections',
           '预测:' || l_returnflag || ' → 实际:' || l_linestatus || ' | 教训:none', code, l_returnflag FROM r""")
def records_append(spark, folder):
    lines = table(spark, folder, "lineitem")
    code = F.concat(F.lit("S"), F.col("l_suppkey"))
    at = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey")
    why = F.repeat(F.concat(F.col("l_linestatus"), F.lit("-"), F.col("l_returnflag"), F.lit(" ")), F.lit(60))
    path = scratch_table(spark, "records")
    store.append(lines.select(*store.decision_record(code, F.lit("technical"), F.col("l_returnflag"), F.col("l_linenumber"), why, at)), path)
    store.append(lines.select(*store.reflection_record(code, F.col("l_returnflag"), F.col("l_linestatus"), F.lit("none"), at)), path)
    return spark.read.parquet(path).withColumns({
        "stock_code": F.col("metadata")["stock_code"], "prediction": F.col("metadata")["prediction"]})


@query("load_if_missing", "ts_code n_rows:i", uses="bars", sql="""
    SELECT ts_code, CASE WHEN ts_code IN (SELECT ts_code FROM bars WHERE vol > 90) THEN -1 ELSE coalesce(n, 0) END AS n_rows
    FROM (SELECT 'S' || s_suppkey AS ts_code FROM supplier UNION SELECT 'C' || c_custkey FROM customer)
    LEFT JOIN (SELECT ts_code, count(*) AS n FROM bars GROUP BY 1) USING (ts_code)""")
def load_if_missing(spark, folder):
    wanted = security_dim(spark, folder).select("ts_code").unionByName(
        table(spark, folder, "customer").select(F.concat(F.lit("C"), F.col("c_custkey")).alias("ts_code")))
    b = bars(spark, folder)
    return bars_io.load_if_missing(wanted, b.where("vol > 90"), b)


@query("load_ranges", "ts_code first_date last_date n_rows:i stored:i", uses="bars", sql="""
    WITH asked AS (SELECT 'S' || s_suppkey AS ts_code, CASE WHEN s_suppkey % 2 = 0 THEN '1998-01-01' ELSE '1998-04-01' END AS first_date,
                          CASE WHEN s_suppkey % 2 = 0 THEN '1998-06-30' ELSE '1998-09-30' END AS last_date, s_suppkey % 2 = 0 AS again FROM supplier),
    n AS (SELECT ts_code, count(*) FILTER (trade_date BETWEEN '1998-01-01' AND '1998-06-30') AS first_half,
                 count(*) FILTER (trade_date BETWEEN '1998-04-01' AND '1998-09-30') AS middle,
                 count(*) FILTER (trade_date BETWEEN '1998-01-01' AND '1998-09-30') AS whole FROM bars GROUP BY 1)
    SELECT ts_code, first_date, last_date, CASE WHEN again THEN CASE WHEN first_half > 0 THEN -1 ELSE 0 END ELSE coalesce(middle, 0) END AS n_rows,
           coalesce(CASE WHEN again THEN first_half ELSE whole END, 0) AS stored
    FROM asked LEFT JOIN n USING (ts_code)""")
def load_ranges(spark, folder):
    source = materialize(bars(spark, folder).select("ts_code", "trade_date", "close"), "source")
    names = security_dim(spark, folder).select("ts_code")
    even = F.substring("ts_code", 2, 20).cast("long") % 2 == 0
    path = scratch_table(spark, "loaded")
    bars_io.load_ranges(spark, names.select("ts_code", F.lit("1998-01-01").alias("first_date"), F.lit("1998-06-30").alias("last_date")), source, path)
    second = names.select("ts_code", F.when(even, "1998-01-01").otherwise("1998-04-01").alias("first_date"), F.when(even, "1998-06-30").otherwise("1998-09-30").alias("last_date"))
    answers = bars_io.load_ranges(spark, second, source, path)
    stored = spark.read.parquet(f"{path}/bars").groupBy("ts_code").agg(F.count(F.lit(1)).alias("stored"))
    return answers.join(stored, "ts_code", "left").withColumn("stored", F.coalesce("stored", F.lit(0)))


# -- quality --------------------------------------------------------------------------------------


@query("dq_columns", "ok:b absent", uses="bars", sql="SELECT count(*) > 0 AS ok, '' AS absent FROM bars")
def dq_columns(spark, folder):
    return quality.columns_check(bars(spark, folder))


@query("dq_missing", "missing_ratio:6 n:i ok:b", uses="bars", sql="""
    SELECT *, coalesce(missing_ratio <= 0.1, false) AND n > 0 AS ok FROM (
        SELECT avg(CASE WHEN gap IS NULL THEN 1.0 ELSE 0.0 END) AS missing_ratio, count(*) AS n FROM bars)""")
def dq_missing(spark, folder):
    return quality.missing_ratio(bars(spark, folder), ("open", "close", "vol", "gap"))


@query("dq_price_range", "open_low:i high_low:i low_low:i close_low:i open_high:i high_high:i low_high:i close_high:i ok:b",
       uses="bars", sql="""
    SELECT *, open_low + high_low + low_low + close_low + open_high + high_high + low_high + close_high = 0 AS ok FROM (
        SELECT count(*) FILTER (open < 103) AS open_low, count(*) FILTER (high < 103) AS high_low,
               count(*) FILTER (low < 103) AS low_low, count(*) FILTER (close < 103) AS close_low,
               count(*) FILTER (open > 115) AS open_high, count(*) FILTER (high > 115) AS high_high,
               count(*) FILTER (low > 115) AS low_high, count(*) FILTER (close > 115) AS close_high FROM bars)""")
def dq_price_range(spark, folder):
    return quality.price_range(bars(spark, folder), 103.0, 115.0)


@query("dq_date_sorted", "user_id:i by_time:b by_value:b", sql="""
    SELECT user_id, bool_and(coalesce(pt <= ts, true)) AS by_time, bool_and(coalesce(pv <= value, true)) AS by_value
    FROM (SELECT *, lag(ts) OVER w AS pt, lag(value) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    GROUP BY 1""")
def dq_date_sorted(spark, folder):
    e = table(spark, folder, "events")
    by_time = quality.date_sorted(e, "user_id", "ts", "event_id", block=1000).withColumnRenamed("is_sorted", "by_time")
    by_value = quality.date_sorted(e, "user_id", "value", "event_id").withColumnRenamed("is_sorted", "by_value")
    return by_time.join(by_value, "user_id")


@query("dq_report", "n:i missing_ratio:6 n_outside:i columns_ok:b missing_ok:b price_ok:b passed:b warnings", uses="bars", sql="""
    SELECT count(*) AS n, 0.0 AS missing_ratio, 0 AS n_outside, true AS columns_ok, true AS missing_ok, true AS price_ok,
           true AS passed, '' AS warnings FROM bars""")
def dq_report(spark, folder):
    return quality.report(bars(spark, folder))


@query("panel_diagnose", "n_stocks:i n_dates:i start_date:d end_date:d missing_ratio:6 n_null:i day_mean:6 day_min:i day_max:i",
       uses="bars", sql="""
    SELECT *, 1 - n_values / (n_dates * n_stocks) AS missing_ratio FROM (
        SELECT count(*) AS n_dates, min(trade_date) AS start_date, max(trade_date) AS end_date, sum(n) AS n_values, sum(nn) AS n_null,
               avg(n) AS day_mean, min(n) AS day_min, max(n) AS day_max, any_value(s) AS n_stocks
        FROM (SELECT trade_date, count(gap) AS n, count(*) - count(gap) AS nn,
                     (SELECT count(DISTINCT ts_code) FROM bars) AS s FROM bars GROUP BY 1))""")
def panel_diagnose(spark, folder):
    return quality.diagnose(bars(spark, folder).withColumn("close", F.col("gap")))


@query("date_gaps", "max_gap:i mean_gap:6", uses="days", sql="""
    SELECT max(g) AS max_gap, avg(g) AS mean_gap FROM (
        SELECT trade_date - lag(trade_date) OVER (ORDER BY trade_date) AS g FROM days)""")
def date_gaps(spark, folder):
    return quality.date_gaps(bars(spark, folder))


# -- panels ---------------------------------------------------------------------------------------


@query("panel_build", KEY + " close:6", uses="bars", sql="SELECT trade_date, ts_code, close FROM bars")
def panel_build(spark, folder):
    raw = bars(spark, folder).withColumn("trade_date", F.date_format("trade_date", "yyyyMMdd"))
    return panel.build_panel(raw)


def with_adjustment(b):
    return panel.adjusted(b.withColumn("adj_factor", 1 + F.col("vol") / 97))


@query("adj_prices", KEY + " open_adj:6 high_adj:6 low_adj:6 close_adj:6", uses="bars", sql="""
    SELECT trade_date, ts_code, open * f AS open_adj, high * f AS high_adj, low * f AS low_adj, close * f AS close_adj
    FROM (SELECT *, 1 + vol / 97 AS f FROM bars)""")
def adj_prices(spark, folder):
    return with_adjustment(bars(spark, folder))


@query("price_matrix", KEY + " value:6", uses="bars", sql="SELECT trade_date, ts_code, close * (1 + vol / 97) AS value FROM bars")
def price_matrix(spark, folder):
    return panel.price_cells(with_adjustment(bars(spark, folder)))


@query("panel_grid", "trade_date:d n_cells:i n_bars:i total:4", uses="bars", sql="""
    SELECT trade_date, (SELECT count(DISTINCT ts_code) FROM bars) AS n_cells, count(*) AS n_bars, sum(close) AS total
    FROM bars GROUP BY 1""")
def panel_grid(spark, folder):
    cells = panel.grid(bars(spark, folder).select("trade_date", "ts_code", "close"))
    return cells.groupBy("trade_date").agg(F.count(F.lit(1)).alias("n_cells"), F.count("close").alias("n_bars"), F.sum("close").alias("total"))


@query("stock_list", "ts_code", uses="bars", sql="SELECT DISTINCT ts_code FROM bars")
def stock_list(spark, folder):
    return panel.stocks(bars(spark, folder)).orderBy("ts_code")


@query("date_list", "trade_date:d", uses="bars", sql="SELECT DISTINCT trade_date FROM bars")
def date_list(spark, folder):
    return panel.dates(bars(spark, folder)).orderBy("trade_date")


@query("forward_returns", KEY + " ret_1d:6 ret_5d:6 ret_10d:6", uses="bars", sql=f"""
    SELECT trade_date, ts_code, lead(close, 3) OVER w / lead(close, 2) OVER w - 1 AS ret_1d,
           lead(close, 7) OVER w / lead(close, 2) OVER w - 1 AS ret_5d, lead(close, 12) OVER w / lead(close, 2) OVER w - 1 AS ret_10d
    FROM bars WINDOW w AS ({ORDERED}) QUALIFY ret_1d IS NOT NULL""")
def forward_returns(spark, folder):
    return panel.forward_returns(bars(spark, folder), purge=2)


@query("forward_returns_calendar", KEY + " ret_1d:6 ret_5d:6 ret_10d:6", uses="bars days", sql="""
    nb AS (SELECT ts_code, close, trade_date, day_no FROM bars JOIN days USING (trade_date)), top AS (SELECT max(day_no) AS m FROM days)
--
SELECT * FROM (
    SELECT b.trade_date, b.ts_code, CASE WHEN b.day_no + 1 <= m THEN a1.close / b.close - 1 END AS ret_1d,
           CASE WHEN b.day_no + 5 <= m THEN a5.close / b.close - 1 END AS ret_5d,
           CASE WHEN b.day_no + 10 <= m THEN a10.close / b.close - 1 END AS ret_10d
    FROM nb b CROSS JOIN top
    ASOF LEFT JOIN nb a1 ON a1.ts_code = b.ts_code AND a1.day_no <= b.day_no + 1
    ASOF LEFT JOIN nb a5 ON a5.ts_code = b.ts_code AND a5.day_no <= b.day_no + 5
    ASOF LEFT JOIN nb a10 ON a10.ts_code = b.ts_code AND a10.day_no <= b.day_no + 10)
WHERE ret_1d IS NOT NULL OR ret_5d IS NOT NULL OR ret_10d IS NOT NULL""")
def forward_returns_calendar(spark, folder):
    return panel.forward_returns_on_calendar(bars(spark, folder).select("trade_date", "ts_code", "close"))


@query("align_factor", KEY + " factor:6", uses="bars", sql=f"""
    SELECT trade_date, ts_code, CASE WHEN vol >= 30 THEN coalesce(gap / lag(gap, 2) OVER ({ORDERED}) - 1, 0) ELSE 0 END AS factor FROM bars""")
def align_factor(spark, folder):
    b = bars(spark, folder)
    factor = b.select("trade_date", "ts_code", "vol", pct_change("gap", 2).alias("factor")).where("vol >= 30").drop("vol")
    return panel.align_factor(b, factor)


@query("code_filter", KEY + " close:6", uses="bars", sql="SELECT trade_date, ts_code, close FROM bars WHERE ts_code IN ('S1', 'S3', 'S5')")
def code_filter(spark, folder):
    return bars(spark, folder).where(F.col("ts_code").isin("S1", "S3", "S5"))


@query("code_convert", "number six plain", sql="""
    SELECT CAST(k AS VARCHAR) AS number, six || CASE WHEN left(six, 1) IN ('0', '2', '3') THEN '.SZ' ELSE '.SH' END AS six, six AS plain
    FROM (SELECT k, CASE WHEN length(CAST(k AS VARCHAR)) < 6 THEN lpad(CAST(k AS VARCHAR), 6, '0') ELSE CAST(k AS VARCHAR) END AS six
          FROM (SELECT c_custkey * 661 AS k FROM customer))""")
def code_convert(spark, folder):
    n = table(spark, folder, "customer").select((F.col("c_custkey") * 661).cast("string").alias("number"))
    return n.withColumn("six", panel.exchange_code(F.col("number"))).withColumn("plain", panel.plain_code(F.col("six")))


@query("board_classify", "code board", sql="""
    SELECT code, CASE WHEN regexp_matches(code, '^(600|601|603|605)') THEN '沪市主板' WHEN regexp_matches(code, '^00[01]') THEN '深市主板'
           WHEN code LIKE '002%' THEN '中小板' WHEN regexp_matches(code, '^30[01]') THEN '创业板' WHEN code LIKE '688%' THEN '科创板'
           WHEN regexp_matches(code, '^(430|8)') THEN '北交所' ELSE '未知' END AS board
    FROM (SELECT lpad(CAST((c_custkey * 661) % 1000000 AS VARCHAR), 6, '0') AS code FROM customer)""")
def board_classify(spark, folder):
    code = F.lpad(((F.col("c_custkey") * 661) % 1000000).cast("string"), 6, "0")
    return table(spark, folder, "customer").select(code.alias("code")).withColumn("board", panel.board_of(F.col("code")))


@query("market_snapshot", KEY + " close:6 returns_1d:6 returns_5d:6 returns_20d:6 volatility_20d:6 data_rows:i", uses="rets", sql=f"""
    SELECT trade_date, ts_code, close, coalesce(ret, 0) AS returns_1d, coalesce(close / lag(close, 5) OVER w - 1, 0) AS returns_5d,
           coalesce(close / lag(close, 20) OVER w - 1, 0) AS returns_20d,
           coalesce(CASE WHEN count(ret) OVER f = 20 THEN stddev_samp(ret) OVER f * sqrt(252) END, 0) AS volatility_20d,
           count(*) OVER (PARTITION BY ts_code) AS data_rows
    FROM rets WINDOW w AS ({ORDERED}), f AS ({ORDERED} ROWS 19 PRECEDING)
    QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) = 1""")
def market_snapshot(spark, folder):
    return panel.market_snapshot(bars(spark, folder))


MASK_SQL = """SELECT *, CASE WHEN trade_date = (SELECT min(trade_date) FROM rets) THEN true
    ELSE coalesce(abs(ret) < 0.095, false) END AS tradable FROM rets"""


@query("limit_mask", KEY + " tradable:b", uses="rets", sql=MASK_SQL)
def limit_mask(spark, folder):
    return panel.limit_mask(bars(spark, folder))


@query("apply_mask", KEY + " factor:6", uses="rets", sql=f"SELECT trade_date, ts_code, CASE WHEN tradable THEN gap END AS factor FROM ({MASK_SQL})")
def apply_mask(spark, folder):
    b = bars(spark, folder)
    factor = b.select("trade_date", "ts_code", F.col("gap").alias("factor"))
    return panel.apply_mask(factor, panel.limit_mask(b), ["factor"])


@query("market_state", "trade_date:d market_ret:6 market_vol:6 market_range:6 mean_gap:6 mean_vol:6", uses="rets", sql="""
    SELECT trade_date, avg(ret) AS market_ret, stddev_samp(ret) AS market_vol, (avg(high) - avg(low)) / avg(close) AS market_range,
           coalesce(avg(gap), 0) AS mean_gap, coalesce(avg(vol), 0) AS mean_vol FROM rets GROUP BY 1""")
def market_state(spark, folder):
    return panel.market_state(returns(spark, folder), ["gap", "vol"])


@query("sequence_windows", "ts_code first_date:d last_date:d n:i checksum:4 label:6", uses="labelled", sql=f"""
    SELECT ts_code, first_date, trade_date AS last_date, 20 AS n, checksum, fwd_ret AS label FROM (
        SELECT *, row_number() OVER ({ORDERED}) AS rn, min(trade_date) OVER f AS first_date, sum(close + vol) OVER f AS checksum
        FROM labelled WINDOW f AS ({ORDERED} ROWS 19 PRECEDING)) WHERE rn >= 20 AND (rn - 20) % 10 = 0""")
def sequence_windows(spark, folder):
    b = bars(spark, folder)
    lead5 = F.lead("close", 5).over(panel.SERIES.ordered) / F.col("close") - 1
    seqs = panel.sequence_windows(b.withColumn("fwd_ret", lead5), ["close", "vol"], "fwd_ret")
    total = F.aggregate(F.flatten("sequence"), F.lit(0.0), lambda a, v: a + v)
    return seqs.withColumns({"n": F.size("sequence"), "checksum": total})


# -- joins and set operations ---------------------------------------------------------------------


@query("join_intersection", KEY + " gap:6 ret:6", uses="rets",
       sql="SELECT trade_date, ts_code, gap, ret FROM rets WHERE gap IS NOT NULL AND ret IS NOT NULL AND vol < 60")
def join_intersection(spark, folder):
    b = returns(spark, folder)
    factor = b.where("vol < 60").select("trade_date", "ts_code", "gap")
    return factor.join(b.select("trade_date", "ts_code", "ret"), panel.KEYS).dropna()


@query("join_three_way", KEY + " gap:6 industry amount:2", uses="bars",
       sql="SELECT trade_date, ts_code, gap, industry, amount FROM bars WHERE gap IS NOT NULL AND amount > 500")
def join_three_way(spark, folder):
    b = bars(spark, folder)
    caps = b.where("amount > 500").select("trade_date", "ts_code", "amount")
    factor = b.select("trade_date", "ts_code", "gap").dropna()
    return factor.join(security_dim(spark, folder), "ts_code").join(caps, panel.KEYS)


@query("join_left_align", KEY + " signal:6", uses="bars",
       sql="SELECT trade_date, ts_code, CASE WHEN vol > 40 THEN close END AS signal FROM bars")
def join_left_align(spark, folder):
    b = bars(spark, folder)
    signal = b.where("vol > 40").select("trade_date", "ts_code", F.col("close").alias("signal"))
    return panel.align_factor(b, signal, fill=None)


@query("join_factor_label", KEY + " vol:2 fwd_ret:6", uses="labelled",
       sql="SELECT trade_date, ts_code, vol, fwd_ret FROM labelled WHERE fwd_ret IS NOT NULL")
def join_factor_label(spark, folder):
    b = bars(spark, folder)
    labels = panel.forward_returns(b, (5,)).select("trade_date", "ts_code", F.col("ret_5d").alias("fwd_ret"))
    return b.select("trade_date", "ts_code", "vol").join(labels, panel.KEYS).dropna(subset=["fwd_ret"])


@query("join_industry", KEY + " industry", uses="bars", sql="""
    SELECT trade_date, ts_code, CASE WHEN industry IN ('ASIA', 'EUROPE') THEN industry ELSE '未知' END AS industry FROM bars""")
def join_industry(spark, folder):
    known = security_dim(spark, folder).where(F.col("industry").isin("ASIA", "EUROPE"))
    return bars(spark, folder).join(known, "ts_code", "left").withColumn(
        "industry", F.coalesce("industry", F.lit(panel.UNKNOWN_BOARD)))


@query("join_semi", KEY + " close:6", uses="bars",
       sql="SELECT trade_date, ts_code, close FROM bars WHERE ts_code IN (SELECT ts_code FROM bars WHERE vol > 90)")
def join_semi(spark, folder):
    b = bars(spark, folder)
    return b.join(b.where("vol > 90").select("ts_code").distinct(), "ts_code", "left_semi")


@query("join_anti", KEY + " close:6", uses="bars",
       sql="SELECT trade_date, ts_code, close FROM bars WHERE ts_code NOT IN (SELECT ts_code FROM bars WHERE vol > 90)")
def join_anti(spark, folder):
    b = bars(spark, folder)
    return b.join(b.where("vol > 90").select("ts_code").distinct(), "ts_code", "left_anti")


@query("set_union_all", KEY + " close:6", uses="bars", sql=f"""{ORDER_BARS}
--
SELECT trade_date, ts_code, close FROM bars UNION ALL SELECT trade_date, ts_code, close FROM order_bars""")
def set_union_all(spark, folder):
    cols = ["trade_date", "ts_code", "close"]
    return bars(spark, folder).select(cols).unionByName(order_bars(spark, folder).select(cols))


@query("set_dedup", KEY + " close:6", sql="""
    SELECT CAST(l_shipdate AS DATE) AS trade_date, 'S' || l_suppkey AS ts_code,
           arg_min(101 + sqrt(l_extendedprice) / 20, l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey) AS close
    FROM lineitem GROUP BY 1, 2""")
def set_dedup(spark, folder):
    return bars_io.first_per_key(raw_trades(spark, folder), panel.KEYS, "seq")


@query("set_intersect", KEY, uses="bars", sql="""
    SELECT trade_date, ts_code FROM bars WHERE gap IS NOT NULL INTERSECT SELECT trade_date, ts_code FROM bars WHERE vol < 40""")
def set_intersect(spark, folder):
    b = bars(spark, folder)
    return b.where("gap is not null").select(panel.KEYS).intersect(b.where("vol < 40").select(panel.KEYS))


@query("set_except", "ts_code", uses="bars", sql=f"""{ORDER_BARS}
--
SELECT ts_code FROM order_bars EXCEPT SELECT 'C' || o_custkey FROM orders WHERE o_orderstatus = 'F'""")
def set_except(spark, folder):
    filled = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("C"), F.col("o_custkey")).alias("ts_code"))
    return order_bars(spark, folder).select("ts_code").subtract(filled)
