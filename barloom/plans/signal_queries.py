"""Queries for signals, indicator bundles, records, catalogue and dependency graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import scalar, series
from barloom.operators import catalog, panel, portfolio, records, signals
from barloom.plans.base import query
from barloom.plans.function_queries import _NUMBERED, rolled, strict
from barloom.plans.risk_queries import _STRESS
from barloom.plans.tables import TABLES
from barloom.session import materialize
from barloom.sources import store
from barloom.sources.panel_tables import bars, returns, table

KEY = "trade_date:d ts_code"
ORDERED = "PARTITION BY ts_code ORDER BY trade_date"

TABLES["numbered"] = ("bars", _NUMBERED.split("(", 1)[1].rsplit(")", 1)[0])
TABLES["rsi14"] = ("numbered", """
    WITH RECURSIVE seed AS (SELECT ts_code, avg(greatest(move, 0)) AS up, avg(greatest(-move, 0)) AS down, count(*) AS n FROM numbered WHERE rn <= 14 GROUP BY 1),
    walk AS (SELECT n.ts_code, n.rn, seed.up, seed.down FROM numbered n JOIN seed USING (ts_code) WHERE rn = 14
             UNION ALL SELECT n.ts_code, n.rn, (w.up * 13 + greatest(n.move, 0)) / 14, (w.down * 13 + greatest(-n.move, 0)) / 14
             FROM walk w JOIN numbered n ON n.ts_code = w.ts_code AND n.rn = w.rn + 1)
    SELECT n.ts_code, n.rn, CASE WHEN seed.n < 14 THEN NULL WHEN n.rn < 14 OR w.down = 0 THEN 100 - 100 / 101.0 ELSE 100 - 100 / (1 + w.up / w.down) END AS rsi
    FROM numbered n JOIN seed USING (ts_code) LEFT JOIN walk w ON w.ts_code = n.ts_code AND w.rn = n.rn""")
TABLES["macd9"] = ("numbered", """
    WITH RECURSIVE walk AS (SELECT ts_code, rn, close AS f, close AS s, CAST(0 AS DOUBLE) AS macd FROM numbered WHERE rn = 1
             UNION ALL SELECT ts_code, rn, f, s, macd * 0.8 + (f - s) * 0.2 FROM (
                 SELECT n.ts_code, n.rn, w.f * (11.0 / 13) + n.close * (2.0 / 13) AS f, w.s * (25.0 / 27) + n.close * (2.0 / 27) AS s, w.macd
                 FROM walk w JOIN numbered n ON n.ts_code = w.ts_code AND n.rn = w.rn + 1))
    SELECT ts_code, rn, macd FROM walk""")
TABLES["bundle"] = ("numbered rsi14 macd9", f"""
    SELECT trade_date, ts_code, rn, close, rsi, macd, {strict('avg(close)', 'close', 5)} AS ma5, {strict('avg(close)', 'close', 20)} AS ma20,
           {strict('avg(close)', 'close', 60)} AS ma60, {strict('avg(tr)', 'tr', 14)} AS atr, close / lag(close, 4) OVER ({ORDERED}) - 1 AS growth,
           ({strict('avg(close)', 'close', 20)}) + 2 * ({strict('stddev_samp(close)', 'close', 20)}) AS boll
    FROM (SELECT *, CASE WHEN rn > 1 THEN greatest(high - low, abs(high - lag(close) OVER ({ORDERED})), abs(low - lag(close) OVER ({ORDERED}))) END AS tr
          FROM numbered JOIN rsi14 USING (ts_code, rn) JOIN macd9 USING (ts_code, rn))""")

_VERDICT = """CASE WHEN score > 0.1 THEN 'bullish' WHEN score < -0.1 THEN 'bearish' ELSE 'neutral' END AS signal,
    round(least(abs(score) * 2 + 0.3, 0.85), 2) AS confidence"""
SIGNAL_COLS = "score:6 signal confidence:2"


def slim(spark, folder):
    return bars(spark, folder).select("trade_date", "ts_code", "high", "low", "close")


@query("technical_bundle", KEY + " RSI_14:6 MA_5:6 MA_20:6 MA_60:6 ATR_14:6 BOLL_UPPER:6 MACD:6", uses="bundle", sql="""
    SELECT trade_date, ts_code, rsi AS "RSI_14", ma5 AS "MA_5", ma20 AS "MA_20", ma60 AS "MA_60", atr AS "ATR_14", boll AS "BOLL_UPPER", macd AS "MACD" FROM bundle""")
def technical_bundle(spark, folder):
    return signals.technical_bundle(slim(spark, folder))


@query("factor_bundle", KEY + " RSI_14:6 MACD:6 MA_5:6 MA_20:6 ATR_14:6 GROWTH:6", uses="bundle", sql="""
    SELECT trade_date, ts_code, coalesce(rsi, 0) AS "RSI_14", macd AS "MACD", coalesce(ma5, 0) AS "MA_5", coalesce(ma20, 0) AS "MA_20",
           coalesce(atr, 0) AS "ATR_14", coalesce(growth, 0) AS "GROWTH" FROM bundle""")
def factor_bundle(spark, folder):
    return signals.factor_bundle(slim(spark, folder))


@query("signal_technical", "ts_code RSI_14:6 " + SIGNAL_COLS, uses="bundle", sql=f"""
    SELECT *, rsi AS "RSI_14", {_VERDICT} FROM (
        SELECT *, CASE WHEN rsi < 30 THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN rsi > 70 THEN -0.2::DOUBLE ELSE 0 END + CASE WHEN ma5 > ma20 THEN 0.1::DOUBLE ELSE 0 END
               + CASE WHEN ma5 <= ma20 THEN -0.1::DOUBLE ELSE 0 END AS score
        FROM bundle QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) = 1)""")
def signal_technical(spark, folder):
    return signals.signal_technical(signals.technical_bundle(slim(spark, folder)))


TABLES["sentiment"] = ("bars", f"""
    SELECT ts_code, CASE WHEN n >= 20 THEN vol_20d_annual END AS vol_20d_annual, CASE WHEN n >= 20 THEN vol_60d_annual END AS vol_60d_annual, CASE WHEN n >= 20 THEN vol_percentile END AS vol_percentile, CASE WHEN n >= 20 THEN var_95 END AS var_95, CASE WHEN n >= 20 THEN cvar_95 END AS cvar_95, CASE WHEN n >= 20 THEN limit_ratio_20d END AS limit_ratio_20d, CASE WHEN n >= 20 THEN trend_strength END AS trend_strength,
           CASE WHEN n < 20 THEN 'too_few_rows' ELSE 'ok' END AS status FROM (
        SELECT ts_code, count(r) AS n, stddev_pop(r) FILTER (back <= 20) * sqrt(252) AS vol_20d_annual,
               CASE WHEN count(r) >= 60 THEN stddev_pop(r) FILTER (back <= 60) * sqrt(252) END AS vol_60d_annual,
               stddev_pop(r) FILTER (back <= 20) / stddev_pop(r) AS vol_percentile,
               avg(r) FILTER (back <= 252) + stddev_samp(r) FILTER (back <= 252) * -1.6448536269514729 AS var_95,
               avg(r) FILTER (back <= 252) - stddev_samp(r) FILTER (back <= 252) * 0.10313564037537128 / 0.05 AS cvar_95,
               (count(*) FILTER (back <= 20 AND r > 0.09) - count(*) FILTER (back <= 20 AND r < -0.09)) / 20 AS limit_ratio_20d,
               CASE WHEN count(r) >= 60 THEN avg(r) FILTER (back <= 10) / stddev_pop(r) FILTER (back <= 60) ELSE 0 END AS trend_strength
        FROM (SELECT ts_code, ln(close / lag(close) OVER ({ORDERED})) AS r, row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) AS back FROM bars)
        GROUP BY 1)""")
_SENTIMENT_COLS = "ts_code vol_20d_annual:6 vol_60d_annual:6 vol_percentile:6 var_95:6 cvar_95:6 limit_ratio_20d:6 trend_strength:6 status"


@query("sentiment_features", _SENTIMENT_COLS, uses="sentiment", sql="SELECT * FROM sentiment")
def sentiment_features(spark, folder):
    return signals.sentiment_features(bars(spark, folder))


@query("signal_sentiment", "ts_code " + SIGNAL_COLS, uses="sentiment", sql=f"""
    SELECT *, {_VERDICT} FROM (SELECT *, CASE WHEN vol_percentile > 1.5 THEN -0.15::DOUBLE ELSE 0 END + CASE WHEN vol_percentile < 0.7 THEN 0.1::DOUBLE ELSE 0 END
        + CASE WHEN limit_ratio_20d > 0.05 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN limit_ratio_20d < -0.05 THEN -0.15::DOUBLE ELSE 0 END
        + CASE WHEN trend_strength > 0.5 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN trend_strength < -0.5 THEN -0.1::DOUBLE ELSE 0 END AS score FROM sentiment)""")
def signal_sentiment(spark, folder):
    return signals.signal_sentiment(signals.sentiment_features(bars(spark, folder)))


@query("signal_fundamental", "ts_code leverage:6 growth:6 roic:6 " + SIGNAL_COLS, uses="bars", sql=f"""
    SELECT *, {_VERDICT} FROM (
        SELECT *, CASE WHEN leverage < 2 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN leverage > 5 THEN -0.15::DOUBLE ELSE 0 END + CASE WHEN growth > 0.1 THEN 0.2::DOUBLE ELSE 0 END
               + CASE WHEN growth < 0 THEN -0.2::DOUBLE ELSE 0 END + CASE WHEN roic > 0.1 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN roic < 0.05 THEN -0.1::DOUBLE ELSE 0 END AS score
        FROM (SELECT ts_code, arg_max(vol / 7, trade_date) AS leverage, arg_max(g, trade_date) FILTER (g IS NOT NULL) AS growth,
                     arg_max((close - open) * 10 / open, trade_date) AS roic
              FROM (SELECT *, vol / nullif(lag(vol, 4) OVER ({ORDERED}), 0) - 1 AS g FROM bars) GROUP BY 1))""")
def signal_fundamental(spark, folder):
    b = bars(spark, folder).withColumns({
        "leverage": scalar.leverage("vol", F.lit(7.0)), "growth": scalar.growth("vol"),
        "roic": scalar.roic((F.col("close") - F.col("open")) * 10, "open")})
    return signals.signal_fundamental(b)


@query("signal_risk_review", "ts_code var_95:6 risk_level go_no_go", uses="sentiment", sql="""
    SELECT ts_code, v AS var_95, CASE WHEN v > -0.01 THEN 'low' WHEN v > -0.03 THEN 'medium' WHEN v < -0.05 THEN 'high' ELSE 'medium' END AS risk_level,
           CASE WHEN v > -0.03 THEN 'go' ELSE 'no_go' END AS go_no_go FROM (SELECT ts_code, round(var_95, 6) AS v FROM sentiment)""")
def signal_risk_review(spark, folder):
    return signals.risk_review(signals.sentiment_features(bars(spark, folder)))


@query("news_counts", "user_id:i news_count:i signal confidence:2", sql="""
    SELECT user_id, count(*) AS news_count, 'neutral' AS signal, 0.5 AS confidence FROM events GROUP BY 1""")
def news_counts(spark, folder):
    return signals.news_counts(table(spark, folder, "events"), "user_id")


@query("extract_json", "conv_id:i turn:i signal confidence:3 flags", sql=r"""
    j AS (SELECT conv_id, turn, TRY_CAST(regexp_extract(raw, '(?s)\{.*\}') AS JSON) AS j FROM (
        SELECT *, CASE WHEN role = 'user' THEN text WHEN turn % 3 = 2 THEN text || '{"signal": "bearish", "confidence": 0.4' ELSE
               text || ' ```json {"signal": "bullish", "confidence": 0.7, "reasoning": "trend", "key_metrics": {"turn": ' || turn || '}, "risk_flags": []} ``` ' || role END AS raw
        FROM conversations))
--
SELECT conv_id, turn, coalesce(json_extract_string(j, '$.signal'), 'neutral') AS signal,
       CASE WHEN json_extract_string(j, '$.signal') IS NULL THEN 0.5 ELSE CAST(json_extract_string(j, '$.confidence') AS DOUBLE) END AS confidence,
       CASE WHEN json_extract_string(j, '$.signal') IS NULL THEN 'parse_error' ELSE '' END AS flags FROM j""")
def extract_json(spark, folder):
    c = table(spark, folder, "conversations")
    good = F.concat(F.lit(' ```json {"signal": "bullish", "confidence": 0.7, "reasoning": "trend", "key_metrics": {"turn": '),
                    F.col("turn").cast("string"), F.lit('}, "risk_flags": []} ``` '), F.col("role"))
    raw = F.when(F.col("role") == "user", F.col("text")).when(
        F.col("turn") % 3 == 2, F.concat("text", F.lit('{"signal": "bearish", "confidence": 0.4'))).otherwise(F.concat("text", good))
    parsed = signals.extract_json(c.withColumn("raw", raw), "raw")
    return parsed.withColumn("flags", F.array_join("risk_flags", ","))


@query("snapshot_vector", "ts_code n:i checksum:2 first:3", uses="bundle", sql="""
    SELECT ts_code, count(*) * 3 AS n, sum(rsi + ma5 + atr) AS checksum, arg_min(rsi, rn) AS first FROM (
        SELECT * FROM bundle QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) <= 5) GROUP BY 1""")
def snapshot_vector(spark, folder):
    v = signals.snapshot_vector(signals.factor_bundle(slim(spark, folder)), ["RSI_14", "MA_5", "ATR_14"])
    total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return v.withColumns({"n": F.size("features"), "checksum": total, "first": F.col("features")[0]})


@query("stock_risk_metrics", "ts_code var_95:6 cvar_95:6 stress_max_dd:4 status", uses="rets", sql=_STRESS + """
    SELECT ts_code, CASE WHEN n >= 20 THEN m + s * -1.6448536269514729 END AS var_95, CASE WHEN n >= 20 THEN m - s * 0.10313564037537128 / 0.05 END AS cvar_95,
           CASE WHEN n >= 20 THEN worst END AS stress_max_dd, CASE WHEN n < 20 THEN 'too_few_rows' ELSE 'ok' END AS status
    FROM (SELECT ts_code, avg(ret) AS m, stddev_samp(ret) AS s, count(ret) AS n FROM rets GROUP BY 1) LEFT JOIN (SELECT ts_code, min(max_drawdown) AS worst FROM outcome GROUP BY 1) USING (ts_code)""")
def stock_risk_metrics(spark, folder):
    return signals.stock_risk_metrics(returns(spark, folder).select("ts_code", "ret"))


@query("snapshot_risk", "ts_code var_95:6 cvar_95:6 stress_max_dd:6", uses="rets", sql=f"""
    SELECT ts_code, CASE WHEN v > 0 THEN v * 1.6448536269514729 END AS var_95, CASE WHEN v > 0 THEN v * 1.6448536269514729 * 1.2 END AS cvar_95,
           greatest(-0.1, coalesce(ret, 0) * -50) AS stress_max_dd
    FROM (SELECT ts_code, ret, CASE WHEN count(ret) OVER f = 20 THEN stddev_samp(ret) OVER f * sqrt(252) END AS v FROM rets WINDOW f AS ({ORDERED} ROWS 19 PRECEDING)
          QUALIFY row_number() OVER (PARTITION BY ts_code ORDER BY trade_date DESC) = 1)""")
def snapshot_risk(spark, folder):
    return signals.snapshot_risk(panel.market_snapshot(bars(spark, folder)))


# -- records --------------------------------------------------------------------------------------


@query("knn_topk", "vec_id:i label:i distance:5", sql="""
    SELECT vec_id, label, list_sum(list_transform(list_zip(embedding, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)),
           lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) AS distance
    FROM embeddings ORDER BY distance, vec_id LIMIT 20""")
def knn_topk(spark, folder):
    e = table(spark, folder, "embeddings")
    first = e.agg(F.min_by("embedding", "vec_id")).scalar()
    return records.nearest(e, first, 20)


def decisions(spark, folder):
    """Decision records of the securities' trades."""
    lines = table(spark, folder, "lineitem")
    stamp = F.concat_ws("-", F.date_format("l_shipdate", "yyyy-MM-dd"), "l_orderkey", "l_linenumber", "l_partkey")
    return lines.select(*store.decision_record(
        F.concat(F.lit("S"), F.col("l_suppkey")), F.lit("technical"), F.col("l_returnflag"), F.col("l_linenumber"), F.col("l_linestatus"), stamp))


@query("records_by_stock", "id document", sql="""
    SELECT 'S3_technical_' || ts AS id, '股票:S3 Agent:technical 信号:' || l_returnflag || ' 置信度:' || l_linenumber || ' 分析:' || l_linestatus AS document
    FROM (SELECT *, strftime(l_shipdate, '%Y-%m-%d') || '-' || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS ts FROM lineitem WHERE l_suppkey = 3)
    ORDER BY ts DESC LIMIT 10""")
def records_by_stock(spark, folder):
    return records.by_stock(decisions(spark, folder), "S3", 10)


@query("collection_stats", "collection n:i", sql="""
    SELECT 'agent_decisions' AS collection, count(*) AS n FROM lineitem UNION ALL SELECT 'market_patterns', count(*) FROM embeddings""")
def collection_stats(spark, folder):
    e = table(spark, folder, "embeddings")
    shots = e.select(*store.snapshot_record(F.col("label").cast("string"), F.col("embedding"), F.col("vec_id").cast("string")))
    return records.collection_stats(decisions(spark, folder).unionByName(shots))


# -- catalogue: parts as factors ------------------------------------------------------------------

ENTRY_COLS = "name display_name category expression description owner created_at:2 tags"


def entries(spark, folder):
    return table(spark, folder, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey")).alias("name"), F.col("p_name").alias("display_name"), F.col("p_type").alias("category"),
        F.concat(F.lit("size > "), F.col("p_size")).alias("expression"), F.col("p_brand").alias("description"),
        F.split("p_name", " ").alias("tags"), F.lit("desk").alias("owner"), F.col("p_retailprice").alias("created_at"))


_ENTRIES = """entries AS (SELECT 'P' || p_partkey AS name, p_name AS display_name, p_type AS category, 'size > ' || p_size AS expression, p_brand AS description,
    string_split(p_name, ' ') AS tags, 'desk' AS owner, p_retailprice AS created_at FROM part)"""
_AS_TEXT = "SELECT * REPLACE (array_to_string(tags, ' ') AS tags) FROM"


def shown(df):
    return df.withColumn("tags", F.array_join("tags", " "))


@query("catalog_upsert", ENTRY_COLS, sql=f"""{_ENTRIES},
    incoming AS (SELECT 'P' || l_partkey AS name, 'sold' AS display_name, max(l_shipmode) AS category, 'qty' AS expression, 'from sales' AS description, ['sold'] AS tags, 'ops' AS owner,
                        CAST(count(*) AS DOUBLE) AS created_at FROM (SELECT *, l_returnflag AS l_shipmode FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1
                 UNION ALL SELECT 'S' || s_suppkey, s_name, 'supplier', 'acct', 'new', ['new'], 'ops', s_acctbal FROM supplier)
--
SELECT name, CASE WHEN i.owner IS NOT NULL THEN i.display_name ELSE e.display_name END AS display_name, CASE WHEN i.owner IS NOT NULL THEN i.category ELSE e.category END AS category,
       CASE WHEN i.owner IS NOT NULL THEN i.expression ELSE e.expression END AS expression, CASE WHEN i.owner IS NOT NULL THEN i.description ELSE e.description END AS description,
       coalesce(i.owner, e.owner) AS owner, coalesce(e.created_at, i.created_at) AS created_at, array_to_string(coalesce(i.tags, e.tags), ' ') AS tags
FROM entries e FULL JOIN incoming i USING (name)""")
def catalog_upsert(spark, folder):
    sold = table(spark, folder, "lineitem").where("l_returnflag = 'R'").groupBy(F.concat(F.lit("p"), F.col("l_partkey")).alias("name")).agg(
        F.max("l_returnflag").alias("category"), F.count(F.lit(1)).cast("double").alias("created_at")).withColumns({
            "display_name": F.lit("sold"), "expression": F.lit("qty"), "description": F.lit("from sales"), "tags": F.array(F.lit("sold")), "owner": F.lit("ops")})
    fresh = table(spark, folder, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey")).alias("name"), F.lit("supplier").alias("category"), F.col("s_acctbal").alias("created_at"),
        F.col("s_name").alias("display_name"), F.lit("acct").alias("expression"), F.lit("new").alias("description"), F.array(F.lit("new")).alias("tags"), F.lit("ops").alias("owner"))
    return shown(catalog.upsert(entries(spark, folder), sold.unionByName(fresh)))


@query("catalog_find", ENTRY_COLS, sql=f"{_ENTRIES}\n--\n{_AS_TEXT} entries WHERE lower(category) = 'economy' AND list_contains(list_transform(tags, lambda t: lower(t)), 'red')")
def catalog_find(spark, folder):
    return shown(catalog.find_by_tag(catalog.find_by_category(entries(spark, folder), "Economy"), "RED"))


@query("catalog_search", ENTRY_COLS, sql=f"""{_ENTRIES}
--
{_AS_TEXT} entries WHERE contains(lower(name), 'rand#1') OR contains(lower(display_name), 'rand#1') OR contains(lower(description), 'rand#1')
   OR contains(lower(expression), 'rand#1') OR len(list_filter(tags, lambda t: contains(lower(t), 'rand#1'))) > 0""")
def catalog_search(spark, folder):
    return shown(catalog.search(entries(spark, folder), "RAND#1"))


@query("catalog_facets", "facet value n:i", sql=f"""{_ENTRIES}
--
SELECT 'category' AS facet, category AS value, count(*) AS n FROM entries GROUP BY 2
UNION ALL SELECT 'tag', t, count(*) FROM (SELECT unnest(tags) AS t FROM entries) GROUP BY 2""")
def catalog_facets(spark, folder):
    return catalog.facets(entries(spark, folder))


@query("catalog_compute", KEY + " value:6", uses="bars", sql=f"SELECT trade_date, ts_code, close / lag(close, 10) OVER ({ORDERED}) - 1 AS value FROM bars")
def catalog_compute(spark, folder):
    bound = catalog.Computations()
    bound.bind("momentum_10", lambda df: df.select("trade_date", "ts_code", series.pct_change("close", 10).alias("value")))
    return bound.compute("MOMENTUM_10", bars(spark, folder))


# -- dependency graph: orders rest on customers, customers on nations, nations on regions ----------


def edges(spark, folder):
    o = table(spark, folder, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey")), F.concat(F.lit("C"), F.col("o_custkey")))
    c = table(spark, folder, "customer").select(F.concat(F.lit("C"), F.col("c_custkey")), F.concat(F.lit("N"), F.col("c_nationkey")))
    n = table(spark, folder, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey")), F.concat(F.lit("R"), F.col("n_regionkey")))
    return o.union(c).union(n).toDF("factor", "depends_on")


def trade_edges(spark, folder):
    """Nations that sell to nations: a graph with cycles."""
    sold = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_suppkey", "o_custkey").distinct()
    return sold.join(table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(
        table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.concat(F.lit("N"), F.col("s_nationkey")).alias("factor"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("depends_on")).distinct()


TABLES["edges"] = ("", """SELECT 'O' || o_orderkey AS factor, 'C' || o_custkey AS depends_on FROM orders
    UNION ALL SELECT 'C' || c_custkey, 'N' || c_nationkey FROM customer UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey FROM nation""")
_CLOSURE = """reach AS (SELECT factor, depends_on FROM edges UNION SELECT r.factor, e.depends_on FROM reach r JOIN edges e ON e.factor = r.depends_on)
--
"""


@query("deps_direct", "node n_deps:i n_dependents:i n_nodes:i n_edges:i", uses="edges", sql="""
    d AS (SELECT DISTINCT * FROM edges), n AS (SELECT factor AS node FROM d UNION SELECT depends_on FROM d)
--
SELECT node, (SELECT count(*) FROM d WHERE factor = node) AS n_deps, (SELECT count(*) FROM d WHERE depends_on = node) AS n_dependents,
       (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM d) AS n_edges FROM n""")
def deps_direct(spark, folder):
    e = edges(spark, folder)
    size = catalog.graph_size(e)
    return catalog.direct_counts(e).withColumns({"n_nodes": size.select("n_nodes").scalar(), "n_edges": size.select("n_edges").scalar()})


@query("deps_closure", "factor depends_on", uses="edges", sql=_CLOSURE + "SELECT DISTINCT factor, depends_on FROM reach WHERE factor <> depends_on")
def deps_closure(spark, folder):
    return catalog.closure(edges(spark, folder)).where("factor <> depends_on")


@query("deps_of_nodes", "seed node way", uses="edges", sql="""
    sd AS (SELECT 'O' || o_orderkey AS seed FROM orders WHERE o_orderpriority = '1-URGENT'),
    dn AS (SELECT seed, depends_on AS node FROM sd JOIN edges ON factor = seed UNION SELECT seed, depends_on FROM dn JOIN edges ON factor = node),
    su AS (SELECT 'N' || n_nationkey AS seed FROM nation WHERE n_regionkey = 1),
    up AS (SELECT seed, factor AS node FROM su JOIN edges ON depends_on = seed UNION SELECT seed, factor FROM up JOIN edges ON depends_on = node)
--
SELECT seed, node, 'down' AS way FROM dn UNION ALL SELECT seed, node, 'up' FROM up""")
def deps_of_nodes(spark, folder):
    """What the urgent orders rest on, and what rests on the nations of one region."""
    e = edges(spark, folder)
    urgent = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'").select(F.concat(F.lit("O"), F.col("o_orderkey")).alias("node"))
    region = table(spark, folder, "nation").where("n_regionkey = 1").select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("node"))
    down, up = catalog.reachable(e, urgent), catalog.reachable(e, region, up=True)
    return down.withColumn("way", F.lit("down")).unionByName(up.withColumn("way", F.lit("up")))


@query("deps_topo", "node level:i", uses="edges", sql="""
    nd AS (SELECT factor AS node FROM edges UNION SELECT depends_on FROM edges),
    up AS (SELECT node, 0 AS level FROM nd WHERE node NOT IN (SELECT factor FROM edges)
           UNION SELECT e.factor, level + 1 FROM up JOIN edges e ON e.depends_on = up.node)
--
SELECT node, max(level) AS level FROM up GROUP BY 1""")
def deps_topo(spark, folder):
    return catalog.topological_levels(edges(spark, folder)).orderBy("level", "node")


@query("deps_cycles", "node", sql="""
    te AS (SELECT DISTINCT 'N' || s_nationkey AS factor, 'N' || c_nationkey AS depends_on FROM lineitem JOIN orders ON l_orderkey = o_orderkey
           JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey),
    reach AS (SELECT factor, depends_on FROM te UNION SELECT r.factor, e.depends_on FROM reach r JOIN te e ON e.factor = r.depends_on)
--
SELECT DISTINCT factor AS node FROM reach WHERE factor = depends_on""")
def deps_cycles(spark, folder):
    return catalog.cyclic_nodes(trade_edges(spark, folder))


_BEST = """te AS (SELECT s_nationkey AS s, c_nationkey AS c, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
           JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2),
    be AS (SELECT 'N' || s AS factor, 'N' || c AS depends_on FROM te QUALIFY row_number() OVER (PARTITION BY s ORDER BY n DESC, c) <= {k}),
    reach AS (SELECT factor, depends_on FROM be UNION SELECT r.factor, e.depends_on FROM reach r JOIN be e ON e.factor = r.depends_on)"""


def best_customers(spark, folder, k):
    """Nations with the ``k`` other nations that they sell to most often: a sparse graph with few cycles."""
    sold = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(
        table(spark, folder, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pairs = sold.where("s_nationkey <> c_nationkey").groupBy("s_nationkey", "c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    best = portfolio.top_n(pairs, "n", k, ["s_nationkey"], tie="c_nationkey")
    return best.select(F.concat(F.lit("N"), F.col("s_nationkey")).alias("factor"), F.concat(F.lit("N"), F.col("c_nationkey")).alias("depends_on"))


@query("deps_components", "node component", sql=f"""{_BEST.format(k=2)}
--
SELECT a.factor AS node, min(a.depends_on) AS component FROM reach a JOIN reach b ON a.factor = b.depends_on AND a.depends_on = b.factor GROUP BY 1""")
def deps_components(spark, folder):
    return catalog.cyclic_components(best_customers(spark, folder, 2))


@query("deps_cycle_path", "place:i node", sql=f"""{_BEST.format(k=1)},
    walk AS (SELECT 0 AS place, min(factor) AS node FROM reach WHERE factor = depends_on
             UNION ALL SELECT place + 1, depends_on FROM walk JOIN be ON factor = node
             WHERE place = 0 OR node <> (SELECT min(factor) FROM reach WHERE factor = depends_on))
--
SELECT place, node FROM walk""")
def deps_cycle_path(spark, folder):
    path = catalog.cycle_path(materialize(best_customers(spark, folder, 1), "edges"))
    return spark.createDataFrame(list(enumerate(path)), "place int, node string")


@query("deps_remove", "factor depends_on", uses="edges", sql="""
    SELECT factor, depends_on FROM edges WHERE factor <> 'N3' AND depends_on <> 'N3' AND factor NOT IN (SELECT 'O' || o_orderkey FROM orders WHERE o_orderstatus = 'F')""")
def deps_remove(spark, folder):
    gone = table(spark, folder, "orders").where("o_orderstatus = 'F'").select(
        F.concat(F.lit("O"), F.col("o_orderkey")).alias("factor"), F.concat(F.lit("C"), F.col("o_custkey")).alias("depends_on"))
    return catalog.remove_edges(catalog.remove_node(edges(spark, folder), "N3"), gone)
