"""Time-series and structured-lookup queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidrel.functions import scalars as S
from evidrel.operators import tables as T
from evidrel.operators import timeseries as X
from evidrel.plans.registry import query, read
from evidrel.plans.views import PRICES, prices

KEY = ["symbol", "trade_date"]


@query("w1_sma", f"""WITH {PRICES} SELECT symbol, trade_date,
  CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY trade_date ROWS 4 PRECEDING) = 5 THEN round(avg(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS 4 PRECEDING), 4) END AS ma5,
  CASE WHEN count(*) OVER (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING) = 20 THEN round(avg(close) OVER (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING), 4) END AS ma20 FROM prices""")
def w1(spark, sf):
    return X.usable(prices(spark, sf)).select(*KEY, X.sma(5).alias("ma5"), X.sma(20).alias("ma20"))


@query("w2_returns", f"""WITH {PRICES}, l AS (SELECT symbol, trade_date, close, lag(close, 3) OVER w AS a, lag(close, 5) OVER w AS b, lag(close, 10) OVER w AS c, lag(close, 20) OVER w AS d FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY trade_date))
  SELECT symbol, trade_date, round((close - a) / abs(a) * 100, 4) AS pct_3d, round((close - b) / abs(b) * 100, 4) AS pct_5d, round((close - c) / abs(c) * 100, 4) AS pct_10d, round((close - d) / abs(d) * 100, 4) AS pct_20d FROM l""")
def w2(spark, sf):
    return X.usable(prices(spark, sf)).select(*KEY, *[X.n_day_return(n).alias(f"pct_{n}d") for n in X.RETURN_DAYS])


@query("w3_rsi", f"""WITH {PRICES}, d AS (SELECT symbol, trade_date, close - lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS delta FROM prices),
  s AS (SELECT symbol, trade_date, count(delta) OVER w AS n, sum(greatest(delta, 0)) OVER w / 14 AS g, sum(greatest(-delta, 0)) OVER w / 14 AS l FROM d WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS 13 PRECEDING))
  SELECT symbol, trade_date, CASE WHEN n = 14 THEN CASE WHEN g = 0 AND l = 0 THEN 50 WHEN l = 0 THEN 100 ELSE round(100 - 100 / (1 + g / l), 2) END END AS rsi_14 FROM s""")
def w3(spark, sf):
    return X.with_changes(X.usable(prices(spark, sf))).select(*KEY, X.rsi().alias("rsi_14"))


MACD_SQL = f"""WITH {PRICES}, h AS (SELECT symbol, list(close ORDER BY trade_date) AS c FROM prices GROUP BY symbol),
  e AS (SELECT symbol, c, len(c) AS n, [list_reduce(list_concat([list_avg(c[1:12])], c[13:len(c) - k]), lambda a, x: (x - a) * (2.0::DOUBLE / 13) + a) FOR k IN range(0, least(9, len(c) - 25))] AS f,
    [list_reduce(list_concat([list_avg(c[1:26])], c[27:len(c) - k]), lambda a, x: (x - a) * (2.0::DOUBLE / 27) + a) FOR k IN range(0, least(9, len(c) - 25))] AS s FROM h WHERE len(c) >= 26),
  v AS (SELECT symbol, round(f[1], 4) AS ema12, round(s[1], 4) AS ema26, [round(f[i], 4) - round(s[i], 4) FOR i IN range(1, len(f) + 1)] AS m FROM e)
  SELECT symbol, ema12, ema26, round(ema12 - ema26, 4) AS macd_line, round(list_avg(m), 4) AS signal_line, round(round(ema12 - ema26, 4) - round(list_avg(m), 4), 4) AS histogram FROM v"""


@query("w4_w5_ema_macd", MACD_SQL)
def w5(spark, sf):
    return X.latest_macd(prices(spark, sf)).where("macd_line is not null")


@query("w6_volatility", f"""WITH {PRICES}, l AS (SELECT symbol, trade_date, close, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS p FROM prices),
  r AS (SELECT symbol, trade_date, CASE WHEN p <> 0 THEN (close - p) / abs(p) END AS ret FROM l)
  SELECT symbol, trade_date, CASE WHEN count(ret) OVER w = 20 THEN round(stddev_samp(ret) OVER w * sqrt(252) * 100, 2) END AS volatility_20d FROM r WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING)""")
def w6(spark, sf):
    return X.with_changes(X.usable(prices(spark, sf))).select(*KEY, X.volatility().alias("volatility_20d"))


@query("w7_bollinger", f"""WITH {PRICES}, b AS (SELECT symbol, trade_date, count(*) OVER w AS n, avg(close) OVER w AS m, stddev_pop(close) OVER w AS s FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING))
  SELECT symbol, trade_date, round(m + 2 * s, 4) AS boll_upper, round(m, 4) AS boll_middle, round(m - 2 * s, 4) AS boll_lower, round(4 * s / m * 100, 4) AS boll_bandwidth FROM b WHERE n = 20""")
def w7(spark, sf):
    return X.indicators(prices(spark, sf)).where("boll_middle is not null").select(*KEY, "boll_upper", "boll_middle", "boll_lower", "boll_bandwidth")


TREND_SQL = f"""WITH {PRICES}, d AS (SELECT symbol, trade_date, close, close - lag(close) OVER w AS delta, lag(close, 5) OVER w AS b5 FROM prices WINDOW w AS (PARTITION BY symbol ORDER BY trade_date)),
  s AS (SELECT symbol, trade_date, close, CASE WHEN count(*) OVER w5 = 5 THEN round(avg(close) OVER w5, 4) END AS ma5, CASE WHEN count(*) OVER w20 = 20 THEN round(avg(close) OVER w20, 4) END AS ma20,
    count(delta) OVER w14 AS n, sum(greatest(delta, 0)) OVER w14 / 14 AS g, sum(greatest(-delta, 0)) OVER w14 / 14 AS l, round((close - b5) / abs(b5) * 100, 4) AS p5 FROM d
    WINDOW w5 AS (PARTITION BY symbol ORDER BY trade_date ROWS 4 PRECEDING), w20 AS (PARTITION BY symbol ORDER BY trade_date ROWS 19 PRECEDING), w14 AS (PARTITION BY symbol ORDER BY trade_date ROWS 13 PRECEDING)),
  r AS (SELECT *, CASE WHEN n = 14 THEN CASE WHEN g = 0 AND l = 0 THEN 50 WHEN l = 0 THEN 100 ELSE round(100 - 100 / (1 + g / l), 2) END END AS rsi FROM s),
  v AS (SELECT *, coalesce(close > ma5, false)::INT + coalesce(close > ma20, false)::INT + coalesce(ma5 > ma20, false)::INT + coalesce(rsi > 60, false)::INT + coalesce(p5 > 2, false)::INT AS up,
    coalesce(close < ma5, false)::INT + coalesce(close < ma20, false)::INT + coalesce(ma5 < ma20, false)::INT + coalesce(rsi < 40, false)::INT + coalesce(p5 < -2, false)::INT AS down FROM r)
  SELECT symbol, trade_date, close > ma5 AS above_ma5, close > ma20 AS above_ma20, CASE WHEN up >= 3 THEN 'bullish' WHEN down >= 3 THEN 'bearish' ELSE 'neutral' END AS trend_signal FROM v WHERE ma20 IS NOT NULL"""


@query("w8_w9_trend", TREND_SQL)
def w9(spark, sf):
    return X.indicators(prices(spark, sf)).where("ma20 is not null").select(*KEY, "above_ma5", "above_ma20", "trend_signal")


@query("w10_latest_row", f"WITH {PRICES} SELECT symbol, trade_date, close FROM prices QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) = 1")
def w10(spark, sf):
    return X.latest(prices(spark, sf))


@query("w11_last_history", f"""WITH {PRICES}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS n FROM prices)
  SELECT symbol, n::INT AS nth, trade_date, close FROM r WHERE n <= 5""")
def w11(spark, sf):
    h = X.last_history(prices(spark, sf))
    return h.select("symbol", F.posexplode("history").alias("nth", "x")).select("symbol", (F.col("nth") + 1).alias("nth"), "x.trade_date", "x.close")


@query("lc3_w12_pct_change", f"""WITH {PRICES}, l AS (SELECT symbol, trade_date, close, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS p FROM prices)
  SELECT symbol, trade_date, CASE WHEN CAST(substr(trade_date, 9, 2) AS INT) % 3 = 0 THEN 0.5 WHEN p <> 0 THEN round((close - p) / p * 100, 4) END AS pct_change_1d FROM l""")
def w12(spark, sf):
    given = prices(spark, sf).withColumn("pct_change_1d", F.when(F.substring("trade_date", 9, 2).cast("int") % 3 == 0, F.lit(0.5)))
    return X.fill_pct_change(given).select(*KEY, "pct_change_1d")


@query("w13_signal_priority", """WITH r AS (SELECT user_id AS symbol, event_id AS ord, CASE WHEN event_id % 3 = 0 THEN 'market_api' ELSE 'index_daily' END AS source_type FROM events)
  SELECT symbol, source_type, CASE WHEN source_type = 'market_api' THEN max(ord) ELSE min(ord) END AS ord FROM r
  WHERE source_type = 'market_api' OR symbol NOT IN (SELECT symbol FROM r WHERE source_type = 'market_api') GROUP BY symbol, source_type""")
def w13(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("symbol"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 3 == 0, "market_api").otherwise("index_daily").alias("source_type"))
    return X.signal_priority(e).select("symbol", "source_type", "ord")


@query("w14_ordinal_suffix", """SELECT p_partkey, CASE WHEN n = 1 THEN p_name ELSE p_name || '_' || n END AS p_name FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS n FROM part)""")
def w14(spark, sf):
    return T.with_ordinal_suffix(read(spark, sf, "part").select("p_partkey", "p_name"), "p_name", "p_partkey")


@query("w15_adjacent_pairs", "SELECT item_id, text || ' ' || lead(text) OVER (ORDER BY item_id) AS mixed FROM benchmark")
def w15(spark, sf):
    return T.adjacent(read(spark, sf, "benchmark"), "item_id", "text").select("item_id", F.concat("text", F.lit(" "), "following").alias("mixed"))


@query("w16_positional_split", "SELECT item_id, CASE WHEN i % 10 < 2 THEN 'test' WHEN i % 10 < 4 THEN 'valid' ELSE 'train' END AS split FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark)")
def w16(spark, sf):
    return T.positional_split(read(spark, sf, "benchmark").select("item_id"), "item_id")


@query("w17_first_per_key", "SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY lang, source")
def w17(spark, sf):
    return T.first_by(read(spark, sf, "documents").select("doc_id", "lang", "source"), ["lang", "source"], "doc_id")


@query("f10_valuation", """SELECT p_partkey, CASE WHEN pe IS NULL OR pe <= 0 THEN 'unknown' WHEN pe < 15 THEN 'potentially_undervalued' WHEN pe > 40 THEN 'potentially_overvalued' ELSE 'fair_range' END AS valuation
  FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size - 3 END AS pe FROM part)""")
def f10(spark, sf):
    pe = F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") - 3)
    return read(spark, sf, "part").select("p_partkey", S.valuation(pe).alias("valuation"))


MACRO_ROWS = """m AS (SELECT s_suppkey, ['CPI_CN', 'PMI_CN', 'M2_CN', 'CN10Y', 'GDP'][CAST(s_suppkey % 5 AS INT) + 1] AS code, CASE WHEN s_suppkey % 11 = 0 THEN NULL ELSE s_acctbal / 200 END AS v FROM supplier),
  d AS (SELECT s_suppkey, code, v, CASE WHEN v IS NULL THEN 'unknown' WHEN code = 'CPI_CN' THEN CASE WHEN v > 2.5 THEN 'inflationary' WHEN v < 0.5 THEN 'deflationary' ELSE 'stable' END WHEN code = 'PMI_CN' THEN CASE WHEN v > 50 THEN 'expansion' ELSE 'contraction' END
    WHEN code = 'M2_CN' THEN CASE WHEN v > 10 THEN 'expansionary' WHEN v < 8 THEN 'tightening' ELSE 'moderate' END WHEN code = 'CN10Y' THEN CASE WHEN v > 3 THEN 'rising' WHEN v < 2.5 THEN 'falling' ELSE 'stable' END ELSE 'unknown' END AS direction FROM m)"""


def macro_rows(spark, sf):
    s = read(spark, sf, "supplier")
    code = F.element_at(F.array(*map(F.lit, ["CPI_CN", "PMI_CN", "M2_CN", "CN10Y", "GDP"])), (F.col("s_suppkey") % 5).cast("int") + 1)
    s = s.select("s_suppkey", code.alias("code"), F.when(F.col("s_suppkey") % 11 != 0, F.col("s_acctbal") / 200).alias("v"))
    return s.withColumn("direction", S.macro_direction(F.col("code"), F.col("v")))


@query("f11_macro_direction", f"WITH {MACRO_ROWS} SELECT s_suppkey, code, direction FROM d")
def f11(spark, sf):
    return macro_rows(spark, sf).select("s_suppkey", "code", "direction")


@query("a7_macro_overall", f"""WITH {MACRO_ROWS}, c AS (SELECT s_suppkey % 8 AS g, count(*) FILTER (WHERE direction IN ('expansion', 'expansionary', 'rising')) AS u, count(*) FILTER (WHERE direction IN ('contraction', 'tightening', 'deflationary', 'falling')) AS w FROM d GROUP BY 1)
  SELECT g, CASE WHEN u > w THEN 'expansionary' WHEN w > u THEN 'contractionary' ELSE 'mixed' END AS overall FROM c""")
def a7(spark, sf):
    return macro_rows(spark, sf).groupBy((F.col("s_suppkey") % 8).alias("g")).agg(S.macro_overall(F.collect_list("direction")).alias("overall"))


@query("t9_latest_three", "SELECT s_suppkey, s_name FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 3")
def t9(spark, sf):
    return read(spark, sf, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(3).select("s_suppkey", "s_name")


@query("j1_j5_keyed_lookup", "SELECT c.c_custkey, n.n_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE c.c_mktsegment IN ('BUILDING', 'MACHINERY')")
def j1(spark, sf):
    c = read(spark, sf, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return c.join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


@query("j2_two_hop", "SELECT DISTINCT c.c_mktsegment, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey")
def j2(spark, sf):
    n, r = read(spark, sf, "nation"), read(spark, sf, "region")
    c = read(spark, sf, "customer").select("c_mktsegment", "c_nationkey").distinct()
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("c_mktsegment", "r_name").distinct()


MATCH_SQL = """WITH q AS (SELECT item_id, upper(text) AS t FROM benchmark), h AS (SELECT q.item_id, n.n_name FROM q JOIN nation n ON contains(q.t, substr(n.n_name, 1, 3)))
  SELECT * FROM h UNION ALL SELECT q.item_id, n.n_name FROM q, nation n WHERE q.item_id NOT IN (SELECT item_id FROM h)"""


@query("j3_j4_match_or_all", MATCH_SQL)
def j4(spark, sf):
    q = read(spark, sf, "benchmark").select("item_id", F.upper("text").alias("t"))
    items = read(spark, sf, "nation").select("n_name")
    return T.match_or_all(q, items, F.contains(F.col("t"), F.substring(F.col("n_name"), 1, 3)), "item_id").select("item_id", "n_name")


@query("j6_outer_chain", """SELECT c.c_custkey, list_sort(list(o.o_orderpriority) FILTER (WHERE o.o_orderpriority IS NOT NULL)) AS priorities FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey""".replace("list_sort(", "coalesce(list_sort(").replace("IS NOT NULL))", "IS NOT NULL)), [])"))
def j6(spark, sf):
    o = read(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderpriority")).alias("priorities"))
    c = read(spark, sf, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", F.coalesce("priorities", F.array().cast("array<string>")).alias("priorities"))


@query("j9_live_over_seed", """WITH live AS (SELECT s_suppkey AS k, 'live' AS origin FROM supplier WHERE s_suppkey % 3 = 0), failed AS (SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 3 = 1)
  SELECT * FROM live UNION ALL SELECT s_suppkey, 'seed' FROM supplier WHERE s_suppkey NOT IN (SELECT k FROM live) AND s_suppkey NOT IN (SELECT k FROM failed)""")
def j9(spark, sf):
    s = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    live, failed = s.where("k % 3 = 0").withColumn("origin", F.lit("live")), s.where("k % 3 = 1")
    return T.spread_anti_join(s.withColumn("origin", F.lit("seed")), live, failed, "k")


@query("j12_alias_join", "SELECT p.p_partkey, s.s_name FROM part p JOIN supplier s ON p.p_partkey % 200 = s.s_suppkey")
def j12(spark, sf):
    return read(spark, sf, "part").join(read(spark, sf, "supplier"), F.col("p_partkey") % 200 == F.col("s_suppkey")).select("p_partkey", "s_name")


NUMBERS = """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN '1,234.5%' WHEN 1 THEN '-' WHEN 2 THEN ' 12.50 ' WHEN 3 THEN 'abc' ELSE CAST(l_linenumber AS VARCHAR) END AS t FROM lineitem WHERE l_orderkey < 2000"""


def numbers(spark, sf):
    t = F.when(F.col("l_linenumber") % 5 == 0, "1,234.5%").when(F.col("l_linenumber") % 5 == 1, "-").when(F.col("l_linenumber") % 5 == 2, " 12.50 ").when(F.col("l_linenumber") % 5 == 3, "abc").otherwise(F.col("l_linenumber").cast("string"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", t.alias("t"))


@query("f12_lc24_numbers", """SELECT l_orderkey, l_linenumber, CASE l_linenumber % 5 WHEN 0 THEN 1234.5 WHEN 2 THEN 12.5 WHEN 4 THEN l_linenumber END::DOUBLE AS tolerant, CASE l_linenumber % 5 WHEN 0 THEN 1234.5 WHEN 2 THEN 12.5 WHEN 4 THEN l_linenumber END::DOUBLE AS clean FROM lineitem""")
def f12(spark, sf):
    return numbers(spark, sf).select("l_orderkey", "l_linenumber", S.tolerant_float(F.col("t")).alias("tolerant"), S.clean_number(F.col("t")).alias("clean"))


@query("lc23_dates", """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 2 THEN strftime(o_orderdate, '%Y-%m-01') WHEN 3 THEN 'unknown da' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders""")
def lc23(spark, sf):
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    t = F.when(k == 0, F.date_format(d, "yyyy/MM/dd")).when(k == 1, F.date_format(d, "yyyyMMdd")).when(k == 2, F.date_format(d, "yyyy-MM")).otherwise("unknown date")
    return read(spark, sf, "orders").select("o_orderkey", S.tolerant_date(t).alias("d"))


@query("lc5_lc6_fallback_chain", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'first' WHEN p_size % 3 = 0 THEN 'second' ELSE 'third' END AS provider FROM part""")
def lc5(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", "p_size")
    rows = p.where("p_size % 2 = 0").selectExpr("p_partkey", "1 rank", "'first' provider").unionByName(p.where("p_size % 3 = 0").selectExpr("p_partkey", "2 rank", "'second' provider")).unionByName(p.selectExpr("p_partkey", "3 rank", "'third' provider"))
    return T.first_by(rows, ["p_partkey"], "rank").select("p_partkey", "provider")


@query("lc7_filter_or_all", """WITH t AS (SELECT c_mktsegment, c_custkey, c_nationkey = 7 AS hit FROM customer) SELECT c_mktsegment, c_custkey FROM t WHERE hit OR c_mktsegment NOT IN (SELECT c_mktsegment FROM t WHERE hit)""")
def lc7(spark, sf):
    c = read(spark, sf, "customer").select("c_mktsegment", "c_custkey", (F.col("c_nationkey") == 7).alias("hit"))
    some = c.groupBy("c_mktsegment").agg(F.bool_or("hit").alias("some"))
    return c.join(some, "c_mktsegment").where("hit or not some").select("c_mktsegment", "c_custkey")


@query("lc9_lc10_latest_by", "SELECT o_custkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1")
def lc9(spark, sf):
    return read(spark, sf, "orders").groupBy("o_custkey").agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


@query("lc13_lc15_key_value_pivot", """SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY user_id""")
def lc13(spark, sf):
    e = read(spark, sf, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.count(F.lit(1)))
    return e.select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("click", "view", "purchase")])
