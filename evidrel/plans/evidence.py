"""Retrieval end to end: scan, features, ranks, selection, structured items and the package of a request."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidrel.functions import scalars as S
from evidrel.operators import packaging as P
from evidrel.operators import retrieval as R
from evidrel.operators import timeseries as X
from evidrel.operators.summary import FLAGS, analysis_summary
from evidrel.operators.summary import MARKET as P_MARKET
from evidrel.plans.catalog import judgements
from evidrel.plans.market import MACRO_ROWS, macro_rows
from evidrel.plans.registry import query, read
from evidrel.plans.search import BONUS, cover_sql, half_up
from evidrel.plans.views import AS_OF, EVIDENCE, PRICES, REQUESTS, cosine_sql, evidence, prices, requests

#: Documents of a package, and candidates that are scanned for it.
TOP = 10
CANDIDATES = max(2 * TOP, 10)

SCAN = f"""{EVIDENCE}, {REQUESTS}, {cosine_sql("concat_ws(' ', query, array_to_string(entity_names, ' '), array_to_string(keywords, ' '), array_to_string(symbols, ' '))")},
  x AS (SELECT r.* EXCLUDE (product_type), r.product_type AS wanted, e.*, round(coalesce(cosine, 0) + {BONUS}, 4) AS retrieval_score FROM requests r CROSS JOIN evidence e LEFT JOIN c ON c.query_id = r.query_id AND c.doc_id = e.doc_id
    WHERE list_contains(source_plan, source_type) AND NOT (source_type IN ('news', 'announcement', 'research_note') AND len(symbols) > 0 AND NOT list_has_any(symbols, entity_symbols))
      AND NOT (len(symbols) = 0 AND len(entity_symbols) > 0 AND CASE WHEN r.product_type IN ('stock', 'index', 'generic_market') THEN len(industry_terms) = 0 AND NOT list_contains(topic_labels, 'industry')
        WHEN r.product_type IN ('fund', 'etf') THEN list_has_any(intent_labels, ['product_info', 'trading_rule_fee']) OR list_contains(topic_labels, 'product_mechanism') ELSE false END)),
  b AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_type ORDER BY retrieval_score DESC, doc_id) AS best FROM x WHERE retrieval_score >= CASE WHEN source_type IN ('news', 'announcement') THEN 0.02 ELSE 0.05 END),
  o AS (SELECT *, CASE WHEN best = 1 THEN list_position(source_plan, source_type) ELSE 1000000 END AS place FROM b),
  k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, retrieval_score DESC, doc_id) AS position FROM o QUALIFY position <= {CANDIDATES})"""


def candidates(spark, sf):
    """The documents that each request may use, the best of each planned source first."""
    asked = requests(spark, sf)
    found = R.scan(asked, evidence(spark, sf), CANDIDATES).join(asked.select("query_id", "source_plan"), "query_id")
    return R.diversified(found, CANDIDATES).select("query_id", "doc_id", F.col("score").alias("retrieval_score"), "position")


@query("ir2_ir4_scan", f"WITH {SCAN} SELECT query_id, doc_id, retrieval_score, position FROM k")
def ir2(spark, sf):
    return candidates(spark, sf)


def any_in(words: str, text: str) -> str:
    return f"(len(list_filter({words}, lambda w: contains({text}, w))) > 0)::INT::DOUBLE"


TOPICS = "".join(f" WHEN '{k}' THEN {v}" for k, v in S.TOPIC_WORDS.items())
INTENTS = " OR ".join(f"(list_contains(intent_labels, '{k}') AND list_contains({v}, source_type))" for k, v in S.INTENT_SOURCES.items())
DAYS = f"greatest(floor((epoch({AS_OF}) - epoch(publish_time)) / 86400), 0)"
SCOPE = "CASE time_scope" + "".join(f" WHEN '{k}' THEN {v}" for k, v in S.SCOPE_DAYS.items()) + " ELSE 30 END"
GRAMS = "list_distinct([substr({0}, i, 3) FOR i IN range(1, greatest(length({0}) - 2, 1) + 1)])"
FEATURES = f"""t AS (SELECT *, title || ' ' || body AS content, {GRAMS.format('query')} AS ga, {GRAMS.format('title')} AS gb FROM k),
  f AS (SELECT query_id, doc_id, evidence_id, source_type, source_name, source_plan, title, summary, entity_symbols, retrieval_score, position, retrieval_score AS lexical_score,
    CASE WHEN query = '' OR title = '' THEN 0 ELSE {half_up('len(list_intersect(ga, gb)) / len(list_distinct(list_concat(ga, gb)))::DOUBLE')} END AS trigram_similarity,
    list_has_any(symbols, entity_symbols)::INT::DOUBLE AS entity_exact_match, {any_in('entity_names', 'content')} AS alias_match, {any_in('list_concat(keywords, entity_names)', 'title')} AS title_hit,
    CASE WHEN len(keywords) = 0 THEN 0 ELSE {half_up("len(list_filter(keywords, lambda w: contains(content, w))) / len(keywords)::DOUBLE")} END AS keyword_coverage,
    CASE WHEN len(intent_labels) = 0 THEN 0.5 WHEN {INTENTS} THEN 0.8 ELSE 0.2 END::DOUBLE AS intent_compatibility,
    CASE WHEN len(topic_labels) = 0 OR content = '' THEN 0.5 ELSE {half_up(f"len(list_filter(topic_labels, lambda l: len(list_filter(CASE l{TOPICS} END, lambda w: contains(content, w))) > 0)) / len(topic_labels)::DOUBLE")} END AS topic_compatibility,
    (product_type = wanted)::INT::DOUBLE AS product_type_match, credibility_score AS source_credibility,
    CASE WHEN publish_time IS NULL THEN 0.3 ELSE {half_up(f"greatest(0.05, exp(-0.693::DOUBLE * {DAYS} / 60))")} END AS recency_score, (source_type IN ('announcement', 'product_doc'))::INT::DOUBLE AS is_primary_disclosure,
    {half_up("least(length(content) / 5000.0::DOUBLE, 1)")} AS doc_length,
    CASE WHEN publish_time IS NULL THEN 0.3 WHEN {DAYS} <= {SCOPE} THEN 1 ELSE {half_up(f"greatest(0.1, 1 - ({DAYS} - {SCOPE}) / greatest({SCOPE}, 1)::DOUBLE * 0.5)")} END AS time_window_match,
    {any_in("list_transform(symbols, lambda s: split_part(s, '.', 1))", 'content')} AS ticker_hit FROM t)"""
NAMES = S.FEATURE_NAMES


def features(spark, sf, found=None):
    rows = (found or candidates(spark, sf)).join(evidence(spark, sf), "doc_id").join(requests(spark, sf).withColumnRenamed("product_type", "wanted"), "query_id")
    return rows.withColumns(S.ranking_features(F.expr(AS_OF)))


@query("f3_features", f"WITH {SCAN}, {FEATURES} SELECT query_id, doc_id, {', '.join(NAMES)} FROM f")
def f3(spark, sf):
    return features(spark, sf).select("query_id", "doc_id", *NAMES)


RANK = half_up("least(0.35::DOUBLE * lexical_score + 0.20::DOUBLE * title_hit + 0.15::DOUBLE * entity_exact_match + 0.10::DOUBLE * product_type_match + 0.10::DOUBLE * recency_score + 0.10::DOUBLE * source_credibility, 1.0)")
RANKED = f"""{SCAN}, {FEATURES}, w AS (SELECT *, {RANK} AS rank_score, CASE WHEN doc_id % 4 = 0 THEN 'http://x/' || doc_id END AS source_url FROM f),
  g AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_type ORDER BY (source_url IS NOT NULL)::INT DESC, (NOT contains(lower(source_name), 'seed') AND NOT starts_with(lower(source_name), 'public_'))::INT DESC, rank_score DESC, retrieval_score DESC, evidence_id) AS first FROM w WHERE retrieval_score > 0),
  s AS (SELECT * FROM (SELECT * EXCLUDE (position), row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN first = 1 THEN list_position(source_plan, source_type) ELSE 1000000 END, rank_score DESC, evidence_id) AS position FROM g) WHERE position <= {TOP})"""


def ranked(spark, sf, found=None):
    url = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("http://x/"), F.col("doc_id").cast("string")))
    base = S.baseline_rank(*map(F.col, ["lexical_score", "title_hit", "entity_exact_match", "product_type_match", "recency_score", "source_credibility"]))
    return features(spark, sf, found).withColumns({"rank_score": base, "source_url": url, "reason": P.reasons({n: F.col(n) for n in NAMES})})


def selected(spark, sf, found=None):
    return R.selected(ranked(spark, sf, found).drop("position"), TOP)


@query("ir8_t4_selected", f"WITH {RANKED} SELECT query_id, doc_id, rank_score, position FROM s")
def ir8(spark, sf):
    return selected(spark, sf).select("query_id", "doc_id", "rank_score", "position")


LIVE = ["market_api", "fundamental_sql", "industry_sql", "fund_nav", "fund_fee", "fund_redemption", "fund_profile", "index_daily", "index_valuation"]
LIVE_SQL = f"""l AS (SELECT query_id, symbols, list_sort(list_distinct(list_concat(list_filter({LIVE}, lambda s: list_contains(CASE WHEN query_id % 2 = 0 THEN list_append(source_plan, 'market_api') ELSE source_plan END, s)),
    CASE WHEN product_type IN ('etf', 'fund') AND (list_has_any(topic_labels, ['product_mechanism', 'comparison']) OR list_has_any(intent_labels, ['product_info', 'trading_rule_fee', 'peer_compare']) OR regexp_matches(query, '费率|申赎|赎回|净值|定投|机制')) THEN ['fund_nav', 'fund_fee', 'fund_profile', 'fund_redemption']
      WHEN product_type = 'index' THEN ['index_daily', 'index_valuation'] ELSE [] END))) AS live FROM requests)"""


@query("ir11_live_sources", f"WITH {REQUESTS}, {LIVE_SQL} SELECT query_id, array_to_string(live, ',') AS live FROM l")
def ir11(spark, sf):
    return live(spark, sf).select("query_id", F.array_join("live", ",").alias("live"))


def live(spark, sf):
    plan = F.when(F.col("query_id") % 2 == 0, F.array_append("source_plan", F.lit("market_api"))).otherwise(F.col("source_plan"))
    return requests(spark, sf).withColumn("live", P.live_sources(plan, F.col("product_type"), F.col("intent_labels"), F.col("topic_labels"), F.col("query")))


ITEMS = f"""{LIVE_SQL}, y AS (SELECT query_id, unnest(symbols) AS symbol, live FROM l), z AS (SELECT y.query_id, y.symbol, unnest(live) AS source_type, c_acctbal AS close, c_custkey FROM y JOIN customer ON c_custkey = CAST(substr(y.symbol, 4) AS BIGINT) + 1),
  i AS (SELECT query_id, source_type || '_' || symbol AS evidence_id, source_type, symbol, close, c_custkey FROM z WHERE NOT (starts_with(source_type, 'fund_') AND c_custkey % 3 = 0))"""


def items(spark, sf):
    """Structured rows of each request: a payload of each live source of each symbol, where the provider has one."""
    each = live(spark, sf).select("query_id", F.explode("symbols").alias("symbol"), "live")
    payload = read(spark, sf, "customer").select((F.concat(F.lit("src"), (F.col("c_custkey") - 1).cast("string"))).alias("symbol"), F.col("c_acctbal").alias("close"), "c_custkey")
    # a payload that a provider lacks is null
    given = {s: F.when(~(F.lit(s.startswith("fund_")) & (F.col("c_custkey") % 3 == 0)), F.col("close")) for s in LIVE}
    return P.expanded_items(each.join(payload, "symbol"), given)


@query("ir10_ir12_items", f"WITH {REQUESTS}, {ITEMS} SELECT query_id, evidence_id, source_type, symbol, close FROM i")
def ir12(spark, sf):
    return items(spark, sf).select("query_id", "evidence_id", "source_type", "symbol", "close")


PACKAGE = f"""WITH {RANKED}, {ITEMS}, a AS (SELECT query_id, source_type, true AS is_document, entity_symbols AS symbols FROM s UNION ALL SELECT query_id, source_type, false, [symbol] FROM i),
  e AS (SELECT query_id, {cover_sql(P.COVERAGE)} FROM a GROUP BY query_id), n AS (SELECT query_id, count(DISTINCT symbol) AS n FROM (SELECT query_id, unnest(symbols) AS symbol FROM a) GROUP BY 1),
  m AS (SELECT r.query_id, r.risk_flags, r.source_plan, e.* EXCLUDE (query_id), (list_contains(intent_labels, 'peer_compare') OR list_contains(topic_labels, 'comparison')) AND coalesce(n.n, 0) >= 2 AS comparison FROM requests r LEFT JOIN e ON e.query_id = r.query_id LEFT JOIN n ON n.query_id = r.query_id),
  d AS (SELECT query_id, count(*) AS n_documents, avg(rank_score) FILTER (WHERE position <= 3) AS top, string_agg(evidence_id, ',' ORDER BY position) FILTER (WHERE position <= 5) AS top_ranked, FROM s GROUP BY 1), q AS (SELECT query_id, count(*) AS n_candidates FROM k GROUP BY 1)
  SELECT m.query_id, coalesce(n_candidates, 0) AS n_candidates, coalesce(n_documents, 0) AS n_documents, coalesce(top_ranked, '') AS top_ranked,
    array_to_string(list_filter([CASE WHEN list_contains(risk_flags, 'out_of_scope_query') THEN 'out_of_scope_query' END, CASE WHEN list_contains(risk_flags, 'clarification_required') THEN 'clarification_required_missing_entity' END,
      CASE WHEN list_contains(source_plan, 'announcement') AND NOT coalesce(announcement, false) THEN 'announcement_not_found_recent_window' END], lambda x: x IS NOT NULL), ',') AS warnings,
    round((coalesce(top, 0) + ({' + '.join(f'coalesce({k}, false)::INT' for k in [*P.COVERAGE, 'comparison'])}) / 9.0::DOUBLE) / 2, 2) AS confidence
  FROM m LEFT JOIN d ON d.query_id = m.query_id LEFT JOIN q ON q.query_id = m.query_id"""


@query("ir9_a6_package", PACKAGE)
def ir9(spark, sf):
    found = candidates(spark, sf).persist()  # CANDIDATES rows of each request, read twice
    asked, docs, structured = requests(spark, sf), selected(spark, sf, found).persist(), items(spark, sf)
    counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_candidates"))
    return P.package(asked, docs, structured, counts).select("query_id", "n_candidates", "n_documents", "top_ranked", F.array_join("warnings", ",").alias("warnings"), "confidence")


#: Items of a request: market and index rows of its symbols (the price series of one of five order priorities), fundamentals of
#: parts, and for every third request the indicators of one of eight groups of suppliers.
SUMMARY_ITEMS = f"""{PRICES}, ser AS (SELECT symbol, trade_date, close, lag(close) OVER (PARTITION BY symbol ORDER BY trade_date) AS before, row_number() OVER (PARTITION BY symbol ORDER BY trade_date DESC) AS r FROM prices),
  last AS (SELECT symbol AS series, trade_date, close, CASE WHEN before <> 0 THEN round((close - before) / before * 100, 4) END AS pct, row_number() OVER (ORDER BY symbol) - 1 AS k FROM ser WHERE r = 1),
  sy AS (SELECT query_id, s AS symbol, CAST(substr(s, 4) AS BIGINT) AS k, n FROM (SELECT query_id, unnest(symbols) AS s, generate_subscripts(symbols, 1) AS n FROM requests)),
  it AS (SELECT query_id, n * 10 AS ord, 'market_api' AS source_type, symbol, trade_date, close, pct, NULL::DOUBLE AS pe, NULL AS code, NULL::DOUBLE AS v FROM sy JOIN last ON last.k = sy.k % 5 WHERE sy.k % 2 = 0
    UNION ALL SELECT query_id, n * 10 + 1, 'index_daily', symbol, trade_date, close, pct, NULL, NULL, NULL FROM sy JOIN last ON last.k = sy.k % 5 WHERE sy.k % 3 <> 1
    UNION ALL SELECT query_id, n * 10 + 2, 'fundamental_sql', symbol, NULL, NULL, NULL, CASE WHEN p_partkey % 7 <> 0 THEN p_size - 3 END, NULL, NULL FROM sy JOIN part ON p_partkey = sy.k
    UNION ALL SELECT query_id, 1000 + s_suppkey, 'macro_sql', NULL, NULL, NULL, NULL, NULL, code, v FROM requests JOIN d ON s_suppkey % 8 = query_id % 8 AND query_id % 3 = 0)"""


def summary_items(spark, sf):
    last = X.latest(X.fill_pct_change(X.usable(prices(spark, sf)).withColumn("pct_change_1d", F.lit(None).cast("double")))).select("symbol", "trade_date", "close", "pct_change_1d")
    numbers = W.orderBy("symbol")  # the last rows of the five order priorities
    last = last.withColumn("k", F.row_number().over(numbers) - 1).drop("symbol")
    each = requests(spark, sf).select("query_id", F.posexplode("symbols").alias("n", "symbol")).withColumn("id", F.substring("symbol", 4, 20).cast("long"))
    none = {"trade_date": "string", "close": "double", "pct_change_1d": "double", "report_date": "string", "pe_ttm": "double", "pb": "double", "roe": "double", "indicator_code": "string", "metric_value": "double"}

    def rows(df, source, ord_, **more):
        given = {c: F.lit(None).cast(t) for c, t in none.items() if c not in more}
        return df.select("query_id", ord_.cast("long").alias("ord"), F.lit(source).alias("source_type"), (F.col("symbol") if "symbol" in df.columns else F.lit(None).cast("string")).alias("symbol"), F.lit(None).cast("string").alias("canonical_name"), F.lit(source in P_MARKET).alias("analysed"), *[(more.get(c) if c in more else given[c]).cast(t).alias(c) for c, t in none.items()])

    priced = each.join(last, F.pmod("id", F.lit(5)) == F.col("k"))
    price = {c: F.col(c) for c in ("trade_date", "close", "pct_change_1d")}
    parts = each.join(read(spark, sf, "part").select("p_partkey", "p_size"), F.col("id") == F.col("p_partkey"))
    macro = requests(spark, sf).where("query_id % 3 = 0").select("query_id").join(macro_rows(spark, sf), F.col("s_suppkey") % 8 == F.col("query_id") % 8)
    out = rows(priced.where("id % 2 = 0"), "market_api", (F.col("n") + 1) * 10, **price).unionByName(rows(priced.where("id % 3 != 1"), "index_daily", (F.col("n") + 1) * 10 + 1, **price))
    out = out.unionByName(rows(parts, "fundamental_sql", (F.col("n") + 1) * 10 + 2, pe_ttm=F.when(F.col("p_partkey") % 7 != 0, F.col("p_size") - 3)))
    return out.unionByName(rows(macro, "macro_sql", F.col("s_suppkey") + 1000, indicator_code=F.col("code"), metric_value=F.col("v")))


@query("a8_analysis_summary", f"""WITH {EVIDENCE}, {REQUESTS}, {MACRO_ROWS}, {SUMMARY_ITEMS},
  m1 AS (SELECT query_id, symbol, min(ord) AS first, arg_max({{'symbol': symbol, 'trade_date': trade_date, 'close': close, 'pct': pct}}, CASE WHEN source_type = 'market_api' THEN 1000000 + ord ELSE -ord END) AS s FROM it WHERE source_type IN ('market_api', 'index_daily') GROUP BY 1, 2),
  m2 AS (SELECT query_id, count(*) AS n_market, string_agg(s.symbol || ':' || s.trade_date || ':' || round(s.close, 2), ',' ORDER BY first) AS market FROM m1 GROUP BY 1),
  f1 AS (SELECT query_id, count(*) AS n_fundamental, string_agg(symbol || ':' || CASE WHEN pe IS NULL OR pe <= 0 THEN 'unknown' WHEN pe < 15 THEN 'potentially_undervalued' WHEN pe > 40 THEN 'potentially_overvalued' ELSE 'fair_range' END, ',' ORDER BY ord) AS fundamental FROM it WHERE source_type = 'fundamental_sql' GROUP BY 1),
  c1 AS (SELECT query_id, string_agg(code || ':' || CASE WHEN it.v IS NULL THEN 'unknown' ELSE direction END, ',' ORDER BY ord) AS macro, count(*) FILTER (WHERE direction IN ('expansion', 'expansionary', 'rising')) AS u, count(*) FILTER (WHERE direction IN ('contraction', 'tightening', 'deflationary', 'falling')) AS w
    FROM it JOIN (SELECT s_suppkey, direction FROM d) g ON g.s_suppkey = it.ord - 1000 WHERE source_type = 'macro_sql' GROUP BY 1),
  h AS (SELECT query_id, bool_or(source_type IN ('market_api', 'index_daily', 'fund_nav')) AS p, bool_or(source_type = 'fundamental_sql') AS f, bool_or(source_type = 'macro_sql') AS m FROM it GROUP BY 1),
  nw AS (SELECT item_id AS query_id, bool_or(source_type = 'news') AS news FROM benchmark JOIN evidence ON contains(body, text) GROUP BY 1)
  SELECT r.query_id, coalesce(n_market, 0) AS n_market, market, coalesce(n_fundamental, 0) AS n_fundamental, fundamental, macro, CASE WHEN macro IS NULL THEN NULL WHEN u > w THEN 'expansionary' WHEN w > u THEN 'contractionary' ELSE 'mixed' END AS overall,
    coalesce(p, false) AS has_price_data, coalesce(f, false) AS has_fundamentals, coalesce(m, false) AS has_macro, coalesce(news, false) AS has_news, coalesce(p, false) AS has_technical_indicators,
    array_to_string(list_sort(intent_labels), ',') AS intents, array_to_string(list_sort(topic_labels), ',') AS topics
  FROM requests r LEFT JOIN m2 USING (query_id) LEFT JOIN f1 USING (query_id) LEFT JOIN c1 USING (query_id) LEFT JOIN h USING (query_id) LEFT JOIN nw USING (query_id)""")
def a8(spark, sf):
    """Signals and readiness of every request; its documents are those that hold its whole text."""
    docs = judgements(spark, sf).join(evidence(spark, sf).select("doc_id", "source_type"), "doc_id")
    out = analysis_summary(requests(spark, sf), summary_items(spark, sf), docs, ["trade_date", "close", "pct_change_1d"])
    line = lambda c, *fields: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: F.concat_ws(":", *[f(x) for f in fields])), ","))
    field = lambda n: lambda x: x[n].cast("string")
    count = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0)).cast("long")
    return out.select(
        "query_id", count("market").alias("n_market"), line("market", field("symbol"), field("trade_date"), lambda x: F.round(x["close"], 2).cast("string")).alias("market"), count("fundamental").alias("n_fundamental"),
        line("fundamental", field("symbol"), field("valuation_assessment")).alias("fundamental"), line("indicators", field("indicator_code"), field("direction")).alias("macro"), "overall", *FLAGS,
        F.array_join("relevant_intents", ",").alias("intents"), F.array_join("relevant_topics", ",").alias("topics"),
    )
