"""Weak labels, comparison targets, search terms and prepared documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidrel.functions import labels as L
from evidrel.functions import scalars as S
from evidrel.operators import preparation as P
from evidrel.operators import understanding as U
from evidrel.plans.language import ZH
from evidrel.plans.registry import query, read
from evidrel.plans.views import EVIDENCE, REQUESTS, evidence, requests

SAMPLES = ZH + [
    "茅台和五粮液估值哪个好", "招商银行与平安银行相比怎么样", "它和茅台比", "跟黄金风险谁更稳", "券商板块还能买吗", "在中国银行开户", "买 白酒 好吗", "中国银行行业", "成长指数怎么样",
    "降准对债市的影响", "lpr 利率", "CPI 和 PMI 数据", "qwertyui", "原标题：茅台大跌？后市如何", "短？这是很长的一句话？end", "should i buy this stock now", "hotel price",
    "买 suv 预算多少", "研报 评级 目标价", "Q&A about fund redemption", "沪深300 指数 估值", "中国央行 降息", " earnings of the sector! What next? ", "今天 股价 为什么 跌", "估值",
]
ROWS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(SAMPLES))
#: The samples and the whole texts of documents and benchmark.
TEXTS = f"texts AS (SELECT id::BIGINT AS id, t FROM (VALUES {ROWS}) v(id, t) UNION ALL SELECT doc_id + 1000, text FROM documents UNION ALL SELECT -item_id - 1, text FROM benchmark)"


def samples(spark):
    return spark.createDataFrame(list(enumerate(SAMPLES)), "id long, t string")


def texts(spark, sf):
    more = read(spark, sf, "documents").select((F.col("doc_id") + 1000).alias("id"), F.col("text").alias("t"))
    return samples(spark).unionByName(more).unionByName(read(spark, sf, "benchmark").select((-F.col("item_id") - 1).alias("id"), F.col("text").alias("t")))


def held(words, lower=(), t="t"):
    return "(" + " OR ".join([f"contains({t}, '{w}')" for w in words] + [f"contains(lower({t}), '{w}')" for w in lower]) + ")"


def first(rules, default):
    return "CASE " + " ".join(f"WHEN {held(words, lower)} THEN '{label}'" for label, words, lower in rules) + f" ELSE {default} END"


def rule_lists(k):
    """DuckDB: sources by product and rule, each once, in order."""
    start = "CASE product " + " ".join(f"WHEN '{p}' THEN {v[k]}" for p, v in L.PRODUCT_SOURCES.items()) + " ELSE [] END"
    every = ", ".join([start] + [f"CASE WHEN {held(words, lower)} THEN {given[k]} ELSE [] END" for words, lower, *given in L.SOURCE_RULES if given[k]])
    return f"list_transform(list_filter(flatten([{every}]), lambda x, i: list_position(flatten([{every}]), x) = i), lambda x: x)"


@query("s39_s40_s42_labels", f"WITH {TEXTS}, p AS (SELECT id, t, {first(L.PRODUCT_RULES, chr(39) + 'unknown' + chr(39))} AS product, {first(L.STYLE_RULES, chr(39) + 'fact' + chr(39))} AS style FROM texts) SELECT id, product, style, array_to_string({rule_lists(0)}, ',') AS docs, array_to_string({rule_lists(1)}, ',') AS structured FROM p")
def s39(spark, sf):
    t = texts(spark, sf).withColumn("product", L.product_type(F.col("t")))
    docs, structured = L.source_labels(F.col("t"), F.col("product"))
    return t.select("id", "product", L.autolabel_style(F.col("t")).alias("style"), F.array_join(docs, ",").alias("docs"), F.array_join(structured, ",").alias("structured"))


def strip_sql(x):
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def cut_sql():
    x = strip_sql("replace(coalesce(t, ''), chr(13) || chr(10), chr(10))")
    for m in L.HEAD_MARKERS:
        x = strip_sql(f"split_part({x}, {'chr(10)' if m == chr(10) else chr(39) + m + chr(39)}, 1)")
    return x


HEADS = " ".join(f"WHEN contains(h, '{e}') AND length({strip_sql(f'split_part(h, {chr(39)}{e}{chr(39)}, 1)')}) >= 4 THEN {strip_sql(f'split_part(h, {chr(39)}{e}{chr(39)}, 1)')} || '{e}'" for e in L.HEAD_ENDS)


@query("s43_query_heads", f"WITH {TEXTS}, c AS (SELECT id, {cut_sql()} AS h FROM texts) SELECT id, CASE {HEADS} ELSE {strip_sql('substr(h, 1, 256)')} END AS head FROM c")
def s43(spark, sf):
    return texts(spark, sf).select("id", L.query_head(F.col("t")).alias("head"))


NAMES = "CASE id % 4 WHEN 0 THEN 'Filing ' WHEN 1 THEN 'q&a' ELSE 'other' END"


@query("s38_document_types", f"WITH {TEXTS}, n AS (SELECT id, t, lower(trim({NAMES})) AS n FROM texts) SELECT id, CASE " + " ".join(f"WHEN list_contains({v}, n) THEN '{k}'" for k, v in L.DOCUMENT_ALIASES.items()) + f" ELSE {first(L.DOCUMENT_RULES, 'NULL')} END AS source_type FROM n")
def s38(spark, sf):
    return texts(spark, sf).select("id", L.document_type(F.expr(NAMES), F.col("t")).alias("source_type"))


SHORT = "|".join(w for w in L.INDUSTRY_TERMS if len(w) <= 2)
MARKERS = "|".join(L.SECTOR_MARKERS)


@query("pf3_pf9_lc20_terms", f"""WITH {TEXTS} SELECT id, array_to_string(list_filter({L.INDUSTRY_TERMS}, lambda w: contains(t, w)), ',') AS terms,
  {held(L.BUCKET_WORDS + ['成长指数', '宽基指数'])} OR regexp_matches(t, '(^|[^一-鿿])({SHORT})|({SHORT})({MARKERS})') AS bucket, {held(*L.CURRENT_WORDS)} AS current,
  array_to_string(list_filter([{', '.join(f"CASE WHEN {held([], w)}{' OR ' + held([], L.EASING_WORDS) if c in L.EASING_CODES else ''} THEN '{c}' END" for c, w in L.MACRO_CODE_WORDS.items())}], lambda x: x IS NOT NULL), ',') AS codes FROM texts""")
def pf9(spark, sf):
    t = F.col("t")
    return texts(spark, sf).select("id", F.array_join(L.industry_terms(t), ",").alias("terms"), L.bucket_market(t).alias("bucket"), L.asks_current(t).alias("current"), F.array_join(L.macro_codes(t), ",").alias("codes"))


@query("pf24_non_trading_days", f"SELECT o_orderkey, dayofweek(o_orderdate) IN (0, 6) OR list_contains({L.FIXED_HOLIDAYS}, strftime(o_orderdate, '%m-%d')) AS closed FROM orders")
def pf24(spark, sf):
    return read(spark, sf, "orders").select("o_orderkey", L.non_trading_day(F.col("o_orderdate")).alias("closed"))


FAILED = f"""failed AS (SELECT t, false AS dialogue FROM texts UNION ALL SELECT text, true FROM conversations WHERE role = 'user'), kinds AS (SELECT dialogue, CASE WHEN regexp_matches(t, '[一-鿿]') THEN 'zh' ELSE 'en' END AS language, {first(L.PRODUCT_RULES, chr(39) + 'unknown' + chr(39))} AS product,
  CASE WHEN dialogue AND length({strip_sql('t')}) <= 12 THEN 'short_dialogue_followup' WHEN dialogue THEN 'multi_turn_dialogue_utterance' WHEN regexp_full_match(lower(t), '[a-z\\\\]{{6,}}') THEN 'gibberish_ascii'
    ELSE coalesce({first(L.FAILURE_RULES, 'NULL')}, CASE WHEN regexp_matches(t, '[一-鿿]') THEN 'open_domain_chinese_qa' ELSE 'open_domain_english_qa' END) END AS kind FROM failed WHERE t IS NOT NULL)"""


@query("s48_a20_a21_failures", f"WITH {TEXTS}, {FAILED} SELECT kind, dialogue, language, product, count(*) AS n FROM kinds GROUP BY GROUPING SETS ((kind), (dialogue), (language), (product))")
def s48(spark, sf):
    talk = read(spark, sf, "conversations").where("role = 'user'").select(F.col("text").alias("t"), F.lit(True).alias("dialogue"))
    every = texts(spark, sf).select("t", F.lit(False).alias("dialogue")).unionByName(talk).where("t is not null")
    language = F.when(F.col("t").rlike(r"[\x{4e00}-\x{9fff}]"), "zh").otherwise("en")
    every = every.withColumn("language", language).select(L.failure_kind(F.col("t"), F.col("dialogue"), F.col("language")).alias("kind"), "dialogue", "language", L.product_type(F.col("t")).alias("product"))
    keys = [F.col(c) for c in ("kind", "dialogue", "language", "product")]
    return every.groupingSets([[k] for k in keys], *keys).agg(F.count(F.lit(1)).alias("n"))


@query("s14_s15_comparison_targets", f"""WITH {TEXTS}, v AS (SELECT id, coalesce(t, '') AS t FROM texts), c AS (SELECT id, CASE WHEN regexp_matches(t, '{L.PAIR_PATTERN}') THEN [regexp_extract(t, '{L.PAIR_PATTERN}', 1), regexp_extract(t, '{L.PAIR_PATTERN}', 2)]
    WHEN regexp_matches(t, '{L.THAN_PATTERN}') THEN regexp_extract_all(t, '{L.THAN_PATTERN}', 1) ELSE regexp_extract_all(t, '{L.OTHER_PATTERN}', 1) END AS targets FROM v)
  SELECT id::BIGINT AS id, array_to_string(targets, ',') AS targets, array_to_string(list_transform(targets, lambda x: regexp_replace(x, '^(.+)({'|'.join(L.TARGET_SUFFIXES)})$', '\\1')), ',') AS names FROM c""")
def s14(spark, sf):
    c = texts(spark, sf).withColumn("t", F.coalesce("t", F.lit(""))).withColumn("targets", L.comparison_targets(F.col("t")))
    return c.select("id", F.array_join("targets", ",").alias("targets"), F.array_join(F.transform("targets", L.target_name), ",").alias("names"))


@query("j8_ir7_ir13_terms", f"""WITH {REQUESTS} SELECT query_id, array_to_string([coalesce(symbols[i], '') || '=' || coalesce(entity_names[i], symbols[i], '') FOR i IN range(1, greatest(len(symbols), len(entity_names)) + 1)], ',') AS pairs,
  trim(array_to_string(list_filter(flatten([[query], entity_names, symbols, keywords]), lambda x: x <> ''), ' ')) AS full_text, trim(array_to_string(list_filter(flatten([[query], entity_names, keywords]), lambda x: x <> ''), ' ')) AS fuzzy,
  'market_provider_fetch_failed:' || product_type || ':Timeout:' || CASE WHEN length(trim(query)) > 180 THEN substr(replace(trim(query), chr(10), ' '), 1, 177) || '...' ELSE replace(trim(query), chr(10), ' ') END AS warning FROM requests""")
def j8(spark, sf):
    pairs = F.transform(L.entity_pairs(F.col("entity_names"), F.col("symbols")), lambda x: F.concat_ws("=", x["symbol"], x["name"]))
    q, names, words = F.array("query"), F.col("entity_names"), F.col("keywords")
    return requests(spark, sf).select(
        "query_id", F.array_join(pairs, ",").alias("pairs"), L.search_terms(q, names, F.col("symbols"), words).alias("full_text"), L.search_terms(q, names, words).alias("fuzzy"),
        L.warning_text(F.col("product_type"), F.lit("Timeout"), F.col("query")).alias("warning"),
    )


def offered(spark, sf):
    """Evidence as documents of requests: some without body or summary, the third word of the title as the entity."""
    i = F.col("doc_id")
    return evidence(spark, sf).select(
        "doc_id", "lang", "source_type", "title", F.when(i % 7 == 0, "product_info").otherwise("stock").alias("product_type"), (i % 4 != 0).alias("body_available"),
        F.when(i % 12 != 1, F.col("body")).alias("body"), F.when(i % 8 != 0, F.col("summary")).alias("summary"), F.slice(F.split("title", " "), 3, 1).alias("names"), F.array("source_name").alias("symbols"),
    )


OFFERED = f"""{EVIDENCE}, offered AS (SELECT doc_id, lang, source_type, CASE WHEN doc_id % 4 <> 0 THEN CASE WHEN doc_id % 12 <> 1 THEN body ELSE '' END WHEN doc_id % 8 <> 0 AND summary <> '' THEN title || chr(10) || summary ELSE title END AS raw,
  CASE WHEN doc_id % 4 <> 0 AND doc_id % 12 <> 1 AND body <> '' THEN 'full' ELSE 'short' END AS level FROM evidence WHERE doc_id % 7 <> 0),
  meta AS (SELECT doc_id, lang, regexp_replace(raw, '[ \\t]+', '', 'g') AS t, level, CASE WHEN source_type NOT IN ('news', 'announcement', 'research_note', 'product_doc') THEN 'unsupported source_type=' || source_type WHEN regexp_replace(raw, '[ \\t]+', '', 'g') = '' THEN 'empty text after extraction' END AS skip FROM offered)"""


@query("s26_pf21_pf22_texts", f"WITH {OFFERED} SELECT doc_id, sha256(t) AS spaceless, level, skip FROM meta")
def s26(spark, sf):
    out = P.prepared(offered(spark, sf))
    return out.select("doc_id", F.sha2(F.regexp_replace("text", r"[ \t]+", "").cast("binary"), 256).alias("spaceless"), F.col("text_level").alias("level"), "skip")


@query("a25_filter_meta", f"WITH {OFFERED} SELECT lang, count(*) FILTER (WHERE skip IS NOT NULL) AS skipped, count(*) FILTER (WHERE skip IS NULL) AS analyzed, count(*) FILTER (WHERE skip IS NULL AND level = 'short') AS short FROM meta GROUP BY lang")
def a25(spark, sf):
    return P.filter_meta(P.prepared(offered(spark, sf)), "lang")


@query("s27_s28_relevant_sentences")
def s28(spark, sf):
    return P.prepared(offered(spark, sf)).select("doc_id", F.size("sentences").alias("n"), F.array_join("sentences", " ").alias("excerpt"), F.array_join("entity_hits", ",").alias("hits"))


INTENTS = "CASE abs(id) % 5 WHEN 0 THEN {0}('hold_judgment') WHEN 1 THEN {0}('risk_analysis', 'product_info') WHEN 2 THEN {0}('peer_compare') WHEN 3 THEN {0}('valuation_analysis') ELSE {0}('product_info') END"
ANALYSES = "('risk_analysis' IN intents OR 'valuation_analysis' IN intents)"


@query("s18_question_style", f"""WITH {TEXTS}, i AS (SELECT id, t, {INTENTS.format('list_value')} AS intents, CASE WHEN id % 9 = 0 THEN ['x'] ELSE [] END AS targets FROM texts),
  f AS (SELECT *, {held(*L.ADVICE_STYLE_WORDS)} AS advice, {held(L.ADVICE_STYLE_WORDS[0])} AS advised, {held(*L.WHY_STYLE_WORDS)} AS why, len(targets) > 0 OR list_contains(intents, 'peer_compare') OR {held(*L.COMPARE_STYLE_WORDS)} AS compare FROM i)
  SELECT id, CASE WHEN {held(L.OPINION_WORDS)} AND (list_contains(intents, 'hold_judgment') OR {ANALYSES}) THEN 'advice' WHEN {held(L.LONG_TERM_WORDS)} THEN 'advice' WHEN advice AND why THEN 'advice' WHEN advice AND compare THEN 'advice' WHEN why THEN 'why' WHEN compare THEN 'compare'
    WHEN advised AND list_contains(intents, 'hold_judgment') THEN 'advice' WHEN {held([], L.ADVICE_STYLE_WORDS[1])} THEN 'advice' WHEN {held(*L.FORECAST_STYLE_WORDS)} THEN 'forecast' WHEN advised AND {ANALYSES} THEN 'advice' WHEN {ANALYSES} THEN 'fact' ELSE 'given' END AS style FROM f""")
def s18(spark, sf):
    targets = F.when(F.col("id") % 9 == 0, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return texts(spark, sf).select("id", L.final_style(F.col("t"), F.lit("given"), F.expr(INTENTS.format("array")), targets).alias("style"))


GIVEN = ["price", "news", "risk", "macro", "policy", "valuation"]


@query("t10_t11_chosen_labels", f"""WITH s AS (SELECT item_id, label, ((item_id * 7 + k * (13 + item_id % 5)) % 100)::DOUBLE / 100 AS score FROM benchmark, (SELECT unnest({GIVEN}) AS label, unnest(range({len(GIVEN)})) AS k)),
  r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, label) AS n FROM s), b AS (SELECT item_id, greatest(count(*) FILTER (WHERE score >= 0.7), 1) AS k, max(score) FILTER (WHERE n = 1) AS top, max(score) FILTER (WHERE n = 2) AS second FROM r GROUP BY 1)
  SELECT item_id, array_to_string(list(label ORDER BY n) FILTER (WHERE n <= least(4, CASE WHEN k = 1 AND second >= greatest(0.12::DOUBLE, top - 0.08::DOUBLE) THEN 2 ELSE k END)), ',') AS chosen,
    coalesce(array_to_string(list(label ORDER BY n) FILTER (WHERE n <= 4 AND score >= 0.35), ','), '') AS best FROM r JOIN b USING (item_id) GROUP BY item_id""")
def t10(spark, sf):
    k = F.col("item_id")
    scores = F.map_from_arrays(F.array(*map(F.lit, GIVEN)), F.array(*[((k * 7 + i * (F.lit(13) + k % 5)) % 100).cast("double") / 100 for i in range(len(GIVEN))]))
    names = lambda x: F.array_join(F.transform(x, lambda e: e["label"]), ",")
    return read(spark, sf, "benchmark").select("item_id", names(U.chosen_labels(scores, 0.7)).alias("chosen"), names(U.sorted_scores(scores)).alias("best"))


@query("f13_f20_t20_scores", f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_tax + l_discount > 0 THEN round((0.85::DOUBLE * l_tax::DOUBLE + 0.15::DOUBLE * l_discount::DOUBLE) / (l_tax::DOUBLE + l_discount::DOUBLE), 4) END AS sentiment, least(coalesce(TRY_CAST(CASE WHEN l_linenumber % 3 = 0 THEN l_returnflag ELSE CAST(l_linenumber AS VARCHAR) END AS INT), 0), 2) AS relevance,
  array_to_string(list_filter({U.SOURCE_ORDER}, lambda s: list_contains([lower(l_linestatus), 'faq', 'news'], s)) || [lower(l_linestatus)], ',') AS sources FROM lineitem""")
def f13(spark, sf):
    level = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_returnflag")).otherwise(F.col("l_linenumber").cast("string"))
    tax, discount = F.col("l_tax").cast("double"), F.col("l_discount").cast("double")
    sources = U.source_order(F.array(F.lower("l_linestatus"), F.lit("faq"), F.lit("news"), F.lit("faq")))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.sentiment_score(tax, F.lit(0.0), discount).alias("sentiment"), S.relevance(level).alias("relevance"), F.array_join(sources, ",").alias("sources"))
