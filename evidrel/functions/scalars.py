"""Numbers, dates and ranking features as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidrel.functions.text import gram_jaccard

# What sources answer an intent, and days of a time scope.
INTENT_SOURCES = {
    "market_explanation": ["news", "market_api", "industry_sql"],
    "hold_judgment": ["fundamental_sql", "announcement", "research_note"],
    "buy_sell_timing": ["market_api", "research_note"],
    "product_info": ["faq", "product_doc"],
    "trading_rule_fee": ["faq", "product_doc"],
    "peer_compare": ["market_api", "fundamental_sql"],
    "fundamental_analysis": ["fundamental_sql", "research_note"],
    "valuation_analysis": ["fundamental_sql", "research_note"],
    "macro_policy_impact": ["macro_sql", "news"],
    "event_news_query": ["news", "announcement"],
    "risk_analysis": ["market_api", "faq"],
}
SCOPE_DAYS = {"today": 1, "recent_3d": 3, "recent_1w": 7, "recent_1m": 30, "recent_1q": 90, "long_term": 365, "unspecified": 30}
TOPIC_WORDS = {
    "price": ["涨", "跌", "行情", "价格", "收盘", "开盘"],
    "news": ["新闻", "消息", "公告", "报道"],
    "industry": ["行业", "板块", "同行"],
    "macro": ["宏观", "经济", "GDP", "CPI"],
    "policy": ["政策", "监管", "央行"],
    "fundamentals": ["营收", "利润", "财报", "业绩"],
    "valuation": ["估值", "PE", "PB", "市盈率"],
    "risk": ["风险", "波动", "回撤"],
    "comparison": ["比较", "对比", "哪个"],
    "product_mechanism": ["费率", "申赎", "定投", "规则"],
}
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyyMMdd", "yyyy-MM", "yyyy/MM", "yyyy年MM月dd日", "yyyy年MM月")


def table_of(pairs: dict) -> Column:
    return F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v))])


def age_days(published: Column, as_of: Column) -> Column:
    """Whole days from published to as_of, at least 0."""
    return F.greatest(F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(published)) / 86400), F.lit(0))


def recency(published: Column, as_of: Column) -> Column:
    """exp(-.693 age / 60), at least .05; .3 without a date."""
    return F.when(published.isNull(), 0.3).otherwise(F.round(F.greatest(F.lit(0.05), F.exp(-0.693 * age_days(published, as_of) / 60)), 4))


def window_match(published: Column, as_of: Column, scope: Column) -> Column:
    """1 inside the scope's days, falling to .1 beyond; .3 without a date."""
    d = F.coalesce(F.element_at(table_of(SCOPE_DAYS), scope), F.lit(30))
    age = age_days(published, as_of)
    return F.when(published.isNull(), 0.3).when(age <= d, 1.0).otherwise(F.round(F.greatest(F.lit(0.1), 1 - (age - d) / F.greatest(d, F.lit(1)) * 0.5), 4))


def intent_match(labels: Column, source: Column) -> Column:
    """.8 if one of the labels is answered by the source, else .2; .5 without labels or source."""
    known = table_of(INTENT_SOURCES)
    hit = F.exists(labels, lambda x: F.coalesce(F.array_contains(F.element_at(known, x), source), F.lit(False)))
    return F.when((F.coalesce(F.size(labels), F.lit(0)) <= 0) | (F.coalesce(source, F.lit("")) == ""), 0.5).when(hit, 0.8).otherwise(0.2)


def topic_match(labels: Column, content: Column) -> Column:
    """Part of the known topics of which a word is in the content; .5 if there are none."""
    words = table_of(TOPIC_WORDS)
    known = F.filter(labels, lambda x: F.element_at(words, x).isNotNull())
    hits = F.filter(known, lambda x: F.exists(F.element_at(words, x), lambda w: F.contains(content, w)))
    none = (F.coalesce(F.size(known), F.lit(0)) <= 0) | (F.coalesce(content, F.lit("")) == "")
    return F.when(none, 0.5).otherwise(F.round(F.size(hits) / F.size(known), 4))


def baseline_rank(lexical: Column, title: Column, entity: Column, product: Column, fresh: Column, credibility: Column) -> Column:
    return F.round(F.least(0.35 * lexical + 0.20 * title + 0.15 * entity + 0.10 * product + 0.10 * fresh + 0.10 * credibility, F.lit(1.0)), 4)


def hybrid_rank(base: Column, learned: Column) -> Column:
    """.35 base + .65 learned, within 0 and 1; base alone where nothing was learned."""
    mixed = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.35 * base + 0.65 * learned)), 4)
    return F.when(learned.isNull(), base).otherwise(mixed)


def term_bonus(terms: Column, text: Column) -> Column:
    """.06 for each term of two characters or more in the text, at most .18."""
    hits = F.size(F.filter(terms, lambda t: (F.length(F.trim(t)) >= 2) & F.contains(text, t)))
    return F.least(0.06 * F.greatest(hits, F.lit(0)), F.lit(0.18))


def valuation(pe: Column) -> Column:
    return F.when(pe.isNull() | (pe <= 0), "unknown").when(pe < 15, "potentially_undervalued").when(pe > 40, "potentially_overvalued").otherwise("fair_range")


def macro_direction(code: Column, value: Column) -> Column:
    three = lambda high, low, up, down, mid: F.when(value > high, up).when(value < low, down).otherwise(mid)
    known = (
        F.when(code == "CPI_CN", three(2.5, 0.5, "inflationary", "deflationary", "stable"))
        .when(code == "PMI_CN", F.when(value > 50, "expansion").otherwise("contraction"))
        .when(code == "M2_CN", three(10, 8, "expansionary", "tightening", "moderate"))
        .when(code == "CN10Y", three(3, 2.5, "rising", "falling", "stable"))
        .otherwise("unknown")
    )
    return F.when(code.isNull() | (code == ""), None).when(value.isNull(), "unknown").otherwise(known)


def macro_overall(directions: Column) -> Column:
    count = lambda names: F.size(F.filter(directions, lambda d: d.isin(names)))
    up, down = count(["expansion", "expansionary", "rising"]), count(["contraction", "tightening", "deflationary", "falling"])
    return F.when(up > down, "expansionary").when(down > up, "contractionary").otherwise("mixed")


def tolerant_float(text: Column) -> Column:
    """A number written with commas and one trailing percent sign; null if it is none."""
    t = F.regexp_replace(F.replace(F.trim(text), F.lit(","), F.lit("")), "%$", "")
    return t.try_cast("double")


def clean_number(text: Column) -> Column:
    """As providers write numbers: without % and commas; -, --, nan and None are null."""
    t = F.trim(F.regexp_replace(text, "[%,]", ""))
    return F.when(F.lower(t).isin("-", "--", "nan", "none", ""), None).otherwise(t.try_cast("double"))


def tolerant_date(text: Column) -> Column:
    """ISO text of a date in one of DATE_FORMATS, a month being its first day; else the first 10 characters."""
    t = F.trim(text)
    tries = [F.try_to_timestamp(t, F.lit(f)).cast("date").cast("string") for f in DATE_FORMATS]
    return F.coalesce(*tries, F.substring(t, 1, 10))


def relevance(text: Column, clip: bool = True) -> Column:
    """An integer relevance; not a number: 0; with clip, 2 at most."""
    v = F.coalesce(F.trim(text).try_cast("double").cast("int"), F.lit(0))
    return F.least(v, F.lit(2)) if clip else v


def sentiment_score(p_positive: Column, p_neutral: Column, p_negative: Column) -> Column:
    total = p_positive + p_neutral + p_negative
    return F.when(total > 0, F.round((0.85 * p_positive + 0.50 * p_neutral + 0.15 * p_negative) / total, 4))


def hash_split(key: Column) -> Column:
    """sha1 modulo 10: 8 is valid, 9 is test, the rest train.

    16 ** k is 6 modulo 10 for every k > 0, so the residue of the whole number
    is that of 6 times the sum of all hex digits but the last, plus the last.
    """
    h = F.sha1(key.cast("binary"))
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(39)), lambda i: F.conv(F.substring(h, i, F.lit(1)), 16, 10).cast("int")), F.lit(0), lambda s, x: s + x)
    r = (6 * total + F.conv(F.substring(h, 40, 1), 16, 10).cast("int")) % 10
    return F.when(r == 8, "valid").when(r == 9, "test").otherwise("train")


FEATURE_NAMES = [
    "lexical_score", "trigram_similarity", "entity_exact_match", "alias_match", "title_hit", "keyword_coverage", "intent_compatibility", "topic_compatibility",
    "product_type_match", "source_credibility", "recency_score", "is_primary_disclosure", "doc_length", "time_window_match", "ticker_hit",
]


def lexical_similarity(query: Column, text: Column) -> Column:
    return gram_jaccard(query, text)


def ranking_features(as_of: Column) -> dict[str, Column]:
    """The fifteen features of a candidate row.

    Columns of the request: query, keywords, entity_names, symbols,
    intent_labels, topic_labels, time_scope, wanted (product type); of the
    document: title, body, source_type, entity_symbols, product_type,
    publish_time, credibility_score; and retrieval_score. Null texts count as
    empty, null lists as without members.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    listed = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    content = F.concat_ws(" ", text("title"), text("body"))
    held = lambda words, where: F.exists(words, lambda w: F.contains(where, w)).cast("int").cast("double")
    keywords, names, symbols = listed("keywords"), listed("entity_names"), listed("symbols")
    covered = F.size(F.filter(keywords, lambda w: F.contains(content, w))) / F.greatest(F.size(keywords), F.lit(1))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int").cast("double")
    return dict(zip(FEATURE_NAMES, [
        F.coalesce("retrieval_score", F.lit(0.0)), gram_jaccard(text("query"), text("title")), flag(F.arrays_overlap(symbols, listed("entity_symbols"))), held(names, content),
        held(F.concat(keywords, names), text("title")), F.round(covered, 4), intent_match(listed("intent_labels"), F.col("source_type")), topic_match(listed("topic_labels"), content),
        flag(F.col("product_type") == F.col("wanted")), F.coalesce("credibility_score", F.lit(0.5)), recency(F.col("publish_time"), as_of), flag(F.col("source_type").isin("announcement", "product_doc")),
        F.round(F.least(F.length(content) / 5000, F.lit(1.0)), 4), window_match(F.col("publish_time"), as_of, F.col("time_scope")),
        held(F.transform(symbols, lambda s: F.substring_index(s, ".", 1)), content),
    ], strict=True))
