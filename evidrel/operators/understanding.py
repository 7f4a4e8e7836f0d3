"""Query understanding: score maps, ordered rules, label choice, source plans.

Scores of labels are map<string, double> columns. Rules are data: conditions are
column expressions over the query, applied in order.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidrel.functions.text import any_of

# Source order, and words of the rules.
SOURCE_ORDER = ["market_api", "news", "industry_sql", "fundamental_sql", "announcement", "research_note", "faq", "product_doc", "macro_sql"]
HOLD_WORDS = [
    "值得拿", "值得买", "值得买吗", "值得入手", "值不值得买", "值不值得入手", "值得持有", "继续拿", "还能拿吗", "还能不能拿", "值不值得拿", "还适合拿吗", "适合买入",
    "适合入手", "适合长期拿", "适合长期持有", "长期拿", "长期持有", "长期定投",
]
TIMING_WORDS = ["买吗", "能买吗", "还能买", "上车", "买入", "入手", "值得买", "值得入手", "该不该买", "要不要买", "卖出", "止盈", "止损", "适合买"]
COMPARE_PRODUCT_WORDS = ["区别", "不同", "一回事", "哪个", "谁更", "更适合", "更稳", "波动更小", "适合新手"]
MACRO_WORDS = ["宏观", "降息", "降准", "cpi", "pmi", "gdp", "macro", "policy", "美联储", "央行", "财政赤字"]


def sorted_scores(scores: Column, least: float = 0.35, most: int = 4) -> Column:
    """The best labels with a score of at least ``least``: array<struct<label, score>>, scores with two places."""
    items = F.filter(F.map_entries(scores), lambda e: e["value"] >= least)
    order = F.array_sort(F.transform(items, lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("label"))))
    return F.slice(F.transform(order, lambda x: F.struct(x["label"].alias("label"), F.round(-x["minus"], 2).alias("score"))), 1, most)


def chosen_labels(scores: Column, least: float, most: int = 4) -> Column:
    """Labels that reach ``least``; without any the best one; a single one is joined by a second close behind it."""
    order = F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("minus"), e["key"].alias("label"))))
    reached = F.filter(order, lambda x: -x["minus"] >= least)
    one = F.when(F.size(reached) > 0, reached).otherwise(F.slice(order, 1, 1))
    top, second = -F.get(order, F.lit(0))["minus"], F.get(order, F.lit(1))
    near = second.isNotNull() & (-second["minus"] >= F.greatest(F.lit(0.12), top - 0.08))
    out = F.when((F.size(one) == 1) & near, F.array_append(one, second)).otherwise(one)
    return F.slice(F.transform(out, lambda x: F.struct(x["label"].alias("label"), (-x["minus"]).alias("score"))), 1, most)


def intent_rules(q: Column) -> list[tuple[Column, str, float, float, dict[str, float] | None]]:
    """(condition, label, score, most, blockers) in order."""
    low = F.lower(q)
    has, lows = lambda *w: any_of(q, list(w)), lambda *w: any_of(low, list(w))
    fund = has("ETF", "etf", "LOF", "lof", "基金") & any_of(q, COMPARE_PRODUCT_WORDS)
    macro = (has("宏观", "降息", "降准", "cpi", "pmi", "财政赤字", "美联储议息") | lows("macro", "cpi", "pmi", "gdp", "fed", "fomc", "affect", "impact", "what happens")) & (has("影响", "怎么走") | lows("affect", "impact", "what happens"))
    hold = any_of(q, HOLD_WORDS)
    return [
        (has("为什么", "为啥", "咋", "咋回事") & has("跌", "涨"), "market_explanation", 0.88, 0.45, None),
        (lows("why") & lows("fall", "rally", "drop", "surge"), "market_explanation", 0.88, 0.45, None),
        (hold, "hold_judgment", 0.80, 0.50, {"buy_sell_timing": 0.72}),
        (hold, "buy_sell_timing", 0.74, 0.50, None),
        (any_of(q, TIMING_WORDS), "buy_sell_timing", 0.78, 0.50, None),
        (has("新闻"), "event_news_query", 0.76, 0.45, None),
        (lows("news", "headline", "announcement", "update"), "event_news_query", 0.76, 0.45, None),
        (has("费率", "申赎"), "trading_rule_fee", 0.84, 0.45, None),
        (has("是什么产品", "产品概要", "产品说明"), "product_info", 0.80, 0.45, None),
        (fund, "product_info", 0.82, 0.55, None),
        (fund, "peer_compare", 0.72, 0.55, None),
        (has("风险高吗", "波动大吗"), "risk_analysis", 0.76, 0.45, None),
        (has("基本面", "业绩", "财报", "营收", "净利润", "毛利率"), "fundamental_analysis", 0.84, 0.45, None),
        (lows("revenue", "net profit", "earnings", "fundamental", "fundamentals"), "fundamental_analysis", 0.84, 0.45, None),
        (macro, "macro_policy_impact", 0.90, 0.45, None),
        (has("会怎么走", "怎么走") | lows("what happens to", "how will"), "price_query", 0.78, 0.55, None),
    ]


def with_rules(scores: Column, rules: Iterable[tuple[Column, str, float, float, dict[str, float] | None]]) -> Column:
    """Scores after each rule in turn has raised its label where it has at most ``most`` and no blocker reaches its bound."""
    none = F.create_map().cast("map<string,double>")
    items = [
        F.struct(
            F.coalesce(when, F.lit(False)).alias("holds"), F.lit(label).alias("label"), F.lit(score).alias("score"), F.lit(most).alias("most"),
            (F.create_map(*[F.lit(x) for kv in blockers.items() for x in kv]) if blockers else none).alias("blockers"),
        )
        for when, label, score, most, blockers in rules
    ]
    has = lambda acc, k: F.coalesce(F.element_at(acc, k), F.lit(0.0))

    def add(acc: Column, r: Column) -> Column:
        blocked = F.exists(F.map_entries(r["blockers"]), lambda e: has(acc, e["key"]) >= e["value"])
        old = has(acc, r["label"])
        new = F.map_concat(F.map_filter(acc, lambda k, _: k != r["label"]), F.create_map(r["label"], F.greatest(old, r["score"])))
        return F.when(r["holds"] & ~blocked & (old <= r["most"]), new).otherwise(acc)

    return F.aggregate(F.array(*items), scores, add)


def product_label(q: Column, label: Column) -> Column:
    """A product label corrected by words: ETF or LOF, fund, macro, then stock."""
    low = F.lower(q)
    token = lambda w: low.rlike(rf"(?<![a-z0-9])(?:{w})(?![a-z0-9])")
    etf, fund = token("etf|etfs|lof|lofs"), any_of(q, ["基金", "公募", "私募", "定投", "申赎"]) | token("fund|funds")
    stock = any_of(low, ["营收", "净利润", "earnings", "revenue", "net profit", "rally", "fall", "selloff", "pullback", "drawdown"])
    return F.when(etf, "etf").when(fund, "fund").when(any_of(low, MACRO_WORDS), "macro").when(stock, "stock").otherwise(label)


def source_order(sources: Column) -> Column:
    """Distinct sources in their fixed order; unknown ones last, as they came."""
    known = F.array(*map(F.lit, SOURCE_ORDER))
    distinct = F.array_distinct(sources)
    return F.concat(F.filter(known, lambda s: F.array_contains(distinct, s)), F.array_except(distinct, known))


def collected(rules: list[tuple[Column, list[str]]]) -> Column:
    """The values of all rules that hold, in order, each once."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.when(c, F.array(*map(F.lit, v))).otherwise(none) for c, v in rules]))


def plan(product: Column, intents: Column, topics: Column, q: Column, bucket: Column) -> tuple[Column, Column]:
    """(source plan, required evidence) of the main rules; bucket: whether the query is about a sector or the market."""
    has = lambda x: F.coalesce(F.array_contains(intents, x), F.lit(False))
    topic = lambda x: F.coalesce(F.array_contains(topics, x), F.lit(False))
    stock, fund = product == "stock", product.isin("fund", "etf")
    macro = has("macro_policy_impact") | topic("macro")
    why, hold = has("market_explanation") & stock, has("hold_judgment") & stock
    basic = has("fundamental_analysis") | has("valuation_analysis")
    sector = macro & (topic("industry") | any_of(q, ["板块", "行业", "A股", "a股"]))
    sources = collected([
        (why & ~bucket, ["market_api"]), (why, ["news", "industry_sql", "fundamental_sql", "research_note"]), (why & ~bucket, ["announcement"]),
        (has("event_news_query") & stock, ["news", "announcement"]), (hold, ["market_api", "news", "fundamental_sql", "research_note"]), (hold & ~bucket, ["announcement"]),
        (has("product_info") & fund, ["faq", "product_doc", "research_note"]), (has("buy_sell_timing") & fund, ["market_api", "product_doc", "research_note"]),
        (has("risk_analysis") & fund, ["market_api", "faq", "product_doc"]), (fund & (F.size(intents) <= 0), ["faq", "product_doc"]),
        (macro, ["macro_sql", "news", "research_note"]), (sector, ["industry_sql"]), (basic, ["fundamental_sql", "research_note", "news"]),
        (has("peer_compare"), ["market_api", "fundamental_sql", "research_note"]),
    ])
    required = collected([
        (why, ["price", "news", "industry", "fundamentals", "risk"]), (has("event_news_query") & stock, ["news"]), (hold, ["price", "fundamentals", "risk"]),
        (has("product_info") & fund, ["product_mechanism"]), (has("buy_sell_timing") & fund, ["price", "risk"]), (has("risk_analysis") & fund, ["risk"]),
        (fund & (F.size(intents) <= 0), ["product_mechanism"]), (macro, ["macro"]), (sector, ["industry"]), (basic, ["fundamentals"]), (has("peer_compare"), ["comparison"]),
    ])
    empty = F.size(sources) == 0
    return (
        source_order(F.when(empty, F.array(F.lit("news"), F.lit("market_api"))).otherwise(sources)),
        F.when(empty, F.array(F.lit("news"), F.lit("price"))).otherwise(required),
    )
