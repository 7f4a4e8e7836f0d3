"""Weak labels of texts from words they hold: products, sources, styles, codes, failures, comparison targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidrel.functions.text import any_of

# Ordered rules of words as written, words of the lower-cased text, and what they give.
PRODUCT_RULES = [
    ("etf", ["ETF", "etf", "LOF", "lof"], []),
    ("fund", ["基金", "公募", "私募", "基金经理", "申赎", "定投"], ["fund"]),
    ("index", ["指数", "中证", "沪深300", "上证50", "创业板指"], ["index"]),
    ("stock", ["股票", "股价", "证券", "港股", "A股", "a股", "美股", "个股"], ["stock"]),
    ("macro", ["宏观", "央行", "利率", "GDP", "CPI", "PMI", "财政", "货币", "降准", "降息", "经济"], ["macro", "economy", "inflation", "interest rate", "gdp", "cpi", "pmi"]),
    ("generic_market", ["财经", "金融", "市场", "券商", "行业", "板块", "公司", "业绩", "财报", "研报", "评级", "大盘"], ["market", "finance", "sector", "industry", "earnings"]),
]
PRODUCT_SOURCES = {
    "stock": (["news", "announcement", "research_note"], ["market_api", "fundamental_sql"]),
    "etf": (["research_note", "faq", "product_doc"], ["market_api"]),
    "fund": (["research_note", "faq", "product_doc"], ["fundamental_sql"]),
    "index": (["news", "research_note"], ["market_api", "macro_sql"]),
    "generic_market": (["news", "research_note"], ["macro_sql", "fundamental_sql"]),
    "macro": (["news", "announcement", "research_note"], ["macro_sql"]),
}
SOURCE_RULES = [
    (["政策", "法规", "法条", "条例", "合规", "监管", "司法", "行政", "法律"], [], ["faq", "product_doc", "announcement"], ["macro_sql"]),
    (["问答", "知识", "百科", "常识", "Q&A", "QA", "答疑"], [], ["faq", "product_doc"], []),
    (["新闻", "消息", "公告", "资讯", "快讯", "动态", "news", "headline", "update", "filing", "disclosure"], [], ["news", "announcement"], []),
    (["研报", "研究报告", "评级", "目标价", "调研"], ["research report", "broker", "rating", "target price"], ["research_note", "news"], ["fundamental_sql"]),
    (["财报", "业绩", "营收", "利润", "净利润", "毛利", "ROE", "估值", "市盈率", "市净率"], ["earnings", "revenue", "profit", "valuation", "pe", "pb"], [], ["fundamental_sql"]),
    (["行业", "板块", "产业链", "上下游", "龙头", "细分"], ["industry", "sector", "supply chain"], ["news", "research_note"], ["industry_sql"]),
    (["宏观", "央行", "利率", "GDP", "CPI", "PMI", "财政", "货币", "降准", "降息"], ["macro", "inflation", "interest rate", "gdp", "cpi", "policy"], ["news", "research_note"], ["macro_sql"]),
    (["ETF", "LOF", "基金", "费率", "申赎", "定投"], ["etf", "lof", "fund", "redemption", "subscription"], ["faq", "product_doc", "research_note"], []),
    (["指数", "大盘", "沪深300"], ["index", "benchmark"], [], ["market_api", "macro_sql"]),
]
STYLE_RULES = [
    ("why", ["为什么", "为啥", "原因", "怎么回事", "咋"], ["why", "reason"]),
    ("compare", ["比较", "对比", "哪个好", "区别"], ["compare", "difference", " vs ", "better"]),
    ("advice", ["建议", "应该", "该不该", "值不值", "推荐"], ["should i", "worth", "recommend", "suitable", "good to buy"]),
    ("forecast", ["预测", "会不会", "未来", "走势", "前景", "明天"], ["forecast", "future", "outlook", "next", "will it"]),
]
LONG_TERM_WORDS = ["适合长期拿", "适合长期持有", "长期拿", "长期持有", "长期定投", "适合定投", "继续定投", "适合继续定投"]
ADVICE_STYLE_WORDS = (
    ["值得", "能买吗", "买吗", "买入", "卖出", "上车", "止盈", "止损", "持有", "拿吗", "还能拿吗", "还能不能拿", "值不值得拿", "不适合", "适不适合", *LONG_TERM_WORDS, "更适合", "更稳"],
    ["should i", "worth", "suitable", "good to buy", "hold it", "cut the loss"],
)
COMPARE_STYLE_WORDS = (["比", "相比", "哪个", "谁更", "更稳", "更好", "有什么区别", "有何区别", "有什么不同", "有啥不同", "差别", "一回事吗"], ["compare", "difference", "better"])
WHY_STYLE_WORDS = (["为什么", "为啥"], ["why"])
FORECAST_STYLE_WORDS = (["未来", "接下来", "后市", "会怎么走", "后面会怎么走", "怎么看后市"], ["future", "outlook", "what happens to", "how will", "will it"])
OPINION_WORDS = ["你觉得", "怎么看", "如何看", "评价一下", "分析一下", "从投资角度", "后面怎么看", "后续怎么看"]
POSITION_INTENTS, ANALYSIS_INTENTS = ["hold_judgment", "buy_sell_timing"], ["fundamental_analysis", "valuation_analysis", "risk_analysis"]
DOCUMENT_RULES = [
    ("faq", [], ["faq", "q&a", "常见问题", "如何", "怎么", "开户", "开通"]),
    ("product_doc", [], ["产品说明", "交易规则", "费率", "规则", "机制", "指南", "手册", "product", "guide", "rule"]),
    ("research_note", [], ["证券研究报告", "研究报告", "研报", "评级", "目标价", "research", "analyst", "rating"]),
]
DOCUMENT_ALIASES = {
    "announcement": ["announcement", "announcements", "filing"],
    "research_note": ["research", "research_report", "research_note", "report"],
    "news": ["news", "article"],
    "faq": ["faq", "qa", "q&a"],
    "product_doc": ["product_doc", "product", "doc"],
}
FAILURE_RULES = [
    ("tech_or_coding", [], ["computer", "laptop", "python", "sql", "frontend", "program", "戴尔", "电脑", "笔记本"]),
    ("medical_or_hospital", [], ["hospital", "doctor", "disease", "fever", "cough", "医院", "病情", "孩子", "胸痛"]),
    ("travel_food_hotel", [], ["hotel", "restaurant", "museum", "park", "scenic", "景点", "餐厅", "酒店", "苏州", "游乐场", "古镇"]),
    ("car_purchase", [], ["car", "suv", "mpv", "大众", "汽车", "三厢车", "蔚揽", "探岳"]),
    ("slot_followup_or_pricing", [], ["phone", "call", "price", "how much", "人均消费", "电话", "预算", "多少", "几星级"]),
]
MACRO_CODE_WORDS = {
    "CPI_CN": ["cpi", "通胀", "物价"],
    "PMI_CN": ["pmi", "制造业", "景气"],
    "M2_CN": ["m2", "货币", "流动性", "社融", "降准", "降息", "lpr"],
    "CN10Y": ["cn10y", "10y", "十年期", "国债", "利率", "收益率", "降息", "lpr"],
}
EASING_WORDS, EASING_CODES = ["降准", "降息", "lpr"], ["M2_CN", "CN10Y"]
CURRENT_WORDS = (["今天", "今日", "现在", "当前", "实时", "最新"], ["today", "current", "right now", "now", "real-time", "realtime", "latest"])
FIXED_HOLIDAYS = ["01-01", "05-01", "10-01", "10-02", "10-03", "10-04", "10-05", "10-06", "10-07"]
HEAD_MARKERS, HEAD_ENDS = ["原标题：", "来源：", "Source:", "\n"], ["？", "?", "。", "!"]
INDUSTRY_TERMS = ["白酒", "保险", "券商", "消费", "银行", "科技", "地产", "成长指数", "宽基指数"]
BUCKET_WORDS, SECTOR_MARKERS = ["行业", "板块", "大盘"], ["板块", "行业", "赛道", "方向", "主题"]
TARGET_SUFFIXES = ["估值", "风险", "波动", "价格", "行情", "新闻", "基本面", "费率", "回撤"]
TARGET = "[^，。? ]+?"
JOINING = ["和", "与", "跟"]
COMPARED = "哪个|谁更|更稳|更好|有什么区别|有何区别|有什么不同|差别"
PAIR_PATTERN, THAN_PATTERN, OTHER_PATTERN = f"({TARGET})(?:和|与|跟)({TARGET})(?:比|相比|{COMPARED})", f"(?:和|与|跟)({TARGET})(?:比|相比)", f"(?:和|与|跟)({TARGET})(?:{COMPARED})"


def holds(text: Column, words: list[str], lower_words: list[str] = ()) -> Column:
    """Whether a text holds one of the words as written, or in lower case one of the others; null holds none."""
    t = F.coalesce(text, F.lit(""))
    return reduce(lambda a, b: a | b, [any_of(x, list(ws)) for x, ws in ((t, words), (F.lower(t), lower_words)) if ws])


def first_rule(text: Column, rules: list[tuple[str, list[str], list[str]]], default: str | None) -> Column:
    """The label of the first rule that a text meets."""
    return F.coalesce(*[F.when(holds(text, words, lower), label) for label, words, lower in rules], F.lit(default))


def strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def product_type(text: Column) -> Column:
    return first_rule(text, PRODUCT_RULES, "unknown")


def document_type(name: Column, text: Column) -> Column:
    """The source type that a spelling stands for, else that which the words of a document tell; null if none."""
    plain = F.lower(stripped(F.coalesce(name, F.lit(""))))
    return F.coalesce(*[F.when(plain.isin(names), t) for t, names in DOCUMENT_ALIASES.items()], first_rule(text, DOCUMENT_RULES, None))


def autolabel_style(text: Column) -> Column:
    return first_rule(text, STYLE_RULES, "fact")


def final_style(text: Column, style: Column, intents: Column, targets: Column) -> Column:
    """A question's style by its words, intents and comparison targets; the given one where none of them tells."""
    among = lambda labels: F.arrays_overlap(intents, strings(labels))
    advice, why = holds(text, *ADVICE_STYLE_WORDS), holds(text, *WHY_STYLE_WORDS)
    compare = F.array_contains(intents, "peer_compare") | (F.size(targets) > 0) | holds(text, *COMPARE_STYLE_WORDS)
    opinion = holds(text, OPINION_WORDS) & among([*POSITION_INTENTS, "market_explanation", *ANALYSIS_INTENTS])
    advised = holds(text, ADVICE_STYLE_WORDS[0])
    return (
        F.when(opinion | holds(text, LONG_TERM_WORDS) | (advice & (why | compare)), "advice")
        .when(why, "why")
        .when(compare, "compare")
        .when((advised & among(POSITION_INTENTS)) | holds(text, [], ADVICE_STYLE_WORDS[1]), "advice")
        .when(holds(text, *FORECAST_STYLE_WORDS), "forecast")
        .when(advised & among(ANALYSIS_INTENTS), "advice")
        .when(among(ANALYSIS_INTENTS), "fact")
        .otherwise(style)
    )


def source_labels(text: Column, product: Column) -> tuple[Column, Column]:
    """Document and structured sources: those of the product, then those of each rule in order, each once."""

    def side(k: int) -> Column:
        start = F.coalesce(*[F.when(product == p, strings(v[k])) for p, v in PRODUCT_SOURCES.items()], strings([]))
        more = [F.when(holds(text, words, lower), strings(given[k])).otherwise(strings([])) for words, lower, *given in SOURCE_RULES if given[k]]
        return F.array_distinct(F.concat(start, *more))

    return side(0), side(1)


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def query_head(text: Column) -> Column:
    """What stands before the first marker of each kind; of that the first sentence of four characters or more, else 256 characters."""
    t = F.replace(stripped(F.coalesce(text, F.lit(""))), F.lit("\r\n"), F.lit("\n"))
    for marker in HEAD_MARKERS:
        t = stripped(F.substring_index(t, marker, 1))
    heads = [(stripped(F.substring_index(t, end, 1)), end) for end in HEAD_ENDS]
    hits = [F.when(F.contains(t, F.lit(end)) & (F.length(h) >= 4), F.concat(h, F.lit(end))) for h, end in heads]
    return F.coalesce(*hits, stripped(F.substring(t, 1, 256)))


def industry_terms(text: Column) -> Column:
    return F.filter(strings(INDUSTRY_TERMS), lambda w: F.contains(text, w))


def bucket_market(text: Column) -> Column:
    """Whether a text names a part of the market; a short industry term counts if no CJK character stands before it or a sector word behind it."""
    short = "|".join(w for w in INDUSTRY_TERMS if len(w) <= 2)
    alone = text.rlike(rf"(?<![\x{{4e00}}-\x{{9fff}}])(?:{short})|(?:{short})(?:{'|'.join(SECTOR_MARKERS)})")
    return holds(text, BUCKET_WORDS + [w for w in INDUSTRY_TERMS if len(w) > 2]) | F.coalesce(alone, F.lit(False))


def macro_codes(text: Column) -> Column:
    """Indicators that a query asks for; words of monetary easing ask for both of EASING_CODES."""
    asked = [F.when(holds(text, [], words + (EASING_WORDS if code in EASING_CODES else [])), F.lit(code)) for code, words in MACRO_CODE_WORDS.items()]
    return F.array_compact(F.array(*asked))


def asks_current(text: Column) -> Column:
    return holds(text, *CURRENT_WORDS)


def non_trading_day(day: Column) -> Column:
    """Weekends and fixed holidays."""
    return F.dayofweek(day).isin(1, 7) | F.date_format(day, "MM-dd").isin(FIXED_HOLIDAYS)


def failure_kind(text: Column, dialogue: Column, language: Column) -> Column:
    """Why a query outside the domain may have been taken for one inside."""
    t = F.coalesce(text, F.lit(""))
    talk = F.when(F.length(stripped(t)) <= 12, "short_dialogue_followup").otherwise("multi_turn_dialogue_utterance")
    rules = first_rule(t, FAILURE_RULES, None)
    rest = F.when(language == "en", "open_domain_english_qa").otherwise("open_domain_chinese_qa")
    return F.when(dialogue, talk).when(F.lower(t).rlike(r"^[a-z\\]{6,}\z"), "gibberish_ascii").otherwise(F.coalesce(rules, rest))


def comparison_targets(text: Column) -> Column:
    """Both sides of a comparison, else what stands behind 和, 与 or 跟 and before a word of comparison."""
    pair = F.array(F.regexp_extract(text, PAIR_PATTERN, 1), F.regexp_extract(text, PAIR_PATTERN, 2))
    than, other = (F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (THAN_PATTERN, OTHER_PATTERN))
    # the patterns try every start of a word; a text without a joining word and one of comparison has no match
    never = ~(any_of(text, JOINING) & any_of(text, ["比", *COMPARED.split("|")]))
    return F.when(never, strings([])).when(text.rlike(PAIR_PATTERN), pair).when(F.size(than) > 0, than).otherwise(F.coalesce(other, strings([])))


def target_name(target: Column) -> Column:
    """A comparison target without the aspect behind it."""
    return F.regexp_replace(target, rf"(?s)^(.+)(?:{'|'.join(TARGET_SUFFIXES)})\z", "$1")


def entity_pairs(names: Column, symbols: Column) -> Column:
    """Names and symbols by position; a missing name is the symbol, a missing symbol empty; pairs of nothing go."""
    pairs = F.transform(F.arrays_zip(symbols.alias("s"), names.alias("n")), lambda x: F.struct(F.coalesce(x["s"], F.lit("")).alias("symbol"), F.coalesce(x["n"], x["s"], F.lit("")).alias("name")))
    return F.filter(pairs, lambda x: (x["symbol"] != "") | (x["name"] != ""))


def search_terms(*terms: Column) -> Column:
    """Query text for a full-text search: the non-empty terms of arrays, one after another."""
    return F.trim(F.array_join(F.filter(F.concat(*[F.coalesce(t, strings([])) for t in terms]), lambda x: x != ""), " "))


def warning_text(symbol: Column, kind: Column, message: Column) -> Column:
    """A provider's failure as a warning with at most 180 characters of its message."""
    t = F.replace(F.trim(message), F.lit("\n"), F.lit(" "))
    return F.concat_ws(":", F.lit("market_provider_fetch_failed"), symbol, kind, F.when(F.length(t) > 180, F.concat(F.substring(t, 1, 177), F.lit("..."))).otherwise(t))
