"""Text as column expressions: grams, similarity, languages, sentences, symbols, slots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\x{4e00}-\x{9fff}"

# Suffix families, provider spellings, word lists and ordered rewrites.
METRIC_WORDS = [(["PE", "市盈率"], "pe_ttm"), (["回撤"], "max_drawdown"), (["波动率"], "volatility")]
KEYWORDS = ["下跌", "上涨", "原因", "持有", "风险", "估值", "新闻"]
ADVICE_WORDS = ["值得", "能买吗", "买吗", "买入", "卖出", "上车", "止盈", "止损", "持有", "拿吗", "还能拿吗", "值不值得拿"]
COMPARE_WORDS = ["比", "相比", "哪个", "谁更", "更稳", "更好", "有什么区别", "有何区别", "有什么不同", "差别"]
WHY_WORDS = ["为什么", "为啥", "咋", "咋回事"]
ZH_STOPWORDS = "的 了 是 在 和 有 就 不 也 都 被 把 对 与 及 而 或 但 所 为 从 到 要 会 能 个 以".split()
EN_STOPWORDS = "the is are was were has have had been this that these those with from after before will would could should may might shall can not but and for its his her their our".split()
# Characters of a class of a regular expression.
ZH_PUNCT, EN_PUNCT = "。！？；：、，'《》（）【】…—～", ".!?;:\"'()\\-"
FORECAST_WORDS = ["未来", "接下来", "后市"]
PATTERN_REWRITES = [
    (r"(?i)\bwhat(?:'s| is) the difference between\s+(.+?)\s+and\s+(.+?)(?:\?|$)", "$1和$2有什么区别"),
    (r"(?i)\bwhich is better[, ]+\s*(.+?)\s+or\s+(.+?)(?:\?|$)", "$1和$2哪个好"),
    (r"(?i)\bwhich is better[, ]+\s*(.+?)\s+and\s+(.+?)(?:\?|$)", "$1和$2哪个好"),
    (r"(?i)\bany recent announcements from\s+(.+?)(?:\?|$)", "$1最近有什么公告"),
    (r"(?i)\bany recent news about\s+(.+?)(?:\?|$)", "最近有哪些$1新闻"),
    (r"(?i)\bany recent news on\s+(.+?)(?:\?|$)", "最近有哪些$1新闻"),
    (r"(?i)\bdoes\s+(.+?)\s+affect\s+(.+?)(?:\?|$)", "$1会影响$2吗"),
    (r"(?i)\bis the\s+(.+?)\s+sector\s+still buyable(?:\?|$)", "$1行业最近还能买吗"),
    (r"(?i)\bis\s+(.+?)\s+still worth holding(?:\?|$)", "$1还值得持有吗"),
]
TERM_REWRITES = [
    (r"(?i)\bwhy did\b", "为什么"), (r"(?i)\bwhy is\b", "为什么"), (r"(?i)\bwhy\b", "为什么"), (r"(?i)\bfall\b", "跌"), (r"(?i)\bfell\b", "跌"),
    (r"(?i)\bdrop(?:ped)?\b", "跌"), (r"(?i)\brise\b", "涨"), (r"(?i)\bup\b", "涨"), (r"(?i)\bnews\b", "新闻"), (r"(?i)\bannouncements?\b", "公告"),
    (r"(?i)\bfundamentals?\b", "基本面"), (r"(?i)\bvaluation\b", "估值"), (r"(?i)\brisk\b", "风险"), (r"(?i)\bvolatility\b", "波动"), (r"(?i)\bvolatile\b", "波动"),
    (r"(?i)\bdrawdown\b", "回撤"), (r"(?i)macro policy", "宏观政策"), (r"(?i)liquor sector", "白酒行业"), (r"(?i)liquor", "白酒"), (r"(?i)sector", "行业"),
    (r"(?i)industry", "行业"), (r"(?i)\bstill worth holding\b", "还值得持有"), (r"(?i)\bworth holding\b", "值得持有"), (r"(?i)\bstill buyable\b", "还能买"),
    (r"(?i)\bbuyable\b", "能买"), (r"(?i)\bcompare\b", "比较"), (r"(?i)\bdifference\b", "区别"),
]
JOINERS = [(r"(?i)\bor\b", "和"), (r"(?i)\band\b", "和"), (r"(?i)\bvs\.?\b", "和")]
SPACING = [("？", "?"), ("[，。！]", " "), (r"\s+", " "), (r"(?i)e\s*t\s*f", "ETF"), (r"(?i)l\s*o\s*f", "LOF")]


def rewritten(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Regular expression rules, one after another."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, text)


def normalize_query(text: Column, aliases: dict[str, str] | None = None) -> Column:
    """Punctuation, white space, ETF and LOF spellings, English phrases, then aliases, the longest first.

    An alias is left alone where it is already the end of its target. ASCII
    aliases are found in any case.
    """
    t = rewritten(F.trim(text), [*SPACING, *PATTERN_REWRITES, *TERM_REWRITES, *JOINERS, (r"\s+", " ")])
    t = F.trim(t)
    for source, target in sorted((aliases or {}).items(), key=lambda kv: -len(kv[0])):
        if source and source != target:
            ahead = target[: max(len(target) - len(source), 0)]
            guard = rf"(?<!\Q{ahead}\E)" if ahead and target.lower().endswith(source.lower()) else ""
            t = F.regexp_replace(t, ("(?i)" if source.isascii() else "") + guard + rf"\Q{source}\E", target)
    return F.trim(rewritten(t, [(r"\?", " "), (r"\s+", " ")]))


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def first_phrase(text: Column, phrases: dict[str, str], default: str) -> Column:
    """The value of the first phrase, in the order given, that the text holds; ASCII phrases in any case."""
    hit = [F.when(F.contains(F.lower(text), F.lit(k.lower())) if k.isascii() else F.contains(text, F.lit(k)), v) for k, v in phrases.items()]
    return F.coalesce(*hit, F.lit(default))


def question_style(text: Column, intents: Column) -> Column:
    has = lambda x: F.array_contains(intents, x)
    why = has("market_explanation") | any_of(text, WHY_WORDS)
    return (
        F.when(has("peer_compare") | any_of(text, COMPARE_WORDS), "compare")
        .when(why & ~any_of(text, ADVICE_WORDS), "why")
        .when(has("hold_judgment") | has("buy_sell_timing"), "advice")
        .when(why, "why")
        .when(any_of(text, FORECAST_WORDS), "forecast")
        .otherwise("fact")
    )


def slots(text: Column) -> dict[str, Column]:
    """keywords, forecast_horizon, sentiment_of_user and metrics_requested of a query."""
    words = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), w) for w in KEYWORDS]))
    fall = F.contains(text, F.lit("跌")) & ~F.array_contains(words, "下跌")
    return {
        "keywords": F.slice(F.when(fall, F.array_append(words, F.lit("下跌"))).otherwise(words), 1, 8),
        "forecast_horizon": F.when(any_of(text, ["后面", "未来", "接下来"]), "short_term").when(any_of(text, ["长期", "一年"]), "long_term").otherwise("short_term"),
        "sentiment_of_user": F.when(any_of(text, ["跌", "慌", "回撤"]), "anxious").otherwise("neutral"),
        "metrics_requested": F.array_compact(F.array(*[F.when(any_of(text, ws), m) for ws, m in METRIC_WORDS])),
    }


def char_grams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams; a shorter text is its own; an empty one has none."""

    def of(chars: Column) -> Column:  # bound once: a text is cut into characters in one pass
        starts = F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0)))
        return F.transform(starts, lambda i: F.concat_ws("", *[F.get(chars, i + k) for k in range(n)]))

    grams = F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))), of), F.lit(0))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(grams))


def gram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    """Common part of the distinct n-grams of two texts; 0 where one is empty."""
    sets = F.transform(F.array(F.struct(char_grams(a, n).alias("x"), char_grams(b, n).alias("y"))), lambda s: F.struct(F.size(s["x"]).alias("x"), F.size(s["y"]).alias("y"), F.size(F.array_intersect(s["x"], s["y"])).alias("both")))
    like = F.transform(sets, lambda s: F.when((s["x"] == 0) | (s["y"] == 0), 0.0).otherwise(F.round(s["both"] / (s["x"] + s["y"] - s["both"]), 4)))
    return F.get(like, F.lit(0))


def word_bound_grams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Character grams inside lower-cased words padded with one space; sizes beyond the padded word are left out."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")

    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        size, empty = F.length(padded), F.array().cast("array<string>")

        def of_size(n: int) -> Column:
            starts = F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1)))
            grams = F.transform(starts, lambda i: F.substring(padded, i, F.lit(n)))
            return grams if n == low else F.when(size >= n, grams).otherwise(empty)

        return F.flatten(F.array(*map(of_size, range(low, high + 1))))

    return F.flatten(F.transform(words, of_word))


def char_overlap(text: Column, query: Column) -> Column:
    """Part of the distinct characters of a text, without white space, that the query holds."""
    chars = F.array_distinct(F.filter(F.split(F.regexp_replace(text, r"\s", ""), ""), lambda c: c != ""))
    return F.when(F.size(chars) > 0, F.round(F.size(F.filter(chars, lambda c: F.contains(query, c))) / F.size(chars), 4)).otherwise(0.0)


def count_of(text: Column, char_class: str) -> Column:
    """Characters of a class; the others go a run at a time."""
    return F.length(F.regexp_replace(text, f"[^{char_class}]+", ""))


def once(value: Column, use) -> Column:
    """use(value), the value being made once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def script_counts(text: Column) -> Column:
    """struct(cjk, latin): CJK characters and Latin letters of a text."""
    return F.struct(count_of(text, CJK).alias("cjk"), count_of(text, "A-Za-z").alias("latin"))


def detect_language(text: Column, counts: Column | None = None) -> Column:
    """zh, en, mixed or unknown by the parts of CJK and Latin letters above a tenth.

    Without such a part, by twice the stopwords that the text holds and its
    punctuation, of which the larger must be two at least. counts: the text's
    ``script_counts``, where they are there already.
    """
    held = lambda t, words: sum(F.contains(t, F.lit(w)).cast("int") for w in words)
    zh_signal = held(text, ZH_STOPWORDS) * 2 + count_of(text, ZH_PUNCT)
    en_signal = once(F.lower(text), lambda t: held(t, EN_STOPWORDS)) * 2 + count_of(text, EN_PUNCT)

    def by_signal(both: Column, x: Column) -> Column:
        one = lambda label: F.when(both, "mixed").otherwise(label)
        return F.when((x["zh"] > x["en"]) & (x["zh"] >= 2), one("zh")).when((x["en"] > x["zh"]) & (x["en"] >= 2), one("en")).otherwise("unknown")

    def told(c: Column) -> Column:
        cjk, latin = c["n"]["cjk"] / c["total"], c["n"]["latin"] / c["total"]
        zh, en, both = cjk > 0.10, latin > 0.10, (latin > 0.05) & (cjk > 0.05)
        signal = once(F.struct(zh_signal.alias("zh"), en_signal.alias("en")), lambda x: by_signal(both, x))
        return F.when(F.coalesce(c["total"], F.lit(0)) == 0, "unknown").when(zh & en, "mixed").when(zh, "zh").when(en, "en").otherwise(signal)

    return once(F.struct(F.length(F.trim(text)).alias("total"), (script_counts(text) if counts is None else counts).alias("n")), told)


def chat_language(text: Column, counts: Column | None = None) -> Column:
    told = lambda n: F.when((n["cjk"] > 0) & (n["cjk"] >= F.greatest(F.lit(2.0), n["latin"] * 0.4)), "zh").when(n["latin"] > 0, "en").otherwise("zh")
    return once(script_counts(text) if counts is None else counts, told)


def eval_language(text: Column, counts: Column | None = None) -> Column:
    return once(script_counts(text) if counts is None else counts, lambda n: F.when(n["latin"] > n["cjk"], "en").otherwise("zh"))


def normalize_text(text: Column) -> Column:
    """No single space between CJK characters, runs of spaces and tabs as one, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, f"(?<=[{CJK}]) (?=[{CJK}])", ""), r"[ \t]+", " "))


def sentences_en(text: Column) -> Column:
    parts = F.transform(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.trim(s))
    return F.filter(parts, lambda s: s != "")


def sentences_zh(text: Column) -> Column:
    """Parts after 。！？； and line ends, merged until quotes are balanced."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[。！？；])\s*|\n"), lambda s: F.trim(s)), lambda s: s != "")
    count = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))
    even = lambda s: (count(s, "“") == count(s, "”")) & (count(s, "‘") == count(s, "’"))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(acc: Column, s: Column) -> Column:
        joined = F.concat(acc["open"], s)
        return F.struct(
            F.when(even(joined), F.array_append(acc["done"], joined)).otherwise(acc["done"]).alias("done"),
            F.when(even(joined), F.lit("")).otherwise(joined).alias("open"),
        )

    end = lambda acc: F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"])
    return F.aggregate(parts, start, add, end)


def sentences(text: Column, language: Column) -> Column:
    """By language; for others the first of zh, en and both that gives several."""
    t = normalize_text(text)
    zh, en = sentences_zh(t), sentences_en(t)
    both = F.filter(F.transform(F.split(t, r"(?<=[。！？；.!?])\s*|\n+"), lambda s: F.trim(s)), lambda s: s != "")
    other = F.when(F.size(zh) > 1, zh).when(F.size(en) > 1, en).otherwise(both)
    return F.when(F.coalesce(t, F.lit("")) == "", F.array().cast("array<string>")).when(language == "zh", zh).when(language == "en", en).otherwise(other)


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def safe_id(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, "[^A-Za-z0-9_.:-]+", "_"), F.lit("_")), 1, 160)


def content_key(*parts: Column) -> Column:
    """The first 16 hex digits of the sha1 of lower-cased parts, one a line."""
    return F.substring(F.sha1(F.concat_ws("\n", *[F.lower(F.coalesce(p, F.lit(""))) for p in parts]).cast("binary")), 1, 16)


def document_symbol(code: Column) -> Column:
    """Six digits with their default exchange: 6, 9 SH; 0, 2, 3 SZ; 4, 8 BJ; others alone."""
    first = F.substring(code, 1, 1)
    return F.when(first.isin("6", "9"), F.concat(code, F.lit(".SH"))).when(first.isin("0", "2", "3"), F.concat(code, F.lit(".SZ"))).when(first.isin("4", "8"), F.concat(code, F.lit(".BJ"))).otherwise(code)


def entity_symbol(text: Column) -> Column:
    """As the entity mart spells symbols: 6, 5 SH; 8, 4 BJ; others SZ; a trailing CH goes; no symbol: empty."""
    t = F.regexp_replace(F.regexp_replace(F.upper(F.trim(text)), "_", "."), r"\s+", "")
    t = F.regexp_replace(t, "CH$", "")
    first = F.substring(t, 1, 1)
    ext = F.when(first.isin("6", "5"), ".SH").when(first.isin("8", "4"), ".BJ").otherwise(".SZ")
    return F.when(t.rlike(r"^\d{6}\.(SH|SZ|BJ)$"), t).when(t.rlike(r"^\d{6}$"), F.concat(t, ext)).otherwise("")


def entity_type(symbol: Column, name: Column) -> Column:
    up = F.upper(name)
    return (
        F.when(up.rlike("ETF|LOF"), "etf").when(F.contains(name, F.lit("基金")), "fund").when(F.contains(name, F.lit("指数")), "index")
        .when(F.substring(symbol, 1, 2).isin("51", "56", "58", "15"), "etf").otherwise("stock")
    )


def label_list(text: Column) -> Column:
    """Labels split at commas and bars, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,|]"), lambda x: F.trim(x)), lambda x: x != "")


def trim_at_boundary(text: Column, limit: int) -> Column:
    """At most limit characters, cut behind the last sentence end among them."""
    head = F.substring(text, 1, limit)
    cut = F.regexp_extract(head, r"(?s)^(.*[。！？.!?])", 1)
    return F.when(F.length(text) <= limit, text).when(cut != "", cut).otherwise(head)


def best_fuzzy(query: Column, alias: Column) -> Column:
    """The window of the query nearest to an alias: struct(score, size, start, text), null if none is near enough.

    Windows have the alias's length, one more or less for aliases of three or
    more other than CJK characters. One edit is allowed up to four characters,
    beyond them two and a similarity of .78.
    """
    size, empty = F.length(alias), F.array().cast("array<int>")
    wide = (size >= 3) & ~alias.rlike(f"^[{CJK}]+$")
    widths = F.when(wide, F.array(size, size - 1, size + 1)).otherwise(F.array(size))
    starts = lambda w: F.when((w > 0) & (w <= F.length(query)), F.sequence(F.lit(1), F.length(query) - w + 1)).otherwise(empty)

    def window(w: Column, s: Column) -> Column:
        text = F.substring(query, s, w)
        d = F.levenshtein(text, alias)
        like = 1 - d / F.greatest(F.length(text), size)
        ok = (F.trim(text) != "") & (~alias.rlike(r"^\p{ASCII}*$") | text.rlike(r"^\p{ASCII}*$"))
        ok = ok & F.when(size <= 4, d <= 1).otherwise((d <= 2) & (like >= 0.78))
        return F.when(ok, F.struct(F.round(F.greatest(like, F.lit(0.78)), 2).alias("score"), w.alias("size"), (-s).alias("start"), text.alias("text")))

    every = F.flatten(F.transform(widths, lambda w: F.transform(starts(w), lambda s: window(w, s))))
    return F.array_max(F.array_compact(every))
