"""Source plans: candidates scored by a learned reranker, chosen and put in order by rules; coverage of comparison targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidrel.functions.text import any_of
from evidrel.learning import hashed, linear
from evidrel.operators.understanding import SOURCE_ORDER

# Markers, labels that are features, least score of a source, and scopes of the rules.
COMPARE_MARKERS = ["比", "相比", "哪个", "谁更", "更稳", "更好", "有什么区别", "有何区别", "有什么不同", "有啥不同", "差别", "一回事吗"]
WHY_MARKERS = ["为什么", "为啥", "咋", "咋回事", "啥原因", "什么原因"]
ADVICE_MARKERS = ["值得", "能买吗", "买吗", "买入", "卖出", "上车", "止盈", "止损", "持有", "拿吗", "还能拿吗", "还能不能拿", "适合长期拿", "适不适合"]
INTENTS = ["market_explanation", "hold_judgment", "buy_sell_timing", "product_info", "trading_rule_fee", "peer_compare", "fundamental_analysis", "valuation_analysis", "macro_policy_impact", "event_news_query", "risk_analysis"]
TOPICS = ["price", "news", "industry", "macro", "policy", "fundamentals", "valuation", "risk", "comparison", "product_mechanism"]
LEAST_SCORE, UNRANKED = 0.42, 99.0
STRUCTURED = ["market_api", "fundamental_sql", "industry_sql"]
MECHANISM = ["faq", "product_doc", "research_note"]
BUCKET_SOURCES = ["news", "industry_sql", "research_note", "macro_sql"]


def features(query: Column, product: Column, intents: Column, topics: Column, scope: Column, source: Column, rule_plan: Column, bucket: Column) -> Column:
    """Named features of a candidate source: map<string, double>; a text's value is part of its name."""
    number = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    place = F.array_position(rule_plan, source)
    plain = {
        "rule_contains_source": number(place > 0), "rule_rank": F.when(place > 0, (place - 1).cast("double")).otherwise(UNRANKED), "is_bucket_market_query": number(bucket),
        "has_compare_marker": number(any_of(query, COMPARE_MARKERS)), "has_why_marker": number(any_of(query, WHY_MARKERS)), "has_advice_marker": number(any_of(query, ADVICE_MARKERS)),
    }
    plain |= {f"intent:{n}": number(F.array_contains(intents, n)) for n in INTENTS} | {f"topic:{n}": number(F.array_contains(topics, n)) for n in TOPICS}
    kinds = [F.concat(F.lit(k + "="), F.coalesce(c, F.lit(""))) for k, c in (("product_type", product), ("time_scope", scope), ("source", source))]
    return F.create_map(*[x for k, c in plain.items() for x in (F.lit(k), c)], *[x for k in kinds for x in (k, F.lit(1.0))])


def candidate_rows(requests: DataFrame, bucket: Column) -> DataFrame:
    """requests (query, product_type, intent_labels, topic_labels, time_scope, source_plan) times the nine sources, with features."""
    rows = requests.withColumn("source", F.explode(F.array(*map(F.lit, SOURCE_ORDER))))
    return rows.withColumn("features", features(F.col("query"), F.col("product_type"), F.col("intent_labels"), F.col("topic_labels"), F.col("time_scope"), F.col("source"), F.col("source_plan"), bucket))


def fit(rows: DataFrame, key: Column, target: Column) -> linear.Linear | None:
    """A reranker from candidate rows and whether their source is right."""
    pairs = F.transform(F.map_entries("features"), lambda e: F.struct(e["key"].alias("k"), F.when(e["key"] == "rule_rank", e["value"] / UNRANKED).otherwise(e["value"]).alias("v")))
    return linear.fit(rows.select(key.alias("row_key"), pairs.alias("pairs"), target.cast("int").alias("target")), "row_key", "pairs", {"target": F.col("target")}, hashed.BUCKETS, _named, first=1.0)


def _named(values: list) -> list[hashed.Row]:
    return hashed.named([{x["k"]: x["v"] for x in v or []} for v in values])


def scored(rows: DataFrame, model: linear.Linear) -> DataFrame:
    """Candidate rows with the score of their source: the probability, raised where the query names the kind; conflicting sources go."""
    pairs = F.transform(F.map_entries("features"), lambda e: F.struct(e["key"].alias("k"), F.when(e["key"] == "rule_rank", e["value"] / UNRANKED).otherwise(e["value"]).alias("v")))
    kept = rows.where(~(F.contains("query", F.lit("公告")) & F.col("source").isin("news", *STRUCTURED)))
    p = linear.predict(kept.withColumn("pairs", pairs), model, "pairs", _named, exclusive=False)
    named = ((F.col("source") == "announcement") & F.contains("query", F.lit("公告"))) | ((F.col("source") == "news") & (F.contains("query", F.lit("新闻")) | F.contains(F.lower("query"), F.lit("news"))))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.element_at("probabilities", 1) + F.when(named, 2.0).otherwise(0.0)))
    return p.withColumn("score", F.round(score, 4)).drop("probabilities", "pairs")


def ranked(scores: DataFrame, *keep: str) -> DataFrame:
    """keep and ``scored``: the sources of a request with their scores, best first, equal ones in their fixed order."""
    place = F.array_position(F.array(*map(F.lit, SOURCE_ORDER)), F.col("source"))
    items = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), place.alias("place"), "source", "score")))  # nine at most
    each = scores.groupBy(*keep).agg(items.alias("s"))
    return each.select(*keep, F.transform("s", lambda x: F.struct(x["source"], x["score"])).alias("scored"))


def _without(sources: Column, names: list[str]) -> Column:
    return F.filter(sources, lambda s: ~s.isin(names))


def _first(sources: Column, name: str) -> Column:
    return F.concat(F.array(F.lit(name)), _without(sources, [name]))


def _with(sources: Column, names: list[str], plan: Column) -> Column:
    """sources, then those of the names that the plan has and they lack."""
    return F.concat(sources, F.array_except(F.filter(F.array(*map(F.lit, names)), lambda s: F.array_contains(plan, s)), sources))


def applied(scored_sources: Column, rule_plan: Column, query: Column, product: Column, intents: Column, topics: Column, mechanism: Column, bucket: Column, general: Column, fundamental: Column, disclosure: Column) -> Column:
    """The plan that the scores and the ordered rules give; each source once.

    Sources of LEAST_SCORE and the first two of the rule plan stay, else all of
    the rule plan. mechanism, bucket, general, fundamental and disclosure say
    what kind of query it is.
    """
    has, topic = (lambda *n: F.arrays_overlap(intents, F.array(*map(F.lit, n)))), (lambda *n: F.arrays_overlap(topics, F.array(*map(F.lit, n))))
    inside, planned = (lambda s, n: F.array_contains(s, n)), (lambda n: F.array_contains(rule_plan, n))
    notice = F.contains(query, F.lit("公告"))
    event, stock = has("event_news_query"), product == "stock"
    out = F.transform(F.filter(scored_sources, lambda x: (x["score"] >= LEAST_SCORE) | F.array_contains(F.slice(rule_plan, 1, 2), x["source"])), lambda x: x["source"])
    out = F.when(F.size(out) > 0, out).otherwise(rule_plan)
    basic = ["fundamental_analysis", "valuation_analysis"]
    either = lambda when, then: lambda out: F.when(when(out) if callable(when) else when, then(out)).otherwise(out)

    def whitelist(out: Column) -> Column:
        kept = F.filter(out, lambda s: s.isin(MECHANISM))
        return F.concat(kept, F.array_except(F.array(*map(F.lit, MECHANISM)), kept))

    both = lambda out: inside(out, "announcement") & inside(out, "news")
    lacks = lambda kind, name: either(lambda out: kind & ~inside(out, name), lambda out: _first(out, name))
    rules = [
        either(mechanism, whitelist),
        lambda out: F.when(both(out) & event & notice, _first(out, "announcement")).when(both(out) | (inside(out, "news") & inside(out, "research_note")), _first(out, "news")).otherwise(out),
        either(event, lambda out: _without(out, STRUCTURED)),
        lacks(has("market_explanation") & stock & planned("market_api"), "market_api"),
        lacks(general, "research_note"), lacks(fundamental, "research_note"), lacks(disclosure, "announcement"),
        either(lambda out: inside(out, "fundamental_sql") & has(*basic), lambda out: _first(out, "fundamental_sql")),
        either(has("hold_judgment", "buy_sell_timing", *basic), lambda out: _with(out, ["fundamental_sql"], rule_plan)),
        either(event | notice | F.contains(query, F.lit("新闻")), lambda out: _without(out, STRUCTURED)),
        either(stock & has("risk_analysis"), lambda out: _without(out, ["faq"])),
        either(stock & has("hold_judgment", "buy_sell_timing", "risk_analysis", *basic), lambda out: _without(out, ["faq", "product_doc"])),
        either(~has("macro_policy_impact") & ~topic("macro", "policy") & ~planned("macro_sql"), lambda out: _without(out, ["macro_sql"])),
        either(bucket & ~disclosure, lambda out: F.filter(out, lambda s: s.isin(BUCKET_SOURCES))),
    ]
    for rule in rules:  # each rule reads the list several times: it is bound to a variable, so expressions stay small
        out = F.get(F.transform(F.array(out), rule), F.lit(0))
    return F.array_distinct(out)


def targets_covered(targets: Column, tokens: Column) -> Column:
    """Whether every target is, holds or lies in a token (mention, name or symbol) of an entity; without targets, whether there are two entities' worth of them.

    tokens: array of arrays, one for each entity; nulls and empty ones do not count.
    """
    flat = F.filter(F.flatten(tokens), lambda t: F.coalesce(t != "", F.lit(False)))
    met = F.forall(targets, lambda x: F.exists(flat, lambda t: F.contains(t, x) | F.contains(x, t)))
    return F.when(F.coalesce(F.size(targets), F.lit(0)) <= 0, F.size(tokens) >= 2).otherwise((F.size(tokens) > 0) & met)
