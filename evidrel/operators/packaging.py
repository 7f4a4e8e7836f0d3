"""Packaging of evidence: coverage, confidence, provenance, quality flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which source types cover what; "d:" marks document sources.
COVERAGE = {
    "price": ["market_api", "index_daily", "fund_nav"],
    "news": ["d:news"],
    "industry": ["industry_sql"],
    "fundamentals": ["fundamental_sql"],
    "announcement": ["d:announcement"],
    "product_mechanism": ["d:faq", "d:product_doc", "fund_fee", "fund_redemption", "fund_profile"],
    "macro": ["macro_sql", "macro_indicator", "policy_event"],
    "risk": ["market_api", "fundamental_sql", "index_valuation", "fund_fee", "fund_redemption", "macro_indicator", "d:research_note", "d:announcement", "d:faq", "d:product_doc"],
}
DETAIL = {
    "price_history": ["market_api"],
    "financials": ["fundamental_sql"],
    "valuation": ["index_valuation", "fundamental_sql"],
    "industry_snapshot": ["industry_sql"],
    "fund_nav": ["fund_nav"],
    "fund_fee": ["fund_fee"],
    "fund_redemption": ["fund_redemption"],
    "fund_profile": ["fund_profile"],
    "index_daily": ["index_daily"],
    "index_valuation": ["index_valuation"],
    "macro_indicator": ["macro_indicator", "macro_sql"],
    "policy_event": ["policy_event"],
}
METADATA = ["source_name", "provider", "source_url", "provider_endpoint", "query_params", "source_reference"]


def coverage(items: DataFrame, kind: dict[str, list[str]] = COVERAGE) -> DataFrame:
    """Flags of each query from (query_id, source_type, is_document)."""
    tag = F.when(F.col("is_document"), F.concat(F.lit("d:"), "source_type")).otherwise(F.col("source_type"))
    return items.groupBy("query_id").agg(*[F.bool_or(tag.isin(types)).alias(name) for name, types in kind.items()])


def comparison_coverage(items: DataFrame, requests: DataFrame) -> DataFrame:
    """(query_id, comparison): a request that compares (by intent or topic) and whose evidence names two symbols or more.

    items: (query_id, symbols), the symbols of a document's entities or of a
    payload; requests: (query_id, intent_labels, topic_labels).
    """
    has = lambda c, x: F.coalesce(F.array_contains(c, x), F.lit(False))
    asks = requests.where(has("intent_labels", "peer_compare") | has("topic_labels", "comparison")).select("query_id")
    each = items.join(asks, "query_id").select("query_id", F.explode("symbols").alias("symbol")).where("symbol is not null and symbol != ''").distinct()
    several = each.groupBy("query_id").agg((F.count(F.lit(1)) >= 2).alias("comparison"))
    return requests.select("query_id").join(several, "query_id", "left").select("query_id", F.coalesce("comparison", F.lit(False)).alias("comparison"))


def all_coverage(items: DataFrame, requests: DataFrame) -> DataFrame:
    """The nine flags of every request that has an item: eight by source type, and comparison."""
    return coverage(items).join(comparison_coverage(items, requests), "query_id")


def warnings(requests: DataFrame, flags: DataFrame, provider: DataFrame) -> DataFrame:
    """(query_id, warnings): of the request's risks, of missing announcements, then each provider warning once.

    requests: (query_id, risk_flags, source_plan); flags: (query_id,
    announcement); provider: (query_id, ord, warning).
    """
    has = lambda c, x: F.coalesce(F.array_contains(c, x), F.lit(False))
    first = provider.groupBy("query_id", "warning").agg(F.min("ord").alias("ord"))
    mine = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", "warning"))).alias("w"))
    rows = requests.join(flags.select("query_id", "announcement"), "query_id", "left").join(mine, "query_id", "left")
    own = F.array_compact(F.array(
        F.when(has("risk_flags", "out_of_scope_query"), "out_of_scope_query"),
        F.when(has("risk_flags", "clarification_required"), "clarification_required_missing_entity"),
        F.when(has("source_plan", "announcement") & ~F.coalesce("announcement", F.lit(False)), "announcement_not_found_recent_window"),
    ))
    return rows.select("query_id", F.array_distinct(F.concat(own, F.coalesce(F.col("w.warning"), F.array().cast("array<string>")))).alias("warnings"))


def as_of(payload: dict[str, Column]) -> Column:
    """The first date of a payload that is neither null nor empty: as_of, trade, report, metric date."""
    return first_filled(payload, ["as_of", "trade_date", "report_date", "metric_date"])


def period(payload: dict[str, Column]) -> Column:
    """As as_of, but the period's own name comes first and the report date before the trade date."""
    return first_filled(payload, ["period", "report_date", "trade_date", "metric_date"])


def first_filled(payload: dict[str, Column], names: list[str]) -> Column:
    own = [F.nullif(payload[n].cast("string"), F.lit("")) for n in names if n in payload]
    return F.coalesce(*own) if own else F.lit(None).cast("string")


def retrieval_confidence(ranked: DataFrame, flags: DataFrame, names: list[str]) -> DataFrame:
    """(query_id, confidence): mean of the mean of the top three rank scores (.7 where missing) and the part of flags set."""
    top = ranked.where("position <= 3").groupBy("query_id").agg(F.avg(F.coalesce("rank_score", F.lit(0.7))).alias("top"))
    part = sum(F.coalesce(F.col(n), F.lit(False)).cast("int") for n in names) / len(names)
    both = flags.join(top, "query_id", "left")
    return both.select("query_id", F.round((F.coalesce("top", F.lit(0.0)) + part) / 2, 2).alias("confidence"))


# Sources that a live provider has, those of funds and indices, and words that ask for fund data.
LIVE_SOURCES = ["market_api", "fundamental_sql", "industry_sql", "fund_nav", "fund_fee", "fund_redemption", "fund_profile", "index_daily", "index_valuation"]
FUND_SOURCES, INDEX_SOURCES = ["fund_nav", "fund_fee", "fund_profile", "fund_redemption"], ["index_daily", "index_valuation"]
FUND_WORDS = ["费率", "申赎", "赎回", "净值", "定投", "机制"]


def live_sources(plan: Column, product: Column, intents: Column, topics: Column, query: Column) -> Column:
    """The planned live sources, and those that a question about a fund or an index asks for; sorted."""
    of = lambda names: F.array(*map(F.lit, names))
    meets = lambda c, names: F.coalesce(F.arrays_overlap(c, of(names)), F.lit(False))
    fund = meets(topics, ["product_mechanism", "comparison"]) | meets(intents, ["product_info", "trading_rule_fee", "peer_compare"]) | F.coalesce(query.rlike("|".join(FUND_WORDS)), F.lit(False))
    more = F.when(product.isin("etf", "fund") & fund, of(FUND_SOURCES)).when(product == "index", of(INDEX_SOURCES)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_union(F.array_intersect(of(LIVE_SOURCES), F.coalesce(plan, F.array().cast("array<string>"))), more))


def expanded_items(rows: DataFrame, payloads: dict[str, Column], column: str = "close") -> DataFrame:
    """One item of each request, symbol and live source with a payload: evidence_id is the source and the symbol.

    rows: (query_id, symbol, live) and what the payload columns read.
    """
    of = F.create_map(*[x for k, c in payloads.items() for x in (F.lit(k), c)])
    each = rows.select("query_id", "symbol", F.explode("live").alias("source_type"), of.alias("payloads")).withColumn(column, F.element_at("payloads", F.col("source_type")))
    return each.where(F.col(column).isNotNull()).withColumn("evidence_id", F.concat_ws("_", "source_type", "symbol")).drop("payloads")


def warning_item(symbol: Column, provider: Column, error: Column, text: Column) -> dict[str, Column]:
    """The row that stands for a provider's failure; its text is one line of 180 characters at most."""
    line = F.replace(F.trim(text), F.lit("\n"), F.lit(" "))
    short = F.when(F.length(line) > 180, F.concat(F.substring(line, 1, 177), F.lit("..."))).otherwise(line)
    return {
        "evidence_id": F.concat(F.lit("market_provider_warning_"), symbol), "source_type": F.lit("provider_warning"), "source_name": provider,
        "warning": F.concat(F.lit("market_provider_fetch_failed:"), symbol, F.lit(":"), error, F.lit(":"), short),
    }


def package(requests: DataFrame, docs: DataFrame, items: DataFrame, counts: DataFrame, provider: DataFrame | None = None) -> DataFrame:
    """One row of each request: counts, documents and structured data as arrays, flags, warnings and confidence.

    docs: selected documents (query_id, position, evidence_id, source_type,
    entity_symbols, rank_score); items: structured rows (query_id, evidence_id,
    source_type, symbol); counts: (query_id, n_candidates); provider: (query_id,
    ord, warning). A request without evidence keeps its row, all flags unset.
    """
    spark = requests.sparkSession
    provider = spark.createDataFrame([], "query_id long, ord int, warning string") if provider is None else provider
    parts = docs.select("query_id", "source_type", F.lit(True).alias("is_document"), F.col("entity_symbols").alias("symbols"))
    parts = parts.unionByName(items.select("query_id", "source_type", F.lit(False).alias("is_document"), F.array("symbol").alias("symbols")))
    flags = requests.select("query_id").join(coverage(parts), "query_id", "left").join(coverage(parts, DETAIL), "query_id", "left").join(comparison_coverage(parts, requests), "query_id", "left")
    flags = flags.select("query_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in flags.columns if c != "query_id"])
    own = docs.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", "evidence_id", "source_type", "rank_score"))).alias("documents"))
    rows = items.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("source_type", "evidence_id"))).alias("structured_data"))
    score = retrieval_confidence(docs, flags, [*COVERAGE, "comparison"])
    out = requests.select("query_id", "source_plan").join(flags, "query_id").join(own, "query_id", "left").join(rows, "query_id", "left").join(score, "query_id")
    out = out.join(warnings(requests, flags, provider), "query_id").join(counts, "query_id", "left")
    n = F.greatest(F.coalesce(F.size("documents"), F.lit(0)), F.lit(0)).cast("long")
    return out.withColumns({"n_candidates": F.coalesce("n_candidates", F.lit(0).cast("long")), "n_documents": n, "top_ranked": F.coalesce(F.array_join(F.slice("documents.evidence_id", 1, 5), ","), F.lit(""))})


def field_coverage(payload: dict[str, Column]) -> dict[str, Column]:
    """total_fields, non_null_fields and sorted missing_fields of a typed payload, metadata aside."""
    own = {k: c for k, c in payload.items() if k not in METADATA}
    missing = F.array_compact(F.array(*[F.when(own[k].isNull(), F.lit(k)) for k in sorted(own)]))
    return {"total_fields": F.lit(len(own)), "non_null_fields": F.lit(len(own)) - F.size(missing), "missing_fields": missing}


def quality_flags(source_name: Column, source_url: Column, payload: dict[str, Column]) -> Column:
    own = {k: c for k, c in payload.items() if k not in METADATA}
    some = F.exists(F.array(*[c.isNull() for c in own.values()]), lambda x: x) if own else F.lit(False)
    return F.array_compact(F.array(
        F.when(F.contains(F.lower(F.coalesce(source_name, F.lit(""))), F.lit("seed")), "seed_source"),
        F.when(F.coalesce(source_url, F.lit("")) == "", "missing_source_url"),
        F.lit("empty_payload") if not own else F.when(some, "missing_values"),
    ))


def document_reference(url: Column, source: Column, ref: Column) -> Column:
    """The address, else dataset://source/ref with underscores for spaces."""
    tidy = lambda c: F.replace(F.trim(c.cast("string")), F.lit(" "), F.lit("_"))
    made = F.when((F.coalesce(source, F.lit("")) != "") & ref.isNotNull(), F.concat(F.lit("dataset://"), tidy(source), F.lit("/"), tidy(ref)))
    return F.coalesce(F.nullif(url, F.lit("")), made)


def api_reference(endpoint: Column, params: Column, source: Column) -> Column:
    """api://endpoint?params, else provider://source; params is a map."""
    code = lambda c: F.url_encode(c.cast("string"))
    query = F.array_join(F.transform(F.map_entries(params), lambda e: F.concat(code(e["key"]), F.lit("="), code(e["value"]))), "&")
    api = F.when(F.coalesce(query, F.lit("")) != "", F.concat(F.lit("api://"), endpoint, F.lit("?"), query)).otherwise(F.concat(F.lit("api://"), endpoint))
    named = F.when(F.coalesce(source, F.lit("")) != "", F.concat(F.lit("provider://"), F.replace(F.trim(source), F.lit(" "), F.lit("_"))))
    return F.when(F.coalesce(endpoint, F.lit("")) != "", api).otherwise(named)


def excerpt(summary: Column, body: Column, limit: int = 500) -> Column:
    text = F.trim(F.coalesce(F.nullif(summary, F.lit("")), body, F.lit("")))
    return F.nullif(F.substring(text, 1, limit), F.lit(""))


def reasons(features: dict[str, Column], least: float = 0.8, most: int = 3) -> Column:
    """The first names, in the order given, whose value is high."""
    return F.slice(F.array_compact(F.array(*[F.when(c >= least, F.lit(k)) for k, c in features.items()])), 1, most)
