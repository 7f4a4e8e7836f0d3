"""The analysis summary of a request: signals of its structured items and what data there is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidrel.functions import scalars as S

# Which sources give which signal.
MARKET, MACRO = ["market_api", "index_daily"], ["macro_sql", "macro_indicator"]
PRICED = ["market_api", "index_daily", "fund_nav"]


def one_or_many(signals: Column) -> Column:
    """JSON: null without signals, an object for one, else a list."""
    return F.when(F.size(signals) == 1, F.to_json(F.get(signals, F.lit(0)))).when(F.size(signals) > 1, F.to_json(signals))


def market_signals(items: DataFrame, fields: list[str]) -> DataFrame:
    """(query_id, market): one signal for each symbol, else name, in the order in which they come first.

    items: query_id, ord, source_type, symbol, canonical_name, analysed and
    ``fields``. Of a symbol the last market_api item counts, else the first of
    index_daily; items without analysis count for nothing, items without symbol
    and name each for themselves.
    """
    api = F.col("source_type") == "market_api"
    rows = items.where(F.col("source_type").isin(MARKET) & F.coalesce("analysed", F.lit(False)))
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    rows = rows.withColumn("key", F.coalesce(filled("symbol"), filled("canonical_name"), F.concat(F.lit("__"), F.col("ord").cast("string"))))
    best = F.struct(api.cast("int").alias("a"), F.when(api, F.col("ord")).otherwise(-F.col("ord")).alias("o"))
    one = rows.groupBy("query_id", "key").agg(F.max_by(F.struct("symbol", *fields), best).alias("signal"), F.min("ord").alias("first"))
    each = one.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("first", "key", "signal"))).alias("s"))  # a request's symbols
    return each.select("query_id", F.transform("s", lambda x: x["signal"]).alias("market"))


def fundamental_signals(items: DataFrame) -> DataFrame:
    """(query_id, fundamental): symbol, report date, ratios and what the price over earnings says, in order."""
    rows = items.where("source_type = 'fundamental_sql'")
    signal = F.struct("symbol", "report_date", "pe_ttm", "pb", "roe", S.valuation(F.col("pe_ttm")).alias("valuation_assessment"))
    each = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("ord", signal.alias("signal")))).alias("s"))  # a request's symbols
    return each.select("query_id", F.transform("s", lambda x: x["signal"]).alias("fundamental"))


def macro_signals(items: DataFrame) -> DataFrame:
    """(query_id, indicators, overall): directions of the indicators with a code, and what most of them say; overall is null without indicators."""
    rows = items.where(F.col("source_type").isin(MACRO)).withColumn("direction", S.macro_direction(F.col("indicator_code"), F.col("metric_value")))
    known = F.coalesce(F.col("indicator_code"), F.lit("")) != ""
    signal = F.struct("ord", F.struct("indicator_code", "metric_value", "direction").alias("signal"))
    each = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.when(known, signal))).alias("s"))  # a request's indicators
    each = each.select("query_id", F.transform("s", lambda x: x["signal"]).alias("indicators"))
    return each.withColumn("overall", F.when(F.size("indicators") > 0, S.macro_overall(F.transform("indicators", lambda x: x["direction"]))))


def readiness(items: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, has_...): which kinds of data a request's items and documents (query_id, source_type) bring."""
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    of = F.col("source_type")
    data = items.groupBy("query_id").agg(
        some(of.isin(PRICED)).alias("has_price_data"), some(of == "fundamental_sql").alias("has_fundamentals"), some(of.isin(MACRO)).alias("has_macro"),
        some(of.isin(MARKET) & F.coalesce("analysed", F.lit(False))).alias("has_technical_indicators"),
    )
    news = documents.groupBy("query_id").agg(some(of == "news").alias("has_news"))
    return data.join(news, "query_id", "full_outer")


FLAGS = ["has_price_data", "has_fundamentals", "has_macro", "has_news", "has_technical_indicators"]


def analysis_summary(requests: DataFrame, items: DataFrame, documents: DataFrame, fields: list[str]) -> DataFrame:
    """One row a request (query_id, intent_labels, topic_labels): signals, readiness flags and sorted labels."""
    labels = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    out = requests.select("query_id", labels("intent_labels").alias("relevant_intents"), labels("topic_labels").alias("relevant_topics"))
    for part in (market_signals(items, fields), fundamental_signals(items), macro_signals(items), readiness(items, documents)):
        out = out.join(part, "query_id", "left")
    return out.withColumns({f: F.coalesce(f, F.lit(False)) for f in FLAGS})
