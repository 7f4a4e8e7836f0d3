"""Documents of a request prepared for sentiment: skips, text and its level, sentences about the request's entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidrel.functions import text as X

# Fixed values.
SKIPPED_PRODUCTS = ["out_of_scope", "product_info", "trading_rule_fee"]
SUPPORTED_SOURCES = ["news", "announcement", "research_note", "product_doc"]
COMPANY = r"[A-Z\x{4e00}-\x{9fff}]{2,}(?:公司|股份|集团|银行|证券|保险|实业|控股)"
EVENT = r"([A-Z\x{4e00}-\x{9fff}]{2,8})(?:发布|披露|公告|股价|财报|业绩)"
NO_ENTITY = ["市场", "行业", "板块"]


def query_skip(product: Column) -> Column:
    """Why a whole request is skipped; null if it is not."""
    return F.when(product.isin(SKIPPED_PRODUCTS), F.concat(F.lit("product_type="), product))


def document_skip(source_type: Column, text: Column) -> Column:
    """Why a document is skipped; null if it is not."""
    kind = F.coalesce(source_type, F.lit(""))
    return F.when(~kind.isin(SUPPORTED_SOURCES), F.concat(F.lit("unsupported source_type="), kind)).when(text == "", "empty text after extraction")


def text_and_level(body: Column, available: Column, title: Column, summary: Column) -> tuple[Column, Column]:
    """The body if it is available, else title and summary, else the title; full only with a body."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    has = F.coalesce(available, F.lit(False))
    short = F.when(some(summary), F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), summary)).otherwise(F.coalesce(title, F.lit("")))
    text = X.normalize_text(F.when(has, F.coalesce(body, F.lit(""))).otherwise(short))
    return text, F.when(has & some(body), "full").otherwise("short")


def names_others(sentence: Column, names: Column) -> Column:
    """Whether a sentence names a company, or something with an event, that is none of the names."""
    companies = F.regexp_extract_all(sentence, F.lit(COMPANY), F.lit(0))
    actors = F.array_except(F.regexp_extract_all(sentence, F.lit(EVENT), F.lit(1)), F.array(*map(F.lit, NO_ENTITY)))
    return F.size(F.array_except(F.concat(companies, actors), names)) > 0


def relevant(sentences: Column, names: Column, symbols: Column, title: Column) -> tuple[Column, Column]:
    """The sentences about named entities, then those about none, and the symbols found in order.

    Sentences that name others only go. If none is left: the title and the first
    three sentences, and no symbols. Without names all sentences stay. names and
    symbols go together by position; a sentence counts for the first name it
    holds. Names that differ by a few signs are not looked for.
    """
    first = lambda s: F.get(F.filter(F.arrays_zip(names.alias("name"), symbols.alias("symbol")), lambda e: F.contains(s, e["name"])), F.lit(0))
    marked = F.transform(sentences, lambda s: F.struct(s.alias("s"), first(s)["symbol"].alias("symbol"), first(s).isNotNull().alias("strong"), names_others(s, names).alias("other")))
    strong = F.filter(marked, lambda m: m["strong"])
    kept = F.transform(F.concat(strong, F.filter(marked, lambda m: ~m["strong"] & ~m["other"])), lambda m: m["s"])
    head = F.slice(F.filter(sentences, lambda s: F.trim(s) != ""), 1, 3)
    fallback = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.array(title), head)).otherwise(head)
    named = F.size(names) > 0
    text = F.when(~named, sentences).when(F.size(kept) > 0, kept).otherwise(fallback)
    return text, F.when(named, F.array_distinct(F.transform(strong, lambda m: m["symbol"]))).otherwise(F.array().cast("array<string>"))


def prepared(docs: DataFrame) -> DataFrame:
    """docs (product_type of the request, names, symbols, source_type, body, body_available, title, summary) with
    query_skip, skip, text, text_level, language, sentences and entity_hits; of skipped documents the last four are empty.

    Requests that are skipped have no rows, as they analyse no documents.
    """
    text, level = text_and_level(F.col("body"), F.col("body_available"), F.col("title"), F.col("summary"))
    out = docs.where(query_skip(F.col("product_type")).isNull()).withColumns({"text": text, "text_level": level})
    out = out.withColumn("skip", document_skip(F.col("source_type"), F.col("text")))
    out = out.withColumn("language", F.when(F.col("skip").isNull(), X.detect_language(F.col("text"))).otherwise("unknown"))
    out = out.withColumn("parts", F.when(F.col("skip").isNull(), X.sentences(F.col("text"), F.col("language"))).otherwise(F.array().cast("array<string>")))
    kept, hits = relevant(F.col("parts"), F.col("names"), F.col("symbols"), F.col("title"))
    none = F.array().cast("array<string>")
    return out.withColumns({"sentences": F.when(F.col("skip").isNull(), kept).otherwise(none), "entity_hits": F.when(F.col("skip").isNull(), hits).otherwise(none)}).drop("parts")


def filter_meta(docs: DataFrame, *keys: str) -> DataFrame:
    """Skipped, analysed and short documents of each key."""
    skipped = F.col("skip").isNotNull()
    return docs.groupBy(*keys).agg(F.count_if(skipped).alias("skipped"), F.count_if(~skipped).alias("analyzed"), F.count_if(~skipped & (F.col("text_level") == "short")).alias("short"))
