"""The roles that the star-schema tables play: prices, evidence documents, query requests, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrel.plans.registry import read

SOURCES = ["news", "announcement", "faq", "product_doc", "research_note"]


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, trade_date, close): of each order priority the price of the day's last order."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("trade_date"), "o_totalprice", "o_orderkey")
    return o.groupBy("symbol", "trade_date").agg(F.max_by("o_totalprice", "o_orderkey").alias("close"))


PRICES = """prices AS (
  SELECT o_orderpriority AS symbol, strftime(o_orderdate, '%Y-%m-%d') AS trade_date, arg_max(o_totalprice, o_orderkey) AS close FROM orders GROUP BY 1, 2
)"""


def cycle(key: str, values: list) -> F.Column:
    """One of the values by the id modulo their number: made-up attributes of the roles."""
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


PRODUCTS = ["stock", "etf", "fund", "index", "generic_market"]
SCOPES = ["today", "recent_3d", "recent_1w", "recent_1m", "recent_1q", "long_term", "unspecified"]
AS_OF = "TIMESTAMP '2024-06-30 00:00:00'"


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as evidence: title is the first line, source_type one of five by source, credibility by source type.

    Every third document is about the entity that its source names; product and
    date of publication (some have none) follow the id.
    """
    d = read(spark, sf_dir, "documents")
    kind = F.element_at(F.array(*map(F.lit, SOURCES)), (F.pmod(F.regexp_extract("source", r"(\d+)", 1).cast("int"), F.lit(5)) + 1).cast("int"))
    return d.select(
        "doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("evidence_id"), kind.alias("source_type"), F.col("source").alias("source_name"),
        F.substring_index("text", "\n", 1).alias("title"), F.substring("text", 1, 300).alias("summary"), F.col("text").alias("body"), "lang",
        (F.lit(0.5) + F.pmod("doc_id", F.lit(5)) / 10).alias("credibility_score"),
        F.when(F.col("doc_id") % 3 == 0, F.array("source")).otherwise(F.array().cast("array<string>")).alias("entity_symbols"),
        cycle("doc_id", PRODUCTS).alias("product_type"),
        F.when(F.col("doc_id") % 9 != 0, F.expr(AS_OF) - F.make_dt_interval((F.col("doc_id") % 400).cast("int"))).alias("publish_time"),
    )


EVIDENCE = f"""evidence AS (
  SELECT doc_id, 'd' || doc_id AS evidence_id, ['news', 'announcement', 'faq', 'product_doc', 'research_note'][CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) % 5 + 1] AS source_type,
    source AS source_name, string_split(text, chr(10))[1] AS title, substr(text, 1, 300) AS summary, text AS body, lang, 0.5::DOUBLE + (doc_id % 5)::DOUBLE / 10 AS credibility_score,
    CASE WHEN doc_id % 3 = 0 THEN [source] ELSE [] END AS entity_symbols, {PRODUCTS}[CAST(doc_id % 5 AS INT) + 1] AS product_type,
    CASE WHEN doc_id % 9 <> 0 THEN {AS_OF} - to_days(CAST(doc_id % 400 AS INT)) END AS publish_time FROM documents
)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """benchmark items as queries with the first three words as keywords and a plan of three sources.

    The fifth word is an entity's name, the seventh of some an industry term;
    symbols, product, labels, scope and risks follow the id.
    """
    b = read(spark, sf_dir, "benchmark")
    every = F.array(*map(F.lit, SOURCES))
    words, k, none = F.split("text", " "), F.col("item_id"), F.array().cast("array<string>")
    symbol = lambda n: F.concat(F.lit("src"), F.pmod(k + n, F.lit(20)).cast("string"))
    some = lambda when, *values: F.when(when, F.array(*values)).otherwise(none)
    return b.select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.slice(words, 1, 3).alias("keywords"), F.slice(every, F.pmod("item_id", F.lit(3)).cast("int") + 1, 3).alias("source_plan"),
        F.slice(words, 5, 1).alias("entity_names"), F.when(k % 4 == 1, F.array(symbol(0))).when(k % 4 == 2, F.array(symbol(1), symbol(6), symbol(11))).otherwise(none).alias("symbols"),
        F.when(k % 3 == 0, F.slice(words, 7, 1)).otherwise(none).alias("industry_terms"), cycle("item_id", PRODUCTS).alias("product_type"),
        F.when(k % 4 == 0, F.array(F.lit("product_info"))).when(k % 4 == 2, F.array(F.lit("peer_compare"), F.lit("hold_judgment"))).otherwise(none).alias("intent_labels"),
        some(k % 6 == 1, F.lit("comparison")).alias("topic_labels"), cycle("item_id", SCOPES).alias("time_scope"),
        F.when(k % 11 == 0, F.array(F.lit("out_of_scope_query"))).when(k % 11 == 1, F.array(F.lit("clarification_required"))).otherwise(none).alias("risk_flags"),
    )


REQUESTS = f"""requests AS (
  SELECT item_id AS query_id, text AS query, string_split(text, ' ')[1:3] AS keywords,
    ['news', 'announcement', 'faq', 'product_doc', 'research_note'][CAST(item_id % 3 AS INT) + 1 : CAST(item_id % 3 AS INT) + 3] AS source_plan,
    string_split(text, ' ')[5:5] AS entity_names, CASE item_id % 4 WHEN 1 THEN ['src' || item_id % 20] WHEN 2 THEN ['src' || (item_id + 1) % 20, 'src' || (item_id + 6) % 20, 'src' || (item_id + 11) % 20] ELSE [] END AS symbols,
    CASE WHEN item_id % 3 = 0 THEN string_split(text, ' ')[7:7] ELSE [] END AS industry_terms, {PRODUCTS}[CAST(item_id % 5 AS INT) + 1] AS product_type,
    CASE item_id % 4 WHEN 0 THEN ['product_info'] WHEN 2 THEN ['peer_compare', 'hold_judgment'] ELSE [] END AS intent_labels, CASE WHEN item_id % 6 = 1 THEN ['comparison'] ELSE [] END AS topic_labels,
    {SCOPES}[CAST(item_id % 7 AS INT) + 1] AS time_scope, CASE item_id % 11 WHEN 0 THEN ['out_of_scope_query'] WHEN 1 THEN ['clarification_required'] ELSE [] END AS risk_flags FROM benchmark
)"""


def cosine_sql(query: str, least: str = "") -> str:
    """DuckDB: c (query_id, doc_id, cosine) of the text of requests and whole evidence, by word-bound 2- to 4-grams.

    Grams are made once of each distinct padded word.
    """
    word = lambda key, text, table: f"(SELECT {key}, ' ' || w || ' ' AS p, count(*) AS n FROM (SELECT {key}, unnest(string_split_regex(lower({text}), '\\s+')) AS w FROM {table}) WHERE w <> '' GROUP BY 1, 2)"
    return f"""wd AS {word('doc_id', "concat_ws(' ', title, summary, body)", 'evidence')}, wq AS {word('query_id', query, 'requests')},
  wg AS (SELECT p, g, count(*) AS k FROM (SELECT p, unnest(flatten([[substr(p, i, n) FOR i IN range(1, length(p) - n + 2)] FOR n IN [2, 3, 4]])) AS g FROM (SELECT p FROM wd UNION SELECT p FROM wq)) GROUP BY 1, 2),
  dt AS (SELECT doc_id, g, sum(n * k)::DOUBLE AS tf FROM wd JOIN wg USING (p) GROUP BY 1, 2), idf AS (SELECT g, ln((1 + (SELECT count(DISTINCT doc_id) FROM wd)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM dt GROUP BY 1),
  dn AS (SELECT doc_id, sqrt(sum(tf * idf * tf * idf)) AS dn FROM dt JOIN idf USING (g) GROUP BY 1), qw AS (SELECT query_id, g, sum(n * k) * idf AS w FROM wq JOIN wg USING (p) JOIN idf USING (g) GROUP BY 1, 2, idf),
  qn AS (SELECT query_id, sqrt(sum(w * w)) AS qn FROM qw GROUP BY 1),
  c AS (SELECT query_id, doc_id, sum(w * tf * idf) / any_value(qn) / any_value(dn) AS cosine FROM qw JOIN dt USING (g) JOIN idf USING (g) JOIN qn USING (query_id) JOIN dn USING (doc_id) GROUP BY 1, 2{least})"""
