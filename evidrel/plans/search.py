"""Retrieval, ranking, packaging and metric queries."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidrel.functions import scalars as S
from evidrel.functions import text as X
from evidrel.operators import metrics as M
from evidrel.operators import packaging as P
from evidrel.operators import retrieval as R
from evidrel.plans.registry import query, read
from evidrel.plans.views import AS_OF, EVIDENCE, REQUESTS, SCOPES, SOURCES, cosine_sql, evidence, requests


def grams_sql(text: str) -> str:
    """DuckDB list of word-bound 2- to 4-grams."""
    one = lambda n: f"[substr(p, i, {n}) FOR i IN range(1, greatest(length(p) - {n} + 1, 1) + 1)]"
    return (
        f"(SELECT coalesce(flatten(list(list_concat(list_concat({one(2)}, CASE WHEN length(p) > 2 THEN {one(3)} ELSE [] END), CASE WHEN length(p) > 3 THEN {one(4)} ELSE [] END))), [])"
        f" FROM (SELECT ' ' || w || ' ' AS p FROM (SELECT unnest(string_split_regex(lower({text}), '\\s+')) AS w) WHERE w <> ''))"
    )


def half_up(x: str, places: int = 4) -> str:
    """DuckDB: a double rounded half up as it is written, which is how Spark rounds."""
    return f"round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 20)), {places})::DOUBLE"


COSINE_SQL = f"WITH {EVIDENCE}, {REQUESTS}, {cosine_sql('query')}"


def cosines(spark, sf, **limits):
    """Whole benchmark texts against title, summary and body of every document."""
    e = evidence(spark, sf).select("doc_id", F.concat_ws(" ", "title", "summary", "body").alias("t"))
    q = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return R.cosine(q, e, F.col("text"), F.col("t"), **limits)


@query("ir1_ir3_cosine", COSINE_SQL + " SELECT query_id, doc_id, round(cosine, 4) AS score FROM c WHERE cosine >= 0.3")
def ir3(spark, sf):
    return cosines(spark, sf, least=0.3).select("query_id", "doc_id", F.round("cosine", 4).alias("score"))


@query("ir4_t1_top_hits", COSINE_SQL + ", r AS (SELECT query_id, doc_id, round(cosine, 4) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(cosine, 4) DESC, doc_id) AS position FROM c WHERE round(cosine, 4) >= 0.02) SELECT * FROM r WHERE position <= 10")
def ir4(spark, sf):
    hits = cosines(spark, sf, least=0.0199, top=10).withColumn("score", F.round("cosine", 4)).where("score >= 0.02")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("position", F.row_number().over(w)).where("position <= 10").select("query_id", "doc_id", "score", "position")


@query("ir5_word_bound_grams", f"WITH n AS (SELECT n_nationkey, n_name FROM nation) SELECT n_nationkey, gram, count(*) AS tf FROM (SELECT n_nationkey, unnest({grams_sql('n_name')}) AS gram FROM n) GROUP BY 1, 2")
def ir5(spark, sf):
    return R.gram_counts(read(spark, sf, "nation"), "n_nationkey", F.col("n_name"))


@query("pf4_pf5_allowed_sources", f"""WITH {REQUESTS}, p AS (SELECT query_id, CASE query_id % 4 WHEN 0 THEN NULL WHEN 1 THEN ['market_api'] ELSE source_plan END AS plan FROM requests),
  a AS (SELECT query_id, CASE WHEN plan IS NULL THEN ['news', 'announcement', 'faq', 'product_doc', 'research_note'] ELSE list_filter(['news', 'announcement', 'faq', 'product_doc', 'research_note'], lambda s: list_contains(plan, s)) END AS strict FROM p)
  SELECT query_id, array_to_string(strict, ',') AS strict, array_to_string(CASE WHEN len(strict) = 0 THEN ['news', 'announcement', 'faq', 'product_doc', 'research_note'] ELSE strict END, ',') AS loose FROM a""")
def pf4(spark, sf):
    plan = F.when(F.col("query_id") % 4 == 0, None).when(F.col("query_id") % 4 == 1, F.array(F.lit("market_api"))).otherwise(F.col("source_plan"))
    q = requests(spark, sf).withColumn("plan", plan)
    return q.select("query_id", F.array_join(R.allowed_sources(F.col("plan")), ",").alias("strict"), F.array_join(R.allowed_sources_or_all(F.col("plan")), ",").alias("loose"))


PAIRS = f"""{EVIDENCE}, {REQUESTS}, {cosine_sql('query')}, p AS (SELECT r.* EXCLUDE (product_type), e.*, round(cosine, 4) AS score FROM c JOIN requests r USING (query_id) JOIN evidence e USING (doc_id))"""


def pairs(spark, sf):
    """Requests with every document that shares a gram; score is the cosine to four places."""
    hits = cosines(spark, sf).select("query_id", "doc_id", F.round("cosine", 4).alias("score"))
    return hits.join(evidence(spark, sf), "doc_id").join(requests(spark, sf).drop("product_type"), "query_id")


HITS = PAIRS.replace(", p AS (", ", every AS (") + ", p AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 20)"


def hits(spark, sf):
    """The 20 best documents of each request: the candidates that features and packages are made of."""
    best = cosines(spark, sf, top=20).select("query_id", "doc_id", F.round("cosine", 4).alias("score"))
    best = best.withColumn("n", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).where("n <= 20").drop("n")
    return best.join(evidence(spark, sf), "doc_id").join(requests(spark, sf).drop("product_type"), "query_id")


@query("pf7_least_score", f"WITH {PAIRS} SELECT query_id, doc_id FROM p WHERE score >= CASE WHEN source_type IN ('news', 'announcement') THEN 0.02 ELSE 0.05 END")
def pf7(spark, sf):
    return pairs(spark, sf).where(R.reaches_least(F.col("source_type"), F.col("score"))).select("query_id", "doc_id")


DIVERSE = f"""WITH {PAIRS}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_type ORDER BY score DESC, doc_id) AS best FROM p),
  o AS (SELECT *, CASE WHEN best = 1 AND list_contains(source_plan, source_type) THEN list_position(source_plan, source_type) ELSE 1000000 END AS place FROM b),
  s AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY place, score DESC, doc_id) AS position FROM o) SELECT * FROM s WHERE position <= 8"""


@query("t2_diversified", DIVERSE)
def t2(spark, sf):
    return R.diversified(pairs(spark, sf), 8).select("query_id", "doc_id", "position")


SELECT = f"""WITH {HITS}, u AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE score - 0.1 END AS retrieval_score, score AS rank_score, CASE WHEN doc_id % 3 = 0 THEN 'http://x' END AS source_url FROM p),
  f AS (SELECT * FROM u WHERE CASE WHEN retrieval_score IS NULL THEN rank_score >= 0.55 ELSE retrieval_score > 0 END),
  b AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_type ORDER BY (source_url IS NOT NULL)::INT DESC, (NOT contains(lower(source_name), 'seed') AND NOT starts_with(lower(source_name), 'public_'))::INT DESC, rank_score DESC, retrieval_score DESC NULLS LAST, evidence_id) AS best FROM f),
  o AS (SELECT *, CASE WHEN best = 1 AND list_contains(source_plan, source_type) THEN list_position(source_plan, source_type) ELSE 1000000 END AS place FROM b),
  s AS (SELECT query_id, evidence_id, row_number() OVER (PARTITION BY query_id ORDER BY place, rank_score DESC, evidence_id) AS position FROM o) SELECT * FROM s WHERE position <= 6"""


@query("t5_pf8_selected", SELECT)
def t5(spark, sf):
    p = hits(spark, sf).withColumns({"retrieval_score": F.when(F.col("doc_id") % 5 != 0, F.col("score") - 0.1), "rank_score": F.col("score"), "source_url": F.when(F.col("doc_id") % 3 == 0, "http://x")})
    return R.selected(p, 6).select("query_id", "evidence_id", "position")


@query("d5_near_duplicate_groups")
def d5(spark, sf):
    top = R.diversified(hits(spark, sf), 20)
    return R.near_duplicate_groups(top.select("query_id", "position", "evidence_id", "source_type", "title", "summary"))


@query("f1_f2_recency", f"""WITH e AS (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE ts END AS ts, ['today', 'recent_3d', 'recent_1w', 'recent_1m', 'recent_1q', 'long_term', 'other'][CAST(event_id % 7 AS INT) + 1] AS scope FROM events),
  a AS (SELECT event_id, ts, greatest(floor((epoch({AS_OF}) - floor(epoch(ts))) / 86400), 0) AS age, CASE scope WHEN 'today' THEN 1 WHEN 'recent_3d' THEN 3 WHEN 'recent_1w' THEN 7 WHEN 'recent_1q' THEN 90 WHEN 'long_term' THEN 365 ELSE 30 END AS d FROM e)
  SELECT event_id, CASE WHEN ts IS NULL THEN 0.3 ELSE round(greatest(0.05, exp(-0.693 * age / 60)), 4) END AS recency, CASE WHEN ts IS NULL THEN 0.3 WHEN age <= d THEN 1 ELSE round(greatest(0.1, 1 - (age - d) / greatest(d, 1) * 0.5), 4) END AS window_match FROM a""")
def f1(spark, sf):
    scope = F.element_at(F.array(*map(F.lit, ["today", "recent_3d", "recent_1w", "recent_1m", "recent_1q", "long_term", "other"])), (F.col("event_id") % 7).cast("int") + 1)
    ts, at = F.when(F.col("event_id") % 9 != 0, F.col("ts")), F.expr(AS_OF)
    return read(spark, sf, "events").select("event_id", S.recency(ts, at).alias("recency"), S.window_match(ts, at, scope).alias("window_match"))


@query("f4_intent_match", f"""WITH {HITS}, i AS (SELECT query_id, doc_id, source_type, CASE query_id % 4 WHEN 0 THEN [] WHEN 1 THEN ['hold_judgment', 'nothing'] WHEN 2 THEN ['product_info'] ELSE ['market_explanation', 'event_news_query'] END AS labels FROM p)
  SELECT query_id, doc_id, CASE WHEN len(labels) = 0 THEN 0.5 WHEN (list_contains(labels, 'hold_judgment') AND source_type IN ('announcement', 'research_note')) OR (list_contains(labels, 'product_info') AND source_type IN ('faq', 'product_doc')) OR (list_contains(labels, 'event_news_query') AND source_type IN ('news', 'announcement')) THEN 0.8 ELSE 0.2 END::DOUBLE AS compat FROM i""")
def f4(spark, sf):
    k = F.col("query_id") % 4
    labels = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("hold_judgment"), F.lit("nothing"))).when(k == 2, F.array(F.lit("product_info"))).otherwise(F.array(F.lit("market_explanation"), F.lit("event_news_query")))
    return hits(spark, sf).select("query_id", "doc_id", S.intent_match(labels, F.col("source_type")).alias("compat"))


@query("f6_f8_ranks", f"""WITH {HITS}, b AS (SELECT query_id, doc_id, score, {half_up('least(0.35::DOUBLE * score + 0.20::DOUBLE * (doc_id % 2) + 0.15::DOUBLE * (doc_id % 3 = 0)::INT + 0.10::DOUBLE * 1 + 0.10::DOUBLE * 0.3::DOUBLE + 0.10::DOUBLE * credibility_score, 1.0)')} AS base FROM p)
  SELECT query_id, doc_id, base, CASE WHEN doc_id % 7 = 0 THEN base ELSE {half_up('greatest(0, least(1, 0.35::DOUBLE * base + 0.65::DOUBLE * score))')} END AS hybrid FROM b""")
def f6(spark, sf):
    base = S.baseline_rank(F.col("score"), F.col("doc_id") % 2, (F.col("doc_id") % 3 == 0).cast("int"), F.lit(1), F.lit(0.3), F.col("credibility_score"))
    out = hits(spark, sf).withColumn("base", base)
    return out.select("query_id", "doc_id", "base", S.hybrid_rank(F.col("base"), F.when(F.col("doc_id") % 7 != 0, F.col("score"))).alias("hybrid"))


TERMS = "list_concat(list_concat(industry_terms, keywords), entity_names)"
BONUS = f"least(0.06 * len(list_filter({TERMS}, lambda k: length(trim(k)) >= 2 AND contains(concat_ws(' ', title, summary, body), k))), 0.18)::DOUBLE"


@query("f9_term_bonus", f"WITH {PAIRS} SELECT query_id, doc_id, {BONUS} AS bonus FROM p")
def f9(spark, sf):
    return R.bonuses(requests(spark, sf), evidence(spark, sf), F.concat_ws(" ", "title", "summary", "body"))


@query("s10_s12_gram_jaccard", f"""WITH {HITS}, g AS (SELECT query_id, doc_id, list_distinct([substr(query, i, 3) FOR i IN range(1, greatest(length(query) - 2, 1) + 1)]) AS a, list_distinct([substr(title, i, 3) FOR i IN range(1, greatest(length(title) - 2, 1) + 1)]) AS b, length(title) AS n FROM p)
  SELECT query_id, doc_id, CASE WHEN n = 0 THEN 0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 4) END AS jaccard FROM g""")
def s11(spark, sf):
    return hits(spark, sf).select("query_id", "doc_id", X.gram_jaccard(F.col("query"), F.col("title")).alias("jaccard"))


ITEMS = f"""{HITS}, i AS (SELECT query_id, doc_id, CASE WHEN doc_id % 2 = 0 THEN source_type ELSE ['market_api', 'fundamental_sql', 'fund_nav', 'macro_sql', 'index_valuation', 'policy_event', 'fund_fee'][CAST(doc_id % 7 AS INT) + 1] END AS source_type, doc_id % 2 = 0 AS is_document, CASE WHEN doc_id % 2 = 0 THEN entity_symbols ELSE ['S' || doc_id % 3] END AS symbols FROM p)"""


def items(spark, sf):
    other = F.element_at(F.array(*map(F.lit, ["market_api", "fundamental_sql", "fund_nav", "macro_sql", "index_valuation", "policy_event", "fund_fee"])), (F.col("doc_id") % 7).cast("int") + 1)
    even = F.col("doc_id") % 2 == 0
    symbols = F.when(even, F.col("entity_symbols")).otherwise(F.array(F.concat(F.lit("S"), (F.col("doc_id") % 3).cast("string"))))
    return hits(spark, sf).select("query_id", "doc_id", F.when(even, F.col("source_type")).otherwise(other).alias("source_type"), even.alias("is_document"), symbols.alias("symbols"))


def cover_sql(kind: dict[str, list[str]]) -> str:
    part = lambda t: f"(is_document AND source_type = '{t[2:]}')" if t.startswith("d:") else f"(NOT is_document AND source_type = '{t}')"
    return ", ".join(f"bool_or({' OR '.join(map(part, ts))}) AS {name}" for name, ts in kind.items())


COMPARES = "list_contains(intent_labels, 'peer_compare') OR list_contains(topic_labels, 'comparison')"
COMPARISON = f"n AS (SELECT query_id, count(DISTINCT symbol) >= 2 AS comparison FROM (SELECT query_id, unnest(symbols) AS symbol FROM i) GROUP BY 1), m AS (SELECT r.query_id, ({COMPARES}) AND coalesce(comparison, false) AS comparison FROM requests r LEFT JOIN n ON n.query_id = r.query_id)"
FLAGS = [*P.COVERAGE, "comparison"]


@query("a1_coverage", f"WITH {ITEMS}, {COMPARISON}, e AS (SELECT query_id, {cover_sql(P.COVERAGE)} FROM i GROUP BY query_id) SELECT e.*, m.comparison FROM e JOIN m ON m.query_id = e.query_id")
def a1(spark, sf):
    return P.all_coverage(items(spark, sf), requests(spark, sf))


@query("a2_coverage_detail", f"WITH {ITEMS} SELECT query_id, {cover_sql(P.DETAIL)} FROM i GROUP BY query_id")
def a2(spark, sf):
    return P.coverage(items(spark, sf), P.DETAIL)


@query("a3_comparison", f"WITH {ITEMS}, {COMPARISON} SELECT query_id, comparison FROM m")
def a3(spark, sf):
    return P.comparison_coverage(items(spark, sf), requests(spark, sf))


CONFIDENCE = f"""WITH {ITEMS}, {COMPARISON}, e AS (SELECT query_id, {cover_sql(P.COVERAGE)} FROM i GROUP BY query_id), f AS (SELECT e.*, m.comparison FROM e JOIN m ON m.query_id = e.query_id), r AS (SELECT query_id, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE score END AS s, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS n FROM p),
  t AS (SELECT query_id, avg(coalesce(s, 0.7)) AS top FROM r WHERE n <= 3 GROUP BY 1)
  SELECT f.query_id, round((coalesce(top, 0) + ({' + '.join(f'{k}::INT' for k in FLAGS)}) / {len(FLAGS)}.0::DOUBLE) / 2, 2) AS confidence FROM f LEFT JOIN t ON t.query_id = f.query_id"""


@query("a4_confidence", CONFIDENCE)
def a4(spark, sf):
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = hits(spark, sf).withColumn("position", F.row_number().over(w)).withColumn("rank_score", F.when(F.col("doc_id") % 6 != 0, F.col("score")))
    return P.retrieval_confidence(ranked, P.all_coverage(items(spark, sf), requests(spark, sf)), FLAGS)


@query("a5_executed_sources", f"WITH {ITEMS}, o AS (SELECT query_id, source_type, bool_and(NOT is_document) AS s, min(doc_id) FILTER (WHERE is_document) AS d, min(doc_id) AS o FROM i GROUP BY 1, 2) SELECT query_id, string_agg(source_type, ',' ORDER BY s, coalesce(d, o)) AS executed FROM o GROUP BY 1")
def a5(spark, sf):
    first = items(spark, sf).groupBy("query_id", "source_type").agg(F.min(F.struct(~F.col("is_document"), F.col("doc_id"))).alias("o"))
    out = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("o", "source_type"))).alias("x"))
    return out.select("query_id", F.array_join(F.col("x.source_type"), ",").alias("executed"))


@query("pf28_pf29_quality", """SELECT c_custkey, 3 AS total_fields, 3 - (c_custkey % 5 = 0)::INT - (c_custkey % 7 = 0)::INT AS non_null_fields, array_to_string(list_filter([CASE WHEN c_custkey % 5 = 0 THEN 'balance' END, CASE WHEN c_custkey % 7 = 0 THEN 'segment' END], lambda x: x IS NOT NULL), ',') AS missing,
  array_to_string(list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'seed_source' END, CASE WHEN c_custkey % 3 = 0 THEN 'missing_source_url' END, CASE WHEN c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 'missing_values' END], lambda x: x IS NOT NULL), ',') AS flags FROM customer""")
def pf28(spark, sf):
    k = F.col("c_custkey")
    payload = {"symbol": F.col("c_name"), "balance": F.when(k % 5 != 0, F.col("c_acctbal")), "segment": F.when(k % 7 != 0, F.col("c_mktsegment")), "source_name": F.lit(None)}
    cover = P.field_coverage(payload)
    flags = P.quality_flags(F.when(k % 2 == 0, "Seed file").otherwise("live"), F.when(k % 3 != 0, "u"), payload)
    return read(spark, sf, "customer").select("c_custkey", cover["total_fields"].alias("total_fields"), cover["non_null_fields"].alias("non_null_fields"), F.array_join(cover["missing_fields"], ",").alias("missing"), F.array_join(flags, ",").alias("flags"))


@query("pf30_provenance", """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE 'dataset://my_source/' || page_id END AS ref, CASE WHEN page_id % 3 = 0 THEN 'api://quotes?symbol=a%26b&n=' || page_id ELSE 'provider://my_source' END AS api FROM pages""")
def pf30(spark, sf):
    k = F.col("page_id")
    params = F.create_map(F.lit("symbol"), F.lit("a&b"), F.lit("n"), k.cast("string"))
    return read(spark, sf, "pages").select("page_id", P.document_reference(F.when(k % 2 == 0, F.col("url")), F.lit("my source"), k).alias("ref"), P.api_reference(F.when(k % 3 == 0, "quotes"), params, F.lit("my source")).alias("api"))


@query("s30_s31_excerpts", f"WITH {EVIDENCE} SELECT doc_id, nullif(substr(trim(coalesce(nullif(CASE WHEN doc_id % 2 = 0 THEN summary END, ''), body)), 1, 500), '') AS excerpt, substr(CASE WHEN title <> '' THEN title ELSE body END, 1, 160) AS short FROM evidence")
def s31(spark, sf):
    short = F.substring(F.when(F.col("title") != "", F.col("title")).otherwise(F.col("body")), 1, 160)
    return evidence(spark, sf).select("doc_id", P.excerpt(F.when(F.col("doc_id") % 2 == 0, F.col("summary")), F.col("body")).alias("excerpt"), short.alias("short"))


@query("t6_reasons", f"WITH {HITS} SELECT query_id, doc_id, array_to_string(list_filter([CASE WHEN score >= 0.8 THEN 'lexical' END, CASE WHEN credibility_score >= 0.8 THEN 'credibility' END, CASE WHEN doc_id % 2 >= 0.8 THEN 'title_hit' END, CASE WHEN doc_id % 3 >= 0.8 THEN 'recency' END], lambda x: x IS NOT NULL)[1:3], ',') AS reason FROM p")
def t6(spark, sf):
    r = P.reasons({"lexical": F.col("score"), "credibility": F.col("credibility_score"), "title_hit": F.col("doc_id") % 2, "recency": F.col("doc_id") % 3})
    return hits(spark, sf).select("query_id", "doc_id", F.array_join(r, ",").alias("reason"))


LABELS = """l AS (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '' WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'clean' ELSE 'poor' END AS expected, CASE doc_id % 4 WHEN 0 THEN 'toxic' WHEN 1 THEN 'poor' ELSE 'clean' END AS predicted FROM labels),
  s AS (SELECT doc_id, list_filter([CASE WHEN quality = 1 THEN 'good' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN doc_id % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL) AS e, list_filter([CASE WHEN doc_id % 3 > 0 THEN 'good' END, CASE WHEN doc_id % 5 = 0 THEN 'toxic' END, CASE WHEN doc_id % 4 = 0 THEN 'even' END], lambda x: x IS NOT NULL) AS p FROM labels)"""


def single(spark, sf):
    k = F.col("doc_id")
    e = F.when(k % 17 == 0, "").when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "clean").otherwise("poor")
    return read(spark, sf, "labels").select("doc_id", e.alias("expected"), F.when(k % 4 == 0, "toxic").when(k % 4 == 1, "poor").otherwise("clean").alias("predicted"))


def multi(spark, sf):
    k = F.col("doc_id")
    e = F.array_compact(F.array(F.when(F.col("quality") == 1, "good"), F.when(F.col("toxic") == 1, "toxic"), F.when(k % 2 == 0, "even")))
    return read(spark, sf, "labels").select("doc_id", e.alias("expected"), F.array_compact(F.array(F.when(k % 3 > 0, "good"), F.when(k % 5 == 0, "toxic"), F.when(k % 4 == 0, "even"))).alias("predicted"))


F1 = "CASE WHEN tp = 0 THEN 0 ELSE round(2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE), 4) END"


@query("a9_accuracy", f"WITH {LABELS} SELECT round(avg((expected = predicted)::INT), 4) AS accuracy FROM l WHERE expected <> ''")
def a9(spark, sf):
    return M.accuracy(single(spark, sf))


COUNTS = f"WITH {LABELS}, x AS (SELECT DISTINCT doc_id, e, p, unnest(list_concat(e, p)) AS label FROM s), c AS (SELECT label, count(*) FILTER (WHERE list_contains(e, label) AND list_contains(p, label)) AS tp, count(*) FILTER (WHERE NOT list_contains(e, label)) AS fp, count(*) FILTER (WHERE NOT list_contains(p, label)) AS fn FROM x GROUP BY label)"


@query("a10_micro_f1", COUNTS + f", t AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM c) SELECT tp, fp, fn, {F1} AS micro_f1 FROM t")
def a10(spark, sf):
    return M.micro_f1(multi(spark, sf))


@query("a11_label_f1", COUNTS + f" SELECT label, tp, fp, fn, {F1} AS f1 FROM c")
def a11(spark, sf):
    return M.per_label_f1(multi(spark, sf))


@query("a12_macro_f1", COUNTS + f" SELECT round(avg({F1}), 4) AS macro_f1 FROM c")
def a12(spark, sf):
    return M.macro_f1(multi(spark, sf))


@query("a13_confusion", f"WITH {LABELS} SELECT expected, predicted, count(*) AS n FROM l WHERE expected <> '' GROUP BY 1, 2")
def a13(spark, sf):
    return M.confusion(single(spark, sf))


RANKED = f"WITH {PAIRS}, g AS (SELECT query_id, doc_id, score, CASE WHEN doc_id % 11 = 0 THEN 2 WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS rel FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS ideal FROM g)"


def graded(spark, sf):
    k = F.col("doc_id")
    return pairs(spark, sf).select("query_id", "doc_id", "score", F.when(k % 11 == 0, 2).when(k % 5 == 0, 1).otherwise(0).alias("relevance"))


@query("a15_mrr", RANKED + ", f AS (SELECT query_id, min(CASE WHEN rel > 0 AND rank <= 10 THEN rank END) AS m FROM r GROUP BY 1) SELECT round(avg(coalesce(1.0::DOUBLE / m, 0)), 4) AS mrr FROM f")
def a15(spark, sf):
    return M.mrr(graded(spark, sf))


@query("a16_binary_ndcg", RANKED + ", d AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN (rel > 0)::INT / log2(rank + 1) ELSE 0 END) AS a, sum(CASE WHEN ideal <= 10 THEN (rel > 0)::INT / log2(ideal + 1) ELSE 0 END) AS b FROM r GROUP BY 1) SELECT query_id, CASE WHEN b > 0 THEN round(a / b, 4) ELSE 0 END AS ndcg FROM d")
def a16(spark, sf):
    return M.ndcg(graded(spark, sf), graded=False)


@query("a17_graded_ndcg", RANKED + ", d AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN (2 ** rel - 1) / log2(rank + 1) ELSE 0 END) AS a, sum(CASE WHEN ideal <= 10 THEN (2 ** rel - 1) / log2(ideal + 1) ELSE 0 END) AS b FROM r GROUP BY 1) SELECT query_id, CASE WHEN b > 0 THEN round(a / b, 4) ELSE 0 END AS ndcg FROM d")
def a17(spark, sf):
    return M.ndcg(graded(spark, sf))


@query("a14_a18_recall", RANKED + ", q AS (SELECT query_id, max(rel) AS a, max(CASE WHEN rank <= 10 THEN rel ELSE 0 END) AS h FROM r GROUP BY 1) SELECT round(avg((h > 0)::INT), 4) AS recall FROM q WHERE a > 0")
def a18(spark, sf):
    return M.recall_at(graded(spark, sf), 10)


@query("a19_verdicts", f"WITH {LABELS}, m AS (SELECT round(avg((expected = predicted)::INT), 4) AS v FROM l WHERE expected <> '') SELECT 'accuracy' AS metric, v AS value, 0.9::DOUBLE AS threshold, v >= 0.9 AS passed FROM m")
def a19(spark, sf):
    return M.threshold_verdicts(M.accuracy(single(spark, sf)), {"accuracy": 0.9})


@query("a24_majority", "WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, event_type FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1")
def a24(spark, sf):
    return M.majority(read(spark, sf, "events"), "user_id", "event_type", "event_id")


@query("a27_threshold", f"""WITH x AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS label, quality AS y, ((doc_id * 7919) % 1000)::DOUBLE / 1000 AS score, t FROM labels, (SELECT unnest([0.1, 0.3, 0.5, 0.7])::DOUBLE AS t)),
  c AS (SELECT label, t, count(*) FILTER (WHERE score >= t AND y = 1) AS tp, count(*) FILTER (WHERE score >= t AND y = 0) AS fp, count(*) FILTER (WHERE score < t AND y = 1) AS fn FROM x GROUP BY 1, 2), f AS (SELECT label, t, {F1} AS f1 FROM c)
  SELECT label, t AS threshold, f1 FROM f QUALIFY row_number() OVER (PARTITION BY label ORDER BY f1 DESC, t) = 1""")
def a27(spark, sf):
    k = F.col("doc_id")
    x = read(spark, sf, "labels").select(F.when(k % 2 == 0, "a").otherwise("b").alias("label"), F.col("quality").alias("y"), (((k * 7919) % 1000).cast("double") / 1000).alias("score"))
    return M.best_threshold(x, [0.1, 0.3, 0.5, 0.7])


__all__ = ["SOURCES"]
