"""Text-function queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidrel.functions import text as X
from evidrel.operators.fuzzy import window_join
from evidrel.plans.registry import query, read
from evidrel.plans.views import EVIDENCE, evidence

ZH = ["为什么茅台跌了？", "茅台和五粮液哪个好", "What is the difference between ETF and LOF?", "“你好。世界”他说。再见！", "半导体 行业 还值得持有吗", "any recent news about CPI?", "沪深300 etf 费率", ""]
VALUES = ", ".join(f"({i}, '{t}')" for i, t in enumerate(ZH))


def fixture(spark):
    return spark.createDataFrame(list(enumerate(ZH)), "id int, t string")


def asked(spark, sf):
    """The fixture's texts and those of benchmark and conversations, whole."""
    rows = fixture(spark).select(F.col("id").cast("long").alias("id"), "t")
    rows = rows.unionByName(read(spark, sf, "benchmark").select((F.col("item_id") + 100).alias("id"), F.coalesce("text", F.lit("")).alias("t")))
    return rows.unionByName(read(spark, sf, "conversations").select((-F.col("conv_id") * 1000 - F.col("turn") - 1).alias("id"), F.coalesce("text", F.lit("")).alias("t")))


ASKED = f"v AS (SELECT id::BIGINT AS id, t FROM (VALUES {VALUES}) f(id, t) UNION ALL SELECT item_id + 100, coalesce(text, '') FROM benchmark UNION ALL SELECT -conv_id * 1000 - turn - 1, coalesce(text, '') FROM conversations)"


def kept_length(char_class: str, text: str = "t") -> str:
    """DuckDB: how many characters of a class a text has."""
    return f"length(regexp_replace({text}, '[^{char_class}]', '', 'g'))".replace("'《", "''《").replace("\"'(", "\"''(")


def held(words: list[str], text: str) -> str:
    return "(" + " + ".join(f"contains({text}, '{w}')::INT" for w in words) + ")"


@query("s20_language", f"""WITH v(id, t) AS (VALUES {VALUES}), a AS (SELECT id, t FROM v UNION ALL SELECT doc_id + 100, text FROM documents),
  c AS (SELECT id, t, length(trim(t)) AS n, {kept_length(X.CJK)} AS z, {kept_length('A-Za-z')} AS l, 2 * {held(X.ZH_STOPWORDS, 't')} + {kept_length(X.ZH_PUNCT)} AS zs, 2 * {held(X.EN_STOPWORDS, 'lower(t)')} + {kept_length(X.EN_PUNCT)} AS es FROM a)
  SELECT id::BIGINT AS id, CASE WHEN n = 0 THEN 'unknown' WHEN z / n::DOUBLE > 0.1 AND l / n::DOUBLE > 0.1 THEN 'mixed' WHEN z / n::DOUBLE > 0.1 THEN 'zh' WHEN l / n::DOUBLE > 0.1 THEN 'en'
    WHEN greatest(zs, es) < 2 OR zs = es THEN 'unknown' WHEN l / n::DOUBLE > 0.05 AND z / n::DOUBLE > 0.05 THEN 'mixed' WHEN zs > es THEN 'zh' ELSE 'en' END AS lang,
  CASE WHEN z > 0 AND z >= greatest(2, l * 0.4) THEN 'zh' WHEN l > 0 THEN 'en' ELSE 'zh' END AS chat, CASE WHEN l > z THEN 'en' ELSE 'zh' END AS eval FROM c""")
def s20(spark, sf):
    a = fixture(spark).select(F.col("id").cast("long").alias("id"), "t").unionByName(read(spark, sf, "documents").select((F.col("doc_id") + 100).alias("id"), F.col("text").alias("t")))
    a, t, n = a.withColumn("n", X.script_counts(F.col("t"))), F.col("t"), F.col("n")
    return a.select("id", X.detect_language(t, n).alias("lang"), X.chat_language(t, n).alias("chat"), X.eval_language(t, n).alias("eval"))


@query("s24_sentences", f"WITH {EVIDENCE} SELECT doc_id, len(s) AS n, s[1] AS head FROM (SELECT doc_id, list_filter(list_transform(string_split_regex(regexp_replace(body, '([.!?])\\s+', '\\1\x01', 'g'), '\x01'), lambda x: trim(x)), lambda x: x <> '') AS s FROM evidence)")
def s24(spark, sf):
    s = X.sentences_en(F.col("body"))
    return evidence(spark, sf).select("doc_id", F.size(s).cast("long").alias("n"), F.get(s, F.lit(0)).alias("head"))


@query("s23_sentences_zh")
def s23(spark, sf):
    return asked(spark, sf).select("id", X.sentences(F.col("t"), X.detect_language(F.col("t"))).alias("sentences"))


@query("s1_s3_normalized_queries")
def s1(spark, sf):
    return asked(spark, sf).select("id", X.normalize_query(F.col("t"), {"茅台": "贵州茅台", "五粮液": "五粮液"}).alias("q"))


@query("s16_s17_slots", f"""WITH {ASKED}, k AS (SELECT id, t, list_filter(['下跌', '上涨', '原因', '持有', '风险', '估值', '新闻'], lambda w: contains(t, w)) AS w FROM v)
  SELECT id, array_to_string(CASE WHEN contains(t, '跌') AND NOT list_contains(w, '下跌') THEN list_append(w, '下跌') ELSE w END, ',') AS keywords, CASE WHEN contains(t, '跌') OR contains(t, '慌') OR contains(t, '回撤') THEN 'anxious' ELSE 'neutral' END AS sentiment,
  CASE WHEN regexp_matches(t, '比|相比|哪个|谁更|更稳|更好|有什么区别|有何区别|有什么不同|差别') THEN 'compare' WHEN regexp_matches(t, '为什么|为啥|咋') AND NOT regexp_matches(t, '值得|能买吗|买吗|买入|卖出|上车|止盈|止损|持有|拿吗') THEN 'why' WHEN regexp_matches(t, '为什么|为啥|咋') THEN 'why' WHEN regexp_matches(t, '未来|接下来|后市') THEN 'forecast' ELSE 'fact' END AS style FROM k""")
def s16(spark, sf):
    s = X.slots(F.col("t"))
    return asked(spark, sf).select("id", F.array_join(s["keywords"], ",").alias("keywords"), s["sentiment_of_user"].alias("sentiment"), X.question_style(F.col("t"), F.array().cast("array<string>")).alias("style"))


@query("s29_s32_clean", f"WITH {EVIDENCE} SELECT doc_id, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS clean, substr(trim(regexp_replace(title, '[^A-Za-z0-9_.:-]+', '_', 'g'), '_'), 1, 160) AS safe FROM evidence")
def s29(spark, sf):
    return evidence(spark, sf).select("doc_id", X.clean(F.col("body")).alias("clean"), X.safe_id(F.col("title")).alias("safe"))


@query("s33_s34_symbols", """WITH c AS (SELECT c_custkey, lpad(CAST((c_custkey * 7919) % 1000000 AS VARCHAR), 6, '0') AS code FROM customer)
  SELECT c_custkey, CASE WHEN code[1] IN ('6', '9') THEN code || '.SH' WHEN code[1] IN ('0', '2', '3') THEN code || '.SZ' WHEN code[1] IN ('4', '8') THEN code || '.BJ' ELSE code END AS doc_symbol, code || CASE WHEN code[1] IN ('6', '5') THEN '.SH' WHEN code[1] IN ('8', '4') THEN '.BJ' ELSE '.SZ' END AS entity_symbol,
  CASE WHEN code[1:2] IN ('51', '56', '58', '15') THEN 'etf' ELSE 'stock' END AS kind FROM c""")
def s33(spark, sf):
    code = F.lpad(((F.col("c_custkey") * 7919) % 1000000).cast("string"), 6, "0")
    return read(spark, sf, "customer").select("c_custkey", X.document_symbol(code).alias("doc_symbol"), X.entity_symbol(F.concat(F.lit(" "), code, F.lit("CH"))).alias("entity_symbol"), X.entity_type(code, F.lit("plain")).alias("kind"))


@query("s13_char_overlap", "SELECT n_nationkey, round(len(list_filter(c, lambda x: contains('GERMANY AND FRANCE', x))) / len(c)::DOUBLE, 4) AS overlap FROM (SELECT n_nationkey, list_distinct(string_split(replace(n_name, ' ', ''), '')) AS c FROM nation)")
def s13(spark, sf):
    return read(spark, sf, "nation").select("n_nationkey", X.char_overlap(F.col("n_name"), F.lit("GERMANY AND FRANCE")).alias("overlap"))


@query("s50_labels", "SELECT l_orderkey, l_linenumber, array_to_string(list_filter(list_transform(string_split_regex(' ' || l_returnflag || ', ' || l_linestatus || ' |', '[,|]'), lambda x: trim(x)), lambda x: x <> ''), '+') AS labels FROM lineitem")
def s50(spark, sf):
    t = F.concat(F.lit(" "), "l_returnflag", F.lit(", "), "l_linestatus", F.lit(" |"))
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(X.label_list(t), "+").alias("labels"))


@query("s49_trim", f"WITH {EVIDENCE}, h AS (SELECT doc_id, body, substr(body, 1, 240) AS head, regexp_extract(substr(body, 1, 240), '(?s)^(.*[。！？.!?])', 1) AS cut FROM evidence) SELECT doc_id, CASE WHEN length(body) <= 240 THEN body WHEN cut <> '' THEN cut ELSE head END AS short FROM h")
def s49(spark, sf):
    return evidence(spark, sf).select("doc_id", X.trim_at_boundary(F.col("body"), 240).alias("short"))


@query("s9_j14_fuzzy", """WITH q AS (SELECT 'b' || item_id AS query_id, upper(text) AS q FROM benchmark UNION ALL SELECT 'n' || n_nationkey, 'WHY DID ' || substr(n_name, 1, 2) || substr(n_name, 4) || ' FALL' FROM nation UNION ALL SELECT 's' || n_nationkey, 'NEWS OF ' || substr(n_name, 1, 3) || 'Q' || substr(n_name, 5) FROM nation),
  c AS (SELECT q.query_id, n.n_name, w, i, substr(q.q, i, w) AS t, levenshtein(substr(q.q, i, w), n.n_name) AS d, length(n.n_name) AS k
    FROM q, nation n, (SELECT unnest([-1, 0, 1]) AS o) o, LATERAL (SELECT length(n.n_name) + o.o AS w) ww, LATERAL (SELECT unnest(range(1, length(q.q) - w + 2)) AS i) ii WHERE w > 0 AND (o.o = 0 OR length(n.n_name) >= 3)),
  m AS (SELECT query_id, n_name, round(greatest(1 - d / greatest(length(t), k)::DOUBLE, 0.78), 2) AS score FROM c WHERE trim(t) <> '' AND regexp_full_match(t, '[\\x00-\\x7f]*') AND CASE WHEN k <= 4 THEN d <= 1 ELSE d <= 2 AND 1 - d / greatest(length(t), k)::DOUBLE >= 0.78 END)
  SELECT query_id, n_name, max(score) AS score FROM m GROUP BY 1, 2""")
def s9(spark, sf):
    n = read(spark, sf, "nation").select("n_nationkey", "n_name")
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string")).alias("query_id")
    name = lambda a, b: F.substring("n_name", a, b)
    q = read(spark, sf, "benchmark").select(key("b", "item_id"), F.upper("text").alias("q"))
    q = q.unionByName(n.select(key("n", "n_nationkey"), F.concat(F.lit("WHY DID "), name(1, 2), name(4, 99), F.lit(" FALL")).alias("q")))
    q = q.unionByName(n.select(key("s", "n_nationkey"), F.concat(F.lit("NEWS OF "), name(1, 3), F.lit("Q"), name(5, 99)).alias("q")))
    near = window_join(n.select(F.col("n_name").alias("name_id"), F.col("n_name").alias("name")), q.select(F.col("query_id").alias("text_id"), F.col("q").alias("text")))
    return near.select(F.col("text_id").alias("query_id"), F.col("name_id").alias("n_name"), F.col("m.score").alias("score"))
