"""Deduplication, sampling, splitting and supervision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidrel.functions import scalars as S
from evidrel.functions import text as X
from evidrel.operators import tables as T
from evidrel.plans.registry import query, read
from evidrel.plans.views import EVIDENCE, SOURCES, evidence


@query("sc7_overlay", """SELECT doc_id, 'runtime' AS origin FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, 'seed' FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 <> 0""")
def sc7(spark, sf):
    d = read(spark, sf, "documents").select("doc_id")
    return T.overlay(d.where("doc_id % 3 = 0").withColumn("origin", F.lit("runtime")), d.where("doc_id % 2 = 0").withColumn("origin", F.lit("seed")), "doc_id")


@query("d2_exact_distinct", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY sha1(text || lang)")
def d2(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.sha1(F.concat("text", "lang").cast("binary")).alias("k"))
    return d.groupBy("k").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("d3_content_key", f"WITH {EVIDENCE} SELECT substr(sha1(concat_ws(chr(10), source_type, lower(title), lower(body))), 1, 16) AS k, min(doc_id) AS doc_id, count(*) AS n FROM evidence GROUP BY 1")
def d3(spark, sf):
    e = evidence(spark, sf)
    return e.groupBy(X.content_key(F.col("source_type"), F.col("title"), F.col("body")).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


HEX = "[instr('0123456789abcdef', substr(h, i, 1)) - 1 FOR i IN range(1, 40)]"


@query("d4_hash_split", f"""WITH k AS (SELECT doc_id, sha1(CAST(doc_id AS VARCHAR)) AS h FROM documents), r AS (SELECT doc_id, (6 * list_sum({HEX}) + instr('0123456789abcdef', substr(h, 40, 1)) - 1) % 10 AS r FROM k)
  SELECT doc_id, CASE r WHEN 8 THEN 'valid' WHEN 9 THEN 'test' ELSE 'train' END AS split FROM r""")
def d4(spark, sf):
    return read(spark, sf, "documents").select("doc_id", S.hash_split(F.col("doc_id").cast("string")).alias("split"))


@query("d6_best_per_entity", "SELECT c_nationkey, arg_max(c_custkey, (c_acctbal, length(c_name), -c_custkey)) AS c_custkey FROM customer GROUP BY 1")
def d6(spark, sf):
    return read(spark, sf, "customer").groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("c_acctbal", F.length("c_name"), -F.col("c_custkey"))).alias("c_custkey"))


@query("d7_d9_first_owner", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name")
def d7(spark, sf):
    return T.first_by(read(spark, sf, "part").select("p_name", "p_partkey"), ["p_name"], "p_partkey")


@query("d8_upsert", """WITH o AS (SELECT c_custkey % 50 AS k, c_custkey AS ord, 'old' AS v FROM customer WHERE c_custkey <= 100), n AS (SELECT c_custkey % 70 AS k, c_custkey AS ord, 'new' AS v FROM customer WHERE c_custkey > 100),
  b AS (SELECT k, ord, v, 0 AS t FROM o UNION ALL SELECT k, ord, v, 1 FROM n)
  SELECT k, arg_min(ord, t * 1000000000000 + ord) AS ord, arg_max(v, t * 1000000000000 + ord) AS v FROM b GROUP BY k""")
def d8(spark, sf):
    c = read(spark, sf, "customer")
    old = c.where("c_custkey <= 100").select((F.col("c_custkey") % 50).alias("k"), F.col("c_custkey").alias("ord"), F.lit("old").alias("v"))
    return T.upsert(old, c.where("c_custkey > 100").select((F.col("c_custkey") % 70).alias("k"), F.col("c_custkey").alias("ord"), F.lit("new").alias("v")), "k")


@query("sk6_replace_source", "SELECT doc_id, source AS source_id FROM documents WHERE source <> 'src3' UNION ALL SELECT item_id, 'src3' FROM benchmark")
def sk6(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.col("source").alias("source_id"))
    return T.replace_source(d, read(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit("src3").alias("source_id")), "src3")


@query("d10_label_sets", """SELECT user_id, list_sort(list_intersect(a, b)) AS both_, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_a FROM (
  SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (WHERE event_id % 2 = 0), []) AS a, coalesce(list(DISTINCT event_type) FILTER (WHERE event_id % 2 = 1), []) AS b FROM events GROUP BY user_id)""")
def d10(spark, sf):
    e = read(spark, sf, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("event_id") % 2 == 0, F.col("event_type"))).alias("a"), F.collect_set(F.when(F.col("event_id") % 2 == 1, F.col("event_type"))).alias("b"))
    return e.select("user_id", F.array_sort(F.array_intersect("a", "b")).alias("both_"), F.array_sort(F.array_except("a", "b")).alias("only_a"))


@query("d13_unpivot", "SELECT item_id, s AS source, CASE WHEN list_contains(p, s) THEN 1 ELSE 0 END AS label FROM (SELECT item_id, unnest(['news', 'announcement', 'faq', 'product_doc', 'research_note']) AS s, ['news', 'announcement', 'faq', 'product_doc', 'research_note'][CAST(item_id % 3 AS INT) + 1 : CAST(item_id % 3 AS INT) + 3] AS p FROM benchmark)")
def d13(spark, sf):
    plan = F.slice(F.array(*map(F.lit, SOURCES)), F.pmod("item_id", F.lit(3)).cast("int") + 1, 3)
    return T.unpivot_sources(read(spark, sf, "benchmark").select("item_id"), SOURCES, plan)


@query("d18_d19_template_cross", "SELECT n_nationkey, t, replace(t, '{name}', n_name) AS q FROM nation, (SELECT unnest(['why did {name} fall', 'news about {name}', 'is {name} worth holding']) AS t)")
def d18(spark, sf):
    n = read(spark, sf, "nation")
    each = n.withColumn("t", F.explode(F.array(*map(F.lit, ["why did {name} fall", "news about {name}", "is {name} worth holding"]))))
    return each.select("n_nationkey", "t", F.replace("t", F.lit("{name}"), F.col("n_name")).alias("q"))


@query("d16_typo_variants", "SELECT DISTINCT n_nationkey, v FROM (SELECT n_nationkey, unnest([substr(n_name, 1, i - 1) || substr(n_name, i + 1) FOR i IN range(1, length(n_name) + 1)]) AS v FROM nation UNION ALL SELECT n_nationkey, lower(n_name) FROM nation UNION ALL SELECT n_nationkey, upper(n_name) FROM nation)")
def d16(spark, sf):
    n = F.col("n_name")
    cut = F.transform(F.sequence(F.lit(1), F.length(n)), lambda i: F.concat(F.substring(n, F.lit(1), i - 1), F.substring(n, i + 1, F.length(n))))
    return read(spark, sf, "nation").select("n_nationkey", F.explode(F.array_union(cut, F.array(F.lower(n), F.upper(n)))).alias("v")).distinct()


@query("t12_hash_sample", "SELECT doc_id FROM documents ORDER BY sha1(CAST(doc_id AS VARCHAR)), doc_id LIMIT 50")
def t12(spark, sf):
    return T.hash_sample(read(spark, sf, "documents").select("doc_id"), "doc_id", 50)


@query("t13_t14_sample_per_label", "SELECT doc_id, lang FROM (SELECT doc_id, lang, source = 'src1' AS p, row_number() OVER (PARTITION BY lang, source = 'src1' ORDER BY sha1(CAST(doc_id AS VARCHAR)), doc_id) AS n FROM documents) WHERE p OR n <= 7")
def t13(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "lang", "source")
    return T.hash_sample_by(d, "lang", "doc_id", 7, F.col("source") == "src1").select("doc_id", "lang")


@query("t15_t17_balanced_sample", """WITH r AS (SELECT doc_id, sha1(CAST(doc_id AS VARCHAR)) AS h, row_number() OVER (PARTITION BY source ORDER BY sha1(CAST(doc_id AS VARCHAR)), doc_id) AS n, (SELECT count(DISTINCT source) FROM documents) AS g FROM documents)
  SELECT doc_id FROM r ORDER BY n > greatest(90 // g, 1), h, doc_id LIMIT 90""")
def t15(spark, sf):
    return T.balanced_sample(read(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id", 90).select("doc_id")


@query("t18_quota_cap", f"WITH {EVIDENCE}, r AS (SELECT doc_id, source_type, row_number() OVER (PARTITION BY source_type ORDER BY doc_id) AS n FROM evidence) SELECT doc_id, source_type FROM r WHERE n <= CASE source_type WHEN 'announcement' THEN 40 WHEN 'research_note' THEN 20 WHEN 'product_doc' THEN 10 ELSE 15 END")
def t18(spark, sf):
    weights = {"announcement": 0.40, "research_note": 0.20, "news": 0.15, "faq": 0.15, "product_doc": 0.10}
    caps = T.quotas(weights, 100, ["announcement", "research_note", "product_doc", "faq", "news"])
    return T.quota_cap(evidence(spark, sf).select("doc_id", "source_type"), "source_type", caps, "doc_id")


@query("t21_rank_tuple", "SELECT n_nationkey, o FROM (SELECT a.n_nationkey, b.n_name AS o, row_number() OVER (PARTITION BY a.n_nationkey ORDER BY (substr(a.n_name, 1, 1) = substr(b.n_name, 1, 1))::INT DESC, abs(length(a.n_name) - length(b.n_name)), sha1(b.n_name)) AS n FROM nation a JOIN nation b ON a.n_nationkey <> b.n_nationkey) WHERE n <= 8")
def t21(spark, sf):
    from pyspark.sql import Window as W

    n = read(spark, sf, "nation")  # a fixed dimension of nations
    a, b = n.select("n_nationkey", F.col("n_name").alias("x")), n.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("o"))
    w = W.partitionBy("n_nationkey").orderBy(F.desc((F.substring("x", 1, 1) == F.substring("o", 1, 1)).cast("int")), F.abs(F.length("x") - F.length("o")), F.sha1(F.col("o").cast("binary")))
    return a.join(b, F.col("n_nationkey") != F.col("k")).withColumn("n", F.row_number().over(w)).where("n <= 8").select("n_nationkey", "o")


@query("a22_a28_counts", f"WITH {EVIDENCE} SELECT source_type, lang, count(*) AS n FROM evidence GROUP BY GROUPING SETS ((source_type, lang), (source_type), ())")
def a22(spark, sf):
    e = evidence(spark, sf)
    both = e.rollup("source_type", "lang").agg(F.count(F.lit(1)).alias("n"))
    return both


@query("a23_pair_frequency", "SELECT p_brand, p_type, count(*) AS n, arg_max(p_name, (length(p_name), p_name)) AS longest FROM part GROUP BY 1, 2 ORDER BY n DESC, p_brand, p_type LIMIT 40")
def a23(spark, sf):
    p = read(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.max_by("p_name", F.struct(F.length("p_name"), "p_name")).alias("longest"))
    return p.orderBy(F.desc("n"), "p_brand", "p_type").limit(40)


@query("s44_first_user_turn", "SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id")
def s44(spark, sf):
    return read(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))


@query("j18_cyclic_negatives")
def j18(spark, sf):
    q = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = read(spark, sf, "documents").select("doc_id")
    positives = docs.join(q.select("query_id"), F.col("doc_id") % 40 == F.col("query_id") % 40).select("query_id", "doc_id")
    return T.cyclic_negatives(q, docs, positives, 40)


@query("j24_first_text", "SELECT source AS doc_key, arg_min(text, doc_id) AS text FROM documents GROUP BY source")
def j24(spark, sf):
    return T.first_by(read(spark, sf, "documents").select(F.col("source").alias("doc_key"), "text", "doc_id"), ["doc_key"], "doc_id").select("doc_key", "text")
