"""Prepared documents against plain Python, and rules at their edges."""

import re

from pyspark.sql import functions as F

from evidrel.functions import labels as L
from evidrel.operators import preparation as P


def plain(sentences, names, symbols, title):
    company, event = re.compile("[A-Z一-鿿]{2,}(?:公司|股份|集团|银行|证券|保险|实业|控股)"), re.compile("([A-Z一-鿿]{2,8})(?:发布|披露|公告|股价|财报|业绩)")
    if not names:
        return sentences, []
    strong, generic, hits = [], [], []
    for s in sentences:
        about = [y for x, y in zip(names, symbols) if x in s]
        others = [m for m in company.findall(s) if m not in names] + [m for m in event.findall(s) if m not in names and m not in ("市场", "行业", "板块")]
        if about:
            strong.append(s)
            hits += [about[0]] * (about[0] not in hits)
        elif not others:
            generic.append(s)
    return (strong + generic, hits) if strong + generic else ([title] * bool(title) + [s for s in sentences if s.strip()][:3], [])


def test_relevant_sentences_equal_plain_python(spark):
    mixed = ["茅台股价下跌。", "平安银行发布财报。", "市场公告很多。", "今天天气好。", "五粮液与茅台。", "ABC公司上涨。"]
    cases = [(mixed, ["茅台", "五粮液"], ["600519", "000858"], "标题"), (mixed[1:2] * 4, ["茅台"], ["600519"], "标题"), (mixed[1:2], ["茅台"], ["600519"], ""), (mixed, [], [], "x"), ([], ["茅台"], ["600519"], "标题"), (mixed[::-1], ["五粮液"], ["000858"], None)]
    df = spark.createDataFrame(list(enumerate(cases)), "k int, c struct<s array<string>, n array<string>, y array<string>, t string>").select("k", "c.*")
    text, hits = P.relevant(F.col("s"), F.col("n"), F.col("y"), F.col("t"))
    got = {r["k"]: (r["text"], r["hits"]) for r in df.select("k", text.alias("text"), hits.alias("hits")).collect()}
    assert got == {k: plain(*c) for k, c in enumerate(cases)}


def test_levels_skips_and_counts(spark):
    rows = [("news", "b", True, "t", "s"), ("news", None, True, "t", "s"), ("news", None, False, "t", ""), ("news", None, None, None, "s"), ("faq", "b", True, "t", "s"), (None, "b", True, "t", "s")]
    schema = "source_type string, body string, body_available boolean, title string, summary string"
    docs = spark.createDataFrame(rows, schema).selectExpr("*", "'stock' as product_type", "array('x') as names", "array('1') as symbols")
    got = [(r["text"], r["text_level"], r["skip"]) for r in P.prepared(docs).collect()]
    assert got[:4] == [("b", "full", None), ("", "short", "empty text after extraction"), ("t", "short", None), ("\ns", "short", None)]
    assert [g[2] for g in got[4:]] == ["unsupported source_type=faq", "unsupported source_type="]
    assert P.filter_meta(P.prepared(docs), "product_type").first()[1:] == (3, 3, 2)
    assert P.prepared(docs.withColumn("product_type", F.lit("product_info"))).isEmpty()


def test_rules_of_nulls_and_edges(spark):
    rows = [(None,), ("",), ("甲乙银行",), ("甲银行板块",), ("银行",), ("降准",), ("估值",), ("茅台估值",)]
    t = F.col("t")
    got = spark.createDataFrame(rows, "t string").select(L.product_type(t).alias("p"), L.bucket_market(t).alias("b"), L.macro_codes(t).alias("c"), L.query_head(t).alias("h"), L.target_name(t).alias("n")).collect()
    assert [r["b"] for r in got] == [False, False, False, True, True, False, False, False]
    assert got[0]["p"] == "unknown" and got[0]["h"] == "" and got[5]["c"] == ["M2_CN", "CN10Y"]
    assert [r["n"] for r in got[6:]] == ["估值", "茅台"]


def test_texts_without_a_comparison_are_not_searched(spark):
    """A word of 200 000 characters takes the patterns a step for each pair of its places; no joining word, no match."""
    import time

    cases = [("x" * 200_000, []), ("茅台和五粮液哪个好", ["茅台", "五粮液"]), ("跟黄金风险谁更稳", ["黄金风险"]), ("茅台和五粮液", []), ("比 哪个", []), ("", [])]
    df = spark.createDataFrame(cases, "t string, want array<string>")
    began = time.time()
    assert all(list(r.got) == list(r.want) for r in df.select("want", L.comparison_targets(F.col("t")).alias("got")).collect())
    assert time.time() - began < 20
