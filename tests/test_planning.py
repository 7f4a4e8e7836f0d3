"""Source plans, coverage and the analysis summary against plain Python."""

import json
import random

from pyspark.sql import functions as F

from evidrel.operators import planning as N
from evidrel.operators import summary as Y
from evidrel.operators.understanding import SOURCE_ORDER


def plain_plan(scored, plan, query, product, intents, topics, mechanism, bucket, general, fundamental, disclosure):
    keep = [s for s, x in scored if x >= 0.42 or s in plan[:2]] or list(plan)
    first = lambda k, n: [n] + [x for x in k if x != n]
    drop = lambda k, *n: [x for x in k if x not in n]
    i, t, notice, stock = set(intents), set(topics), "公告" in query, product == "stock"
    event, basic = "event_news_query" in i, {"fundamental_analysis", "valuation_analysis"}
    if mechanism:
        keep = [s for s in keep if s in N.MECHANISM]
        keep += [s for s in N.MECHANISM if s not in keep]
    if "announcement" in keep and "news" in keep:
        keep = first(keep, "announcement" if event and notice else "news")
    elif "news" in keep and "research_note" in keep:
        keep = first(keep, "news")
    if event:
        keep = drop(keep, *N.STRUCTURED)
    if "market_explanation" in i and stock and "market_api" in plan and "market_api" not in keep:
        keep = first(keep, "market_api")
    for flag, name in ((general, "research_note"), (fundamental, "research_note"), (disclosure, "announcement")):
        if flag and name not in keep:
            keep = first(keep, name)
    if "fundamental_sql" in keep and i & basic:
        keep = first(keep, "fundamental_sql")
    if i & (basic | {"hold_judgment", "buy_sell_timing"}) and "fundamental_sql" in plan and "fundamental_sql" not in keep:
        keep = keep + ["fundamental_sql"]
    if event or notice or "新闻" in query:
        keep = drop(keep, *N.STRUCTURED)
    if stock and "risk_analysis" in i:
        keep = drop(keep, "faq")
    if stock and i & (basic | {"hold_judgment", "buy_sell_timing", "risk_analysis"}):
        keep = drop(keep, "faq", "product_doc")
    if "macro_policy_impact" not in i and not t & {"macro", "policy"} and "macro_sql" not in plan:
        keep = drop(keep, "macro_sql")
    if bucket and not disclosure:
        keep = [s for s in keep if s in N.BUCKET_SOURCES]
    return list(dict.fromkeys(keep))


def test_plans_follow_the_rules_in_order(spark):
    rng, rows = random.Random(3), []
    for k in range(400):
        scores = sorted(((s, round(rng.random(), 2)) for s in SOURCE_ORDER), key=lambda x: (-x[1], SOURCE_ORDER.index(x[0])))
        flags = [rng.random() < 0.2 for _ in range(5)]
        rows.append((k, scores, rng.sample(SOURCE_ORDER, rng.randint(0, 4)), rng.choice(["公告 了", "新闻", "why", ""]), rng.choice(["stock", "fund"]), rng.sample(N.INTENTS, rng.randint(0, 3)), rng.sample(N.TOPICS, rng.randint(0, 2)), *flags))
    df = spark.createDataFrame(rows, "k int, scored array<struct<source:string,score:double>>, plan array<string>, query string, product string, intents array<string>, topics array<string>, a boolean, b boolean, c boolean, d boolean, e boolean")
    plan = N.applied(*[F.col(c) for c in ("scored", "plan", "query", "product", "intents", "topics", "a", "b", "c", "d", "e")])
    got = {r.k: list(r.p) for r in df.select("k", plan.alias("p")).collect()}
    for r in rows:
        assert got[r[0]] == plain_plan(*r[1:]), r


def test_a_reranker_learns_and_markers_raise(spark):
    rng, rows = random.Random(4), []
    for k in range(300):
        plan = rng.sample(SOURCE_ORDER, 3)
        rows.append((k, "公告 news" if k == 0 else "some news" if k == 1 else "what", rng.choice(["stock", "fund"]), [], [], "today", plan, plan))
    df = spark.createDataFrame(rows, "query_id long, query string, product_type string, intent_labels array<string>, topic_labels array<string>, time_scope string, source_plan array<string>, wanted array<string>")
    rows = N.candidate_rows(df, F.lit(False)).withColumn("target", F.array_contains("wanted", F.col("source")))
    model = N.fit(rows, F.concat_ws("/", "query_id", "source"), F.col("target"))
    out = N.scored(rows, model)
    got = {(r.query_id, r.source): r.score for r in out.collect()}
    assert sum((got[r.query_id, r.source] >= 0.5) == r.target for r in rows.where("query_id > 1").collect()) > 0.95 * 298 * 9
    assert got[1, "news"] == 1.0 and (0, "news") not in got and got[0, "announcement"] == 1.0
    lists = {r.query_id: r.scored for r in N.ranked(out, "query_id").collect()}
    assert all([-x.score for x in s] == sorted(-x.score for x in s) for s in lists.values()) and len(lists[2]) == 9


def test_targets_are_covered(spark):
    rows = [(["茅台"], [["贵州茅台", None]]), (["茅台", "五粮液"], [["茅台"]]), ([], [["a"], ["b"]]), ([], [["a"]]), (["x"], []), (["贵州茅台"], [["茅台", ""]]), (None, [["a"], ["b"]]), (["q"], [["", None]])]
    df = spark.createDataFrame(rows, "t array<string>, k array<array<string>>").select(N.targets_covered(F.col("t"), F.col("k")).alias("c"))
    assert [r.c for r in df.collect()] == [True, False, True, False, False, True, True, False]


def test_summary_of_signals(spark):
    schema = "query_id long, ord long, source_type string, symbol string, canonical_name string, analysed boolean, close double, report_date string, pe_ttm double, pb double, roe double, indicator_code string, metric_value double"
    item = lambda q, o, s, sym=None, name=None, on=True, close=None, pe=None, code=None, v=None: (q, o, s, sym, name, on, close, None, pe, None, None, code, v)
    rows = [
        item(1, 1, "index_daily", "A", close=1.0), item(1, 2, "market_api", "A", close=2.0), item(1, 3, "market_api", "A", close=3.0), item(1, 4, "index_daily", "A", close=4.0),
        item(2, 1, "index_daily", "B", close=5.0), item(2, 2, "index_daily", "B", close=6.0), item(2, 3, "market_api", None, "name", close=7.0), item(2, 4, "market_api", None, None, close=8.0), item(2, 5, "market_api", "C", on=None, close=9.0),
        item(3, 1, "fundamental_sql", "A", pe=10.0), item(3, 2, "fundamental_sql", "B", pe=-1.0), item(3, 3, "macro_sql", code="PMI_CN", v=51.0), item(3, 4, "macro_sql", code="", v=1.0), item(3, 5, "macro_indicator", code="CN10Y", v=None), item(3, 6, "fund_nav", "A"),
    ]
    requests = spark.createDataFrame([(k, ["b", "a", "b"], None) for k in (1, 2, 3, 4)], "query_id long, intent_labels array<string>, topic_labels array<string>")
    docs = spark.createDataFrame([(1, "faq"), (3, "faq"), (3, "news"), (4, "news")], "query_id long, source_type string")
    out = Y.analysis_summary(requests, spark.createDataFrame(rows, schema), docs, ["close"])
    got = {r.query_id: r for r in out.withColumns({"m": Y.one_or_many(F.col("market")), "f": Y.one_or_many(F.col("fundamental"))}).collect()}
    assert json.loads(got[1].m) == {"symbol": "A", "close": 3.0}  # the last of market_api
    assert [x.get("close") for x in json.loads(got[2].m)] == [5.0, 7.0, 8.0]  # the first of index_daily; each without a symbol
    assert [x["valuation_assessment"] for x in json.loads(got[3].f)] == ["potentially_undervalued", "unknown"]
    assert [(x.indicator_code, x.direction) for x in got[3].indicators] == [("PMI_CN", "expansion"), ("CN10Y", "unknown")] and got[3].overall == "expansionary"
    flags = {k: tuple(got[k][f] for f in Y.FLAGS) for k in got}
    assert flags == {1: (True, False, False, False, True), 2: (True, False, False, False, True), 3: (True, True, True, True, False), 4: (False, False, False, True, False)}
    assert got[4].m is None and got[4].overall is None and got[1].relevant_intents == ["a", "b"] and got[1].relevant_topics == []
