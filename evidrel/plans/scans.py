"""Tables through the sinks and back through the scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidrel.operators import entities as E
from evidrel.plans import catalog as C
from evidrel.plans.registry import query, read
from evidrel.sources import readers, sinks
from evidrel.sources.scratch import place


@query("sc1_sk2_csv", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment, round(c_acctbal, 2) AS c_acctbal FROM customer")
def sc1(spark, sf):
    """Customers as a CSV file in a given order of fields; every column comes back as a string."""
    path, fields = place(spark, "customers") + ".csv", ["c_mktsegment", "c_name", "c_custkey", "c_acctbal"]
    sinks.csv(read(spark, sf, "customer"), path, fields)
    return readers.by_suffix(spark, path).select("c_custkey", "c_name", "c_mktsegment", F.round(F.col("c_acctbal").cast("double"), 2).alias("c_acctbal"))


@query("sc3_sk1_jsonl", "SELECT doc_id, text, lang, n_chars FROM documents")
def sc3(spark, sf):
    """Documents as JSON lines and back: nulls, line ends and other scripts come back as they were."""
    path = place(spark, "documents") + ".jsonl"
    sinks.jsonl(read(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars"), path)
    return readers.jsonl(spark, path, "doc_id long, text string, lang string, n_chars long")


@query("sc5_sc9_by_suffix", "SELECT n_nationkey, n_name, kind FROM nation, (SELECT unnest(['csv', 'jsonl', 'parquet']) AS kind)")
def sc5(spark, sf):
    """Nations in three formats, each read by what its name ends in."""
    n, out = read(spark, sf, "nation").select("n_nationkey", "n_name"), None
    for kind in ("csv", "jsonl", "parquet"):
        path = f"{place(spark, 'nations')}.{kind}"
        sinks.csv(n, path, n.columns) if kind == "csv" else sinks.jsonl(n, path) if kind == "jsonl" else n.write.parquet(path)
        got = readers.by_suffix(spark, path).select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name", F.lit(kind).alias("kind"))
        out = got if out is None else out.unionByName(got)
    return out


@query("sc10_text_lines", "SELECT line AS text, count(*) AS n FROM (SELECT trim(unnest(string_split(text, chr(10)))) AS line FROM benchmark) WHERE line <> '' GROUP BY 1")
def sc10(spark, sf):
    """The lines of the benchmark as a text file: trimmed, without blank ones."""
    path = place(spark, "lines") + ".txt"
    read(spark, sf, "benchmark").select(F.explode(F.split("text", "\n")).alias("value")).write.text(path)
    return readers.text_lines(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query("m18_carried_over")
def m18(spark, sf):
    """The entity that a customer's last question with exactly one names; customers' orders are the turns of a talk."""
    orders = read(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("conv_id"))
    turns = C.questions(spark, sf).select("query_id", "query").join(orders, "query_id").select("conv_id", F.col("query_id").alias("turn"), F.lit("user").alias("role"), F.col("query").alias("text"))
    return E.carried_over(turns, C.aliases(spark, sf), C.entities(spark, sf))
