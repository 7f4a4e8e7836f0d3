"""Every registered plan against its SQL, and what SQL cannot say against brute force."""

import hashlib
import math
import os
from collections import Counter

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from evidrel import plans
from evidrel.functions import text as X
from evidrel.operators import tables as T
from evidrel.operators import timeseries as S

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(frame):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 9)
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, list):
            return str([one(x) for x in v])
        return None if v is None or v is pd.NA or v is pd.NaT else str(v) if not isinstance(v, (int, float, bool)) else float(v)

    frame = frame[sorted(frame.columns)].astype(object)
    return Counter(tuple(one(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_plan_equals_sql(spark, duck, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), duck.sql(plans.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()


def test_cyclic_negatives_walk_from_the_hash(spark):
    ids, positives = list(range(0, 70, 2)), {1: {0, 4, 68}, 2: set()}
    q = spark.createDataFrame([(1, "first"), (2, "second")], "query_id long, query string")
    docs = spark.createDataFrame([(i,) for i in ids], "doc_id long")
    pos = spark.createDataFrame([(k, d) for k, v in positives.items() for d in v], "query_id long, doc_id long")
    got = {(r.query_id, r.doc_id, r["rank"]) for r in T.cyclic_negatives(q, docs, pos, 5).collect()}
    want = set()
    for k, text in ((1, "first"), (2, "second")):
        start = int(hashlib.sha1(text.encode()).hexdigest(), 16) % len(ids)
        walk = [d for d in (ids[(start + c) % len(ids)] for c in range(len(ids))) if d not in positives[k]][:5]
        want |= {(k, d, n) for n, d in enumerate(walk, 1)}
    assert got == want


def test_indicators_of_short_flat_and_rising_series(spark):
    rows = [("flat", f"2024-01-{d:02d}", 100.0) for d in range(1, 16)] + [("up", f"2024-01-{d:02d}", float(d)) for d in range(1, 16)] + [("short", "2024-01-01", 1.0), ("zero", "2024-01-01", 0.0), ("zero", "2024-01-02", 1.0), ("gap", "2024-01-01", None)]
    out = S.latest(S.indicators(spark.createDataFrame(rows, "symbol string, trade_date string, close double")))
    got = {r.symbol: r for r in out.collect()}
    assert got["flat"].rsi_14 == 50.0 and got["up"].rsi_14 == 100.0 and got["short"].rsi_14 is None
    assert got["up"].ma5 == 13.0 and got["up"].ma20 is None and got["zero"].pct_3d is None and "gap" not in got


def test_sentences_and_queries(spark):
    row = spark.createDataFrame([("“你好。世界”他说。再见！", "Why did 茅台 fall? vs ETF")], "a string, b string").select(X.sentences_zh(X.F.col("a")).alias("s"), X.normalize_query(X.F.col("b"), {"茅台": "贵州茅台"}).alias("q")).first()
    assert row.s == ["“你好。世界”他说。", "再见！"]
    assert row.q == "为什么 贵州茅台 跌 和 ETF"


def test_readers_and_sinks(spark, tmp_path):
    from evidrel.sources import readers, sinks

    lines = tmp_path / "a.jsonl"
    lines.write_text('{"a": 1, "b": "é"}\n\n{"a": 2, "b": null}\nnot json\n')
    assert readers.jsonl(spark, str(lines), "a int, b string", tolerant=True).count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.jsonl(spark, str(lines), "a int, b string").collect()
    (tmp_path / "b.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.by_suffix(spark, str(tmp_path / "b.json")).count() == 2
    (tmp_path / "c.txt").write_text("A B-ENT\nb I-ENT\nc\n\nd\tO\n")
    assert [(r.tokens, r.tags) for r in readers.bio(spark, str(tmp_path / "c.txt")).collect()] == [(["A", "b", "c"], ["B-ENT", "I-ENT", "O"]), (["d"], ["O"])]
    df = spark.createDataFrame([(1, "x", "f1"), (2, None, "f2")], "a int, b string, sample_family string")
    sinks.jsonl(df, str(tmp_path / "out.jsonl"))
    assert readers.jsonl(spark, str(tmp_path / "out.jsonl")).count() == 2 and readers.fresh_cache(spark, str(tmp_path / "out.jsonl"), ["f1", "f2"])
    sinks.csv(df, str(tmp_path / "out.csv"), ["b", "a"])
    assert readers.csv(spark, str(tmp_path / "out.csv")).columns == ["b", "a"]
    sinks.artifact(df, str(tmp_path / "run"), {"k": 1})
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.artifact(df, str(tmp_path / "run"), {"k": 1})
    os.environ["EVIDREL_X"] = "/env"
    assert readers.resolve("t", "/seed", None, "EVIDREL_X") == "/env" and readers.resolve("t", "/seed", str(tmp_path)) == "/seed/t"


def test_a_stream_adds_each_document_once(spark, tmp_path):
    from evidrel.streaming import incremental

    source = tmp_path / "in"
    source.mkdir()
    schema = "source_type string, title string, body string"
    for k, rows in enumerate([[("news", "A", "x"), ("news", "a ", "X")], [("news", "A", "x"), ("faq", "A", "x")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source / f"{k}"))
        incremental.into_mart(incremental.arriving(spark, str(source / "*"), schema), str(tmp_path / "mart"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "mart")).count() == 2
