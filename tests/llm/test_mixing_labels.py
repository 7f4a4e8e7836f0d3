"""What mixing does to documents by their true labels, and to repeated ids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evidrel.llm import mixing, queries
from evidrel.llm.common import fold, table

SF = "/root/testdata/sf0.1"


@pytest.mark.parametrize("keep", ["clean", None])
def test_true_toxic_and_poor_parts_fall_on_held_out_labels(spark, keep):
    docs, labels = table(spark, SF, "documents"), queries.label_domains(spark, SF)
    out = mixing.mix(docs, labels.where(fold("doc_id", 3) != 0), queries.DOMAIN_WEIGHTS, keep=keep)
    rows = out.join(labels.where(fold("doc_id", 3) == 0), "doc_id").groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("before"), F.sum(F.col("tokens") * F.col("copies")).alias("after"), F.count_if(F.col("copies") > 0).alias("stay")).collect()
    before, after = sum(r.before for r in rows), sum(r.after for r in rows)
    part = {r.domain: (r.before / before, r.after / after, r.stay / r.n) for r in rows}
    assert part["toxic"][1] < part["toxic"][0] / 3 and part["poor"][1] < part["poor"][0] * 2 / 3
    assert part["clean"][1] > part["clean"][0] and part["clean"][2] > 0.99


def test_presence_counts_only_over_represented_words():
    docs = np.array([1000.0, 100.0])
    counts = np.array([[900.0, 0.0, 1.0], [90.0, 30.0, 1.0]])
    on, off = mixing.presence(counts, docs, 4.0)
    assert not on[:, 0].any() and not on[:, 2].any() and on[1, 1] > 0 > on[0, 1]
    assert off[0] > off[1]  # without the telling word a text is rather of the first domain


def test_repeated_ids_and_edges(spark):
    rows = [(i, "good words here", "en", "a", 3) for i in range(40)] + [(100 + i, f"idiot words {i}", "en", "a", 3) for i in range(10)]
    rows += [(7, "good words here", "en", "a", 3), (8, "idiot idiot", "en", "a", 3), (None, "good words here", "en", "a", 3), (500, None, "en", "a", 0), (501, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labelled = spark.createDataFrame([(i, "clean") for i in range(40)] + [(100 + i, "toxic") for i in range(10)] + [(9999, "toxic")], "doc_id long, domain string")
    got = mixing.mix(docs, labelled, {"clean": 0.95, "toxic": 0.05}).collect()
    assert len(got) == len(rows)
    same = [(r.rate, r.copies) for r in got if r.doc_id == 7]
    assert len(same) == 2 and len(set(same)) == 1  # equal texts of one id: equal decisions
    assert {r.tokens for r in got if r.doc_id in (500, 501)} == {0}


def test_the_mixture_keeps_repeated_ids_together(spark, tmp_path):
    rows = [(i, f"good words here {i}", "en", "a", 3) for i in range(60)] + [(100 + i, f"idiot scum {i}", "en", "a", 3) for i in range(20)]
    rows += [(3, "good words here 3", "en", "a", 3), (4, "idiot scum other", "en", "a", 3), (None, "good words", "en", "a", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 1) for i in range(20)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.mixture(spark, docs, str(tmp_path))
    n = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert out.columns == docs.columns and all(n.get(i, 0) >= 1 for i in range(60))
    assert n[3] % 2 == 0 and n[4] % 2 == 0  # both rows of an id have the same number of copies
    assert sum(n.get(100 + i, 0) for i in range(20)) < 10
    assert corpus_pipeline.mixture(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_the_language_stage_without_labelled_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None, "a", 9), (2, "123", None, "a", 3), (3, None, None, "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.language(spark, docs, SF).collect()] == [1]
