"""Source plans of the requests: learned scores, rules, coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidrel.operators import planning as N
from evidrel.plans.catalog import judgements
from evidrel.plans.learned import part
from evidrel.plans.registry import query
from evidrel.plans.views import EVIDENCE, REQUESTS, evidence, requests


def rows(spark, sf):
    """Candidates of every request; right are the kinds of the documents that hold the request's text, else the planned ones."""
    right = judgements(spark, sf).join(evidence(spark, sf).select("doc_id", "source_type"), "doc_id").groupBy("query_id").agg(F.collect_set("source_type").alias("right"))  # five kinds
    asked = requests(spark, sf).join(right, "query_id", "left")
    return N.candidate_rows(asked, F.lit(False)).withColumn("target", F.array_contains(F.coalesce("right", "source_plan"), F.col("source")))


@query("f17_m10_source_scores")
def m10(spark, sf):
    """The score of every source for every request; requests of part 0 are held out of training."""
    candidates = rows(spark, sf)
    model = N.fit(candidates.where(part("query_id", 5) != 0), F.concat_ws("/", "query_id", "source"), F.col("target"))
    return N.scored(candidates, model).select("query_id", "source", "score", F.col("target").alias("expected"), (part("query_id", 5) == 0).alias("held_out"))


@query("m9_source_plans")
def m9(spark, sf):
    """The plan of every request after scores and rules."""
    lists = N.ranked(m10(spark, sf), "query_id")
    r = requests(spark, sf).join(lists, "query_id")
    mechanism = F.array_contains("topic_labels", "product_mechanism")
    plan = N.applied(F.col("scored"), F.col("source_plan"), F.col("query"), F.col("product_type"), F.col("intent_labels"), F.col("topic_labels"), mechanism, *[F.lit(False)] * 4)  # no request is about a market segment, finance at large, a company's figures or a notice
    return r.select("query_id", F.array_join(plan, ",").alias("source_plan"))


@query("m11_targets_covered", f"""WITH {EVIDENCE}, {REQUESTS}, e AS (SELECT query_id, entity_names AS targets, [[s, split_part(s, '.', 1)] FOR s IN symbols] || [[w] FOR w IN keywords] AS tokens FROM requests)
  SELECT query_id, CASE WHEN len(targets) = 0 THEN len(tokens) >= 2 ELSE len(tokens) > 0 AND len(list_filter(targets, lambda x: len(list_filter(flatten(tokens), lambda t: t <> '' AND (contains(t, x) OR contains(x, t)))) = 0)) = 0 END AS covered FROM e""")
def m11(spark, sf):
    """Whether the named entity of every request is covered by its symbols and keywords."""
    tokens = F.concat(F.transform("symbols", lambda s: F.array(s, F.split_part(s, F.lit("."), F.lit(1)))), F.transform("keywords", lambda w: F.array(w)))
    return requests(spark, sf).select("query_id", N.targets_covered(F.col("entity_names"), tokens).alias("covered"))
