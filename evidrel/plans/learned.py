"""Models that are trained on the tables: roles of turns, labels of texts, mentions in questions, ranks of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidrel.functions import scalars as S
from evidrel.learning import crf, hashed, linear, ranking
from evidrel.operators import patterns
from evidrel.operators import tables as T
from evidrel.plans import catalog as C
from evidrel.plans.registry import query, read
from evidrel.plans.views import AS_OF, evidence, requests
from evidrel.sources.scratch import written


def part(key: str, n: int) -> Column:
    """Which of n parts a row belongs to, by its key; part 0 is held out of training."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


@query("ml2_ml5_roles")
def ml2(spark, sf):
    """Who speaks in every turn of the conversations: one of several classes, learned from four fifths of the conversations."""
    turns = read(spark, sf, "conversations").withColumn("held_out", part("conv_id", 5) == 0)
    known = turns.where("not held_out").withColumn("row_key", F.concat_ws("/", "conv_id", "turn"))
    model = linear.fit_classes(known, "row_key", "text", "role", hashed.TEXT_PLACES, hashed.texts)
    label, score = linear.best_class(model.classes, F.col("probabilities"))
    return linear.predict(turns, model, "text", hashed.texts, exclusive=True, columns=["conv_id", "turn", "role", "held_out"]).select("conv_id", "turn", "role", "held_out", label.alias("predicted"), score.alias("score"))


LABELS = ["quality", "toxic"]


def labelled_documents(spark, sf) -> DataFrame:
    """(doc_id, text, quality, toxic, part): part 0 is held out, part 1 tunes thresholds."""
    return read(spark, sf, "documents").select("doc_id", "text").join(read(spark, sf, "labels"), "doc_id").withColumn("part", part("doc_id", 5))


def scored_labels(spark, sf) -> tuple[DataFrame, dict[str, float]]:
    """Probabilities of the labels of all labelled documents (several may hold at once), and tuned thresholds."""
    docs = labelled_documents(spark, sf)
    model = linear.fit(docs.where("part > 1"), "doc_id", "text", {c: F.col(c) for c in LABELS}, hashed.TEXT_PLACES, hashed.texts)
    scored = written(linear.predict(docs, model, "text", hashed.texts, exclusive=False, columns=["doc_id", *LABELS, "part"]), "scored-labels")
    return scored, linear.tuned_thresholds(scored.where("part = 1"), LABELS, {c: F.col(c) for c in LABELS})


@query("ml3_ml14_labels")
def ml3(spark, sf):
    """The labels chosen for every labelled document."""
    scored, thresholds = scored_labels(spark, sf)
    chosen = linear.selected_labels(LABELS, thresholds, F.col("probabilities"))
    return scored.select("doc_id", (F.col("part") == 0).alias("held_out"), F.array_join(F.transform(chosen, lambda x: F.concat_ws(":", x["label"], x["score"].cast("string"))), ",").alias("labels"))


@query("ml3_f1")
def ml3_f1(spark, sf):
    """Precision, recall and F1 of each label on the documents held out."""
    scored, thresholds = scored_labels(spark, sf)
    rows = scored.where("part = 0").select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.lit(thresholds[c]).alias("threshold"), F.element_at("probabilities", k + 1).alias("p"), F.col(c).alias("truth")) for k, c in enumerate(LABELS)])).alias("r")).select("r.*")
    hit, said, true = map(F.count_if, [F.expr("p >= threshold and truth = 1"), F.expr("p >= threshold"), F.expr("truth = 1")])
    return rows.groupBy("label", "threshold").agg(F.count(F.lit(1)).alias("n"), true.alias("n_true"), F.when(said > 0, hit / said).alias("precision"), F.when(true > 0, hit / true).alias("recall"), F.when(said + true > 0, 2 * hit / (said + true)).alias("f1"))


#: Steps of the fit of the field of mentions.
FIELD_STEPS = 30


def annotated(spark, sf, questions: DataFrame | None = None) -> DataFrame:
    """Questions (those given, if any) with the place of their mention; those about every fifth entity are held out."""
    q = (C.questions(spark, sf) if questions is None else questions).withColumn("held_out", F.coalesce(F.col("entity_id") % 5 == 0, F.col("query_id") % 5 == 0))
    spans = F.when(F.col("entity_id").isNotNull(), F.array(F.struct("start", "stop"))).otherwise(F.array().cast("array<struct<start:int,stop:int>>"))
    return q.withColumn("spans", spans)


def fitted_field(spark, sf, questions: DataFrame | None = None):
    """The field of mentions, from all questions that are not held out."""
    return crf.fit(annotated(spark, sf, questions).where("not held_out"), "query", "spans", iterations=FIELD_STEPS)[0]


@query("er7_ml11_mentions")
def er7(spark, sf):
    """Mentions that the field decodes in every question."""
    found = crf.mentions(annotated(spark, sf).select("query_id", "query", "mention", "held_out", F.col("entity_id").isNotNull().alias("has_mention")), fitted_field(spark, sf), "query")
    texts = F.transform("mentions", lambda m: m["text"])
    return found.select("query_id", "held_out", "has_mention", F.array_join(texts, "|").alias("mentions"), F.when(F.col("has_mention"), F.array_contains(texts, F.col("mention"))).otherwise(F.size("mentions") == 0).alias("right"))


@query("er9_ad16_labels")
def er9(spark, sf):
    """Tags of the characters of every question where it holds aliases, longer aliases first."""
    names = C.aliases(spark, sf).select(F.col("alias_text").alias("pattern"))
    got = patterns.labelled(C.questions(spark, sf), "query", names, ["query_id"])
    places = F.transform("spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"), s["text"]))
    return got.select("query_id", F.array_join(places, ",").alias("spans"))


@query("j17_judged", f"""WITH {C.JUDGEMENTS} SELECT query_id, doc_id, 1.0::DOUBLE AS retrieval_score FROM judgements""")
def j17(spark, sf):
    """Judged pairs whose document exists: the documents that hold the whole text of an item."""
    return C.judgements(spark, sf).select("query_id", "doc_id", F.lit(1.0).alias("retrieval_score"))


#: Negatives of a query that train, and that it is judged with.
TRAIN_NEGATIVES, EVAL_NEGATIVES = 4, 40
TOP = 10


def judged_rows(spark, sf, negatives: int) -> DataFrame:
    """Features of judged documents and of negatives that the query's hash walks to."""
    asked, docs = requests(spark, sf), evidence(spark, sf)
    judged = C.judgements(spark, sf)
    queries = judged.select("query_id").distinct()
    wrong = T.cyclic_negatives(asked.join(queries, "query_id", "left_semi").select("query_id", "query"), docs.select("doc_id"), judged, negatives).select("query_id", "doc_id")
    pool = judged.withColumn("relevance", F.lit(1)).unionByName(wrong.withColumn("relevance", F.lit(0)))
    known = asked.withColumnRenamed("product_type", "wanted")
    rows = pool.join(docs, "doc_id").join(ranking.with_defaults(queries, known, "query_id"), "query_id")
    rows = rows.withColumn("retrieval_score", S.lexical_similarity(F.col("query"), F.concat_ws(" ", "title", "body"))).withColumns(S.ranking_features(F.expr(AS_OF)))
    base = S.baseline_rank(*map(F.col, ["lexical_score", "title_hit", "entity_exact_match", "product_type_match", "recency_score", "source_credibility"]))
    return rows.select("query_id", "doc_id", "relevance", *S.FEATURE_NAMES, base.alias("baseline"), (part("query_id", 2) == 0).alias("held_out"))


def fitted_ranker(spark, sf):
    known = judged_rows(spark, sf, TRAIN_NEGATIVES).where("not held_out")
    return ranking.fit(known, S.FEATURE_NAMES, "relevance", F.concat_ws("/", "query_id", "doc_id"))


@query("ir14_eval_ranks")
def ir14(spark, sf):
    """Judged documents and 40 walked negatives of each judged query, ranked by the baseline, by the learned ranker and by both."""
    ranker, rows = fitted_ranker(spark, sf), judged_rows(spark, sf, EVAL_NEGATIVES)
    learned = ranker.score() if ranker else F.col("baseline")
    rows = rows.withColumn("learned", learned).withColumn("hybrid", ranking.hybrid(F.col("baseline"), F.col("learned")))
    place = lambda c: F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(c), "doc_id"))  # noqa: E731  a query's pool: its judged documents and 40 others
    return rows.select("query_id", "doc_id", "relevance", "held_out", *[x for c in ("baseline", "learned", "hybrid") for x in (F.col(c), place(c).alias(f"{c}_rank"))])


@query("ml10_f7_rank_quality")
def ml10(spark, sf):
    """Recall, reciprocal rank and gain at 10 of the three rankings, on the queries held out of training and on the others."""
    rows = ir14(spark, sf)
    each = rows.select("query_id", "relevance", "held_out", F.explode(F.create_map(*[x for c in ("baseline", "learned", "hybrid") for x in (F.lit(c), F.col(f"{c}_rank"))])).alias("method", "rank"))
    inside = (F.col("rank") <= TOP) & (F.col("relevance") >= 1)
    gain = lambda r: F.log2(F.lit(1.0) + r)
    best = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(TOP)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1 / gain(i))
    per = each.groupBy("method", "held_out", "query_id").agg(F.sum("relevance").alias("n"), F.count_if(inside).alias("hits"), F.min(F.when(inside, F.col("rank"))).alias("first"), F.coalesce(F.sum(F.when(inside, 1 / gain(F.col("rank")))), F.lit(0.0)).alias("dcg"))
    per = per.where("n > 0").withColumn("ndcg", F.col("dcg") / best)
    return per.groupBy("method", "held_out").agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg(F.col("hits") / F.col("n")), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.avg("ndcg"), 6).alias("ndcg"))
