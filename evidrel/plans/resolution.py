"""Entities in questions: fuzzy joins, the linker and the cascade of tiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidrel.operators import entities as E
from evidrel.operators import fuzzy, linking
from evidrel.plans import catalog as C
from evidrel.plans.learned import fitted_field
from evidrel.plans.registry import query, read
from evidrel.sources.scratch import dropped, written


@query("er2_j13_exact_hits", f"""WITH {C.CATALOG}, {C.QUESTIONS} SELECT query_id, alias_id, position AS start, position + length(alias_text) AS stop
  FROM (SELECT query_id, query, alias_id, alias_text, unnest(range(0, length(query))) AS position FROM questions JOIN aliases ON contains(query, alias_text)) WHERE substr(query, position + 1, length(alias_text)) = alias_text""")
def er2(spark, sf):
    """Every place where a question holds an alias."""
    return E.alias_hits(C.questions(spark, sf).select("query_id", "query"), C.aliases(spark, sf)).select("query_id", "alias_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


@query("j15_whole_names")
def j15(spark, sf):
    """Questions and entities whose whole name they hold up to a partial ratio of 90."""
    names = C.entities(spark, sf).select(F.col("entity_id").alias("name_id"), F.col("canonical_name").alias("name"))
    texts = C.questions(spark, sf).select(F.col("query_id").alias("text_id"), F.col("query").alias("text"))
    return fuzzy.partial_join(names, texts, 90).select(F.col("text_id").alias("query_id"), F.col("name_id").alias("entity_id"), F.round("score", 4).alias("score"))


@query("j16_sentence_names")
def j16(spark, sf):
    """Sentences about nations with a letter too few or another one, and nations whose names they hold up to a partial ratio of 85."""
    n = read(spark, sf, "nation")
    of = lambda key, *parts: n.select(F.concat(F.lit(key), F.col("n_nationkey").cast("string")).alias("text_id"), F.concat(*parts).alias("text"))
    texts = of("d", F.lit("WHY DID "), F.substring("n_name", 1, 2), F.substring("n_name", 4, 99), F.lit(" FALL")).unionByName(of("r", F.lit("NEWS OF "), F.substring("n_name", 1, 3), F.lit("Q"), F.substring("n_name", 5, 99)))
    texts = texts.unionByName(read(spark, sf, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("text_id"), F.upper("text").alias("text")))
    return fuzzy.partial_join(n.select(F.col("n_nationkey").alias("name_id"), F.col("n_name").alias("name")), texts, 85).select("text_id", F.col("name_id").alias("n_nationkey"), F.round("score", 4).alias("score"))


@query("f14_ml9_linker_rows")
def f14(spark, sf):
    """Every alias with its entity and eight others: the linker's features and what the fitted linker makes of them."""
    aliases, entities = C.aliases(spark, sf), C.entities(spark, sf)
    linker = linking.fit_linker(aliases, entities)
    rows = linking.linker_rows(aliases, entities).withColumns({"query": F.col("alias_text"), "mention": F.col("alias_text")})
    shown = linking.with_features(rows).withColumn("features", F.array_join(F.transform("features", lambda x: F.round(x, 4)), ","))
    out = linker.scored(rows).select("alias_id", "entity_id", "linked") if linker else rows.select("alias_id", "entity_id", F.lit(None).cast("double").alias("linked"))
    return shown.select("alias_id", "entity_id", "target", "features").join(out, ["alias_id", "entity_id"])


@query("er1_er6_cascade")
def er1(spark, sf):
    """The entities of every question: by exact aliases, near ones, whole names, or mentions of the field."""
    entities = C.entities(spark, sf)
    aliases = C.aliases(spark, sf)
    questions = written(C.questions(spark, sf), "questions")  # made once: the field is fitted on them, the cascade reads them
    out = linking.cascade(questions.select("query_id", "query"), aliases, entities, linking.fit_linker(aliases, entities), fitted_field(spark, sf, questions))
    dropped(questions)
    return out


def er_quality(spark, sf):
    """For each form of question how many of them the cascade gives the right entity, a wrong one, or none."""
    q = C.questions(spark, sf).select("query_id", "form", F.col("entity_id").alias("meant"))
    found = er1(spark, sf).groupBy("query_id").agg(F.collect_set("entity_id").alias("found"))  # a question's entities
    rows = q.join(found, "query_id", "left")
    has = F.col("found").isNotNull()
    right = F.when(F.col("meant").isNull(), ~has).otherwise(has & F.array_contains("found", F.col("meant")))
    return rows.groupBy("form").agg(F.count(F.lit(1)).alias("questions"), F.count_if(right).alias("n_right"), F.count_if(has & ~right).alias("n_wrong"), F.count_if(~has & ~right).alias("n_none"))
