"""Entity resolution: aliases found in queries, overlapping hits, tiers, spans and BIO tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidrel.functions.text import best_fuzzy
from evidrel.operators.patterns import occurrences


def alias_hits(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, start, stop) and the alias's columns, of every place where a query (query_id, query) holds an alias (alias_id, alias_text).

    One pass of an automaton over each query. Case counts; empty aliases are
    never found; aliases of one text are all found.
    """
    found = occurrences(queries, "query", aliases.select(F.col("alias_text").alias("pattern")), ["query_id"])
    return found.join(aliases, F.col("pattern") == F.col("alias_text")).drop("pattern")


def greedy_spans(hits: DataFrame, *keep: str) -> DataFrame:
    """Of each query the hits that do not overlap: the leftmost first, of these the longest, then the smallest priority.

    A query's hits are few; they meet in one array.
    """
    item = F.struct("start", (F.col("start") - F.col("stop")).alias("minus"), "priority", "alias_id", "stop", *keep)
    every = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("s"))
    kind = every.schema["s"].dataType
    none = F.array().cast(kind)
    free = lambda acc, x: (F.size(acc) == 0) | (F.element_at(acc, -1)["stop"] <= x["start"])
    chosen = F.aggregate("s", none, lambda acc, x: F.when(free(acc, x), F.array_append(acc, x)).otherwise(acc))
    return every.select("query_id", F.explode(chosen).alias("x")).select("query_id", "x.start", "x.stop", "x.alias_id", *[f"x.{k}" for k in keep])


def resolved_exact(queries: DataFrame, aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """(query_id, entity_id, mention, confidence .99): aliases without an entity are dropped, one row an entity."""
    known = aliases.join(entities.select("entity_id"), "entity_id")
    hits = greedy_spans(alias_hits(queries, known), "entity_id", "alias_text")
    best = hits.groupBy("query_id", "entity_id").agg(F.max_by("alias_text", F.struct(F.length("alias_text"), -F.col("start"))).alias("mention"))
    return best.withColumns({"confidence": F.lit(0.99), "match_type": F.lit("exact")})


def resolved(queries: DataFrame, aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """Exact hits; queries without any are compared with aliases that share a character, allowing edits.

    aliases is the catalog's table; the fuzzy tier meets a query with aliases
    that share its rarer characters only through the same first-character key.
    """
    exact = resolved_exact(queries, aliases, entities)
    left = queries.join(exact.select("query_id").distinct(), "query_id", "left_anti")
    known = aliases.join(entities.select("entity_id"), "entity_id").where(F.length("alias_text") >= 2)
    grams = lambda c: F.array_distinct(F.filter(F.split(c, ""), lambda x: x != ""))
    pairs = left.withColumn("c", F.explode(grams("query"))).join(known.withColumn("c", F.explode(grams("alias_text"))), "c")
    pairs = pairs.groupBy("query_id", "query", "entity_id", "alias_id", "alias_text").agg(F.count(F.lit(1)).alias("k"))
    # with at most two edits an alias shares all but two of its distinct characters
    pairs = pairs.where(F.col("k") >= F.greatest(F.size(grams("alias_text")) - 2, F.lit(1)))
    near = pairs.withColumn("m", best_fuzzy(F.col("query"), F.col("alias_text"))).where("m is not null")
    best = near.groupBy("query_id", "entity_id").agg(F.max(F.struct("m.score", "m.size", "m.text")).alias("b"))
    fuzzy = best.select("query_id", "entity_id", F.col("b.text").alias("mention"), F.col("b.score").alias("confidence"), F.lit("fuzzy").alias("match_type"))
    return exact.unionByName(fuzzy)


def ambiguous(found: DataFrame) -> DataFrame:
    """Queries in which one mention stands for several entities."""
    return found.groupBy("query_id", "mention").agg(F.count_distinct("entity_id").alias("n")).where("n > 1").select("query_id", "mention")


def carried_over(turns: DataFrame, aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """(conv_id, entity_id) of the last user turn (conv_id, turn, role, text) that names exactly one entity."""
    asked = turns.where("role = 'user'").select(F.struct("conv_id", "turn").alias("query_id"), F.col("text").alias("query"))
    one = resolved_exact(asked, aliases, entities).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.first("entity_id").alias("entity_id")).where("n = 1")
    return one.groupBy(F.col("query_id.conv_id").alias("conv_id")).agg(F.max_by("entity_id", "query_id.turn").alias("entity_id"))


def bio_tags(text: Column, spans: Column, kind: str = "ENT") -> Column:
    """Tags of the characters of a text from sorted spans (start, stop)."""
    places = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)))
    begins = lambda i: F.exists(spans, lambda s: s["start"] == i)
    inside = lambda i: F.exists(spans, lambda s: (s["start"] < i) & (i < s["stop"]))
    tags = F.transform(places, lambda i: F.when(begins(i), f"B-{kind}").when(inside(i), f"I-{kind}").otherwise("O"))
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(tags)


def tag_spans(tags: Column) -> Column:
    """(start, stop) of the entities in an array of tags; an I without a B before it begins one."""
    kind = "array<struct<start:int,stop:int>>"
    places = F.transform(tags, lambda t, i: F.struct(t.alias("t"), i.alias("i")))

    def add(acc: Column, x: Column) -> Column:
        goes_on = (F.size(acc) > 0) & F.startswith(x["t"], F.lit("I-")) & (F.element_at(acc, -1)["stop"] == x["i"])
        longer = F.array_append(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.struct(F.element_at(acc, -1)["start"].alias("start"), (x["i"] + 1).alias("stop")))
        new = F.array_append(acc, F.struct(x["i"].alias("start"), (x["i"] + 1).alias("stop")))
        return F.when(x["t"] == "O", acc).when(goes_on, longer).otherwise(new)

    return F.aggregate(places, F.array().cast(kind), add)
