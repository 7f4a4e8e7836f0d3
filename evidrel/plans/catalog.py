"""The roles of the tables in entity resolution: a catalog of parts, its aliases, and questions that orders ask about them."""

from __future__ import annotations

from pyspark.sql import functions as F

from evidrel.plans.registry import read

#: Kinds of entities, in turn by id.
KINDS = ["stock", "etf", "fund", "index", "sector"]


def entities(spark, sf):
    """(entity_id, canonical_name, p_name, p_brand, industry_name, entity_type, symbol): parts of one name and brand are one entity, whose id is the smallest key."""
    p = read(spark, sf, "part").groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("entity_id"), F.min_by("p_type", "p_partkey").alias("industry_name"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("entity_id") % 5 + 1).cast("int"))
    return p.select("entity_id", F.concat_ws(" ", "p_name", "p_brand").alias("canonical_name"), "p_name", "p_brand", "industry_name", kind.alias("entity_type"), F.concat(F.lpad(F.col("entity_id").cast("string"), 6, "0"), F.lit(".SH")).alias("symbol"))


def aliases(spark, sf):
    """(alias_id, entity_id, alias_text, priority): the canonical name, brand and last word, and the bare name, which many share."""
    e = entities(spark, sf)
    texts = [F.col("canonical_name"), F.concat_ws(" ", "p_brand", F.element_at(F.split("p_name", " "), -1)), F.col("p_name")]
    each = e.select("entity_id", F.posexplode(F.array(*texts)).alias("k", "alias_text"))
    return each.select((F.col("entity_id") * 3 + F.col("k")).alias("alias_id"), "entity_id", "alias_text", (F.col("k") + 1).alias("priority"))


CATALOG = f"""entities AS (SELECT min(p_partkey) AS entity_id, p_name || ' ' || p_brand AS canonical_name, p_name, p_brand, arg_min(p_type, p_partkey) AS industry_name,
    {KINDS}[CAST(min(p_partkey) % 5 AS INT) + 1] AS entity_type, lpad(CAST(min(p_partkey) AS VARCHAR), 6, '0') || '.SH' AS symbol FROM part GROUP BY p_name, p_brand),
  aliases AS (SELECT entity_id * 3 + k AS alias_id, entity_id, t[k + 1] AS alias_text, k + 1 AS priority
    FROM (SELECT entity_id, [canonical_name, p_brand || ' ' || string_split(p_name, ' ')[-1], p_name] AS t, unnest([0, 1, 2]) AS k FROM entities))"""

# What comes before and after the mention, by order: the third kind loses a letter of the name, the sixth has another one, the fifth names nothing.
BEFORE = ["why did ", "what is the fee of ", "any news about ", "should I hold ", "what will the market do in ", "is "]
AFTER = [" fall today", "", " this week", "", "", " a good buy"]


def questions(spark, sf):
    """(query_id, query, mention, start, stop, entity_id, form): an order asks about the part of its dearest line."""
    line = read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct("l_extendedprice", "l_linenumber")).alias("p_partkey"))
    o = read(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").cast("string").alias("year")).join(line, F.col("o_orderkey") == F.col("l_orderkey"))
    e = entities(spark, sf).select("entity_id", "canonical_name", "p_name", "p_brand")
    q = o.join(read(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), "p_partkey").join(e, ["p_name", "p_brand"])
    form, name = F.col("o_orderkey") % 6, F.col("canonical_name")
    without = F.concat(F.substring(name, 1, 2), F.substring(name, 4, 99))
    other = F.concat(F.substring(name, 1, 4), F.lit("x"), F.substring(name, 6, 99))
    brand_first = F.concat_ws(" ", "p_brand", F.element_at(F.split("p_name", " "), -1))
    mention = F.when(form == 0, name).when(form == 1, F.col("p_name")).when(form == 2, without).when(form == 3, brand_first).when(form == 4, F.col("year")).otherwise(other)
    pick = lambda words: F.element_at(F.array(*map(F.lit, words)), (form + 1).cast("int"))
    start = F.length(pick(BEFORE))
    return q.select(
        F.col("o_orderkey").alias("query_id"), F.concat(pick(BEFORE), mention, pick(AFTER)).alias("query"), mention.alias("mention"), start.alias("start"), (start + F.length(mention)).alias("stop"),
        F.when(form != 4, F.col("entity_id")).alias("entity_id"), form.cast("int").alias("form"),
    )


QUESTIONS = f"""questions AS (SELECT o_orderkey AS query_id, {BEFORE}[CAST(form AS INT) + 1] || mention || {AFTER}[CAST(form AS INT) + 1] AS query, mention, CASE WHEN form <> 4 THEN entity_id END AS entity_id, form FROM (
    SELECT o_orderkey, o_orderkey % 6 AS form, entity_id, CASE o_orderkey % 6 WHEN 0 THEN canonical_name WHEN 1 THEN e.p_name WHEN 2 THEN substr(canonical_name, 1, 2) || substr(canonical_name, 4)
      WHEN 3 THEN e.p_brand || ' ' || string_split(e.p_name, ' ')[-1] WHEN 4 THEN CAST(year(o_orderdate) AS VARCHAR) ELSE substr(canonical_name, 1, 4) || 'x' || substr(canonical_name, 6) END AS mention
    FROM orders JOIN (SELECT l_orderkey, arg_max(l_partkey, {{'p': l_extendedprice, 'n': l_linenumber}}) AS p_partkey FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey JOIN part p USING (p_partkey) JOIN entities e ON e.p_name = p.p_name AND e.p_brand = p.p_brand))"""


# Labels of lines of a review table: relevance of a document to an item is that it holds the item's whole text.
def judgements(spark, sf):
    """(query_id, doc_id): documents that hold the whole text of a benchmark item; one pass over the texts for all items."""
    from evidrel.operators.patterns import occurrences

    items = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("pattern"))
    found = occurrences(read(spark, sf, "documents"), "text", items.select("pattern"), ["doc_id"])
    return found.join(items, "pattern").select("query_id", "doc_id").distinct()


JUDGEMENTS = "judgements AS (SELECT DISTINCT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON b.text <> '' AND contains(d.text, b.text))"
