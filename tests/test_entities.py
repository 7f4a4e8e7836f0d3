"""Entity resolution against brute force."""

import random

from pyspark.sql import functions as F

from evidrel.operators import entities as E


def test_exact_resolution_is_greedy(spark):
    rng = random.Random(4)
    words = ["ab", "abc", "b", "茅台", "贵州茅台", "c a", "台"]
    aliases = [(k, k % 5, w, k % 3) for k, w in enumerate(words)] + [(90, 99, "ab", 0), (91, 0, "", 0)]
    queries = [(i, "".join(rng.choices(["a", "b", "c", " ", "茅", "台", "贵", "州"], k=rng.randint(0, 14)))) for i in range(120)] + [(500, "贵州茅台和茅台"), (501, None)]
    a = spark.createDataFrame(aliases, "alias_id int, entity_id int, alias_text string, priority int")
    q = spark.createDataFrame(queries, "query_id int, query string")
    entities = spark.createDataFrame([(k,) for k in range(5)], "entity_id int")
    want = set()
    for i, text in queries:
        hits = sorted((s, -len(w), p, k, s + len(w), e, w) for k, e, w, p in aliases if w and e < 5 for s in range(len(text or "") - len(w) + 1) if text[s : s + len(w)] == w)
        stop, best = 0, {}
        for s, _, _, _, t, e, w in hits:
            if s >= stop:
                stop = t
                if e not in best or (len(w), -s) > best[e][0]:
                    best[e] = ((len(w), -s), w)
        want |= {(i, e, w) for e, (_, w) in best.items()}
    assert {(r.query_id, r.entity_id, r.mention) for r in E.resolved_exact(q, a, entities).collect()} == want


def test_fuzzy_tier_only_without_exact_hits(spark):
    a = spark.createDataFrame([(1, 1, "guangdong", 0), (2, 2, "moutai", 0)], "alias_id int, entity_id int, alias_text string, priority int")
    q = spark.createDataFrame([(1, "news of moutai and guangdnng"), (2, "why did mowtai fall"), (3, "nothing")], "query_id int, query string")
    got = {(r.query_id, r.entity_id, r.match_type) for r in E.resolved(q, a, spark.createDataFrame([(1,), (2,)], "entity_id int")).collect()}
    assert got == {(1, 2, "exact"), (2, 2, "fuzzy")}


def test_context_entity_and_tags(spark):
    a = spark.createDataFrame([(1, 1, "ab", 0), (2, 2, "cd", 0)], "alias_id int, entity_id int, alias_text string, priority int")
    turns = spark.createDataFrame([(1, 0, "user", "ab"), (1, 1, "user", "ab cd"), (1, 2, "assistant", "cd"), (2, 0, "user", "x")], "conv_id int, turn int, role string, text string")
    e = spark.createDataFrame([(1,), (2,)], "entity_id int")
    assert [(r.conv_id, r.entity_id) for r in E.carried_over(turns, a, e).collect()] == [(1, 1)]
    spans = F.array(F.struct(F.lit(1).alias("start"), F.lit(3).alias("stop")), F.struct(F.lit(3).alias("start"), F.lit(4).alias("stop")))
    row = spark.range(1).select(E.bio_tags(F.lit("xabcy"), spans).alias("t")).select("t", E.tag_spans(F.col("t")).alias("s")).first()
    assert row.t == ["O", "B-ENT", "I-ENT", "B-ENT", "O"] and [(x.start, x.stop) for x in row.s] == [(1, 3), (3, 4)]
