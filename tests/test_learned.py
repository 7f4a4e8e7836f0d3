"""Hashed features, distributed descent, the field of mentions, pattern search and the learned ranker against plain Python."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidrel.learning import crf, hashed, linear, ranking
from evidrel.operators import patterns
from evidrel.plans import learned
from evidrel.functions import scalars as S

SF = "/root/testdata/sf0.001"


def test_features_are_unit_vectors_of_the_grams():
    at, x = hashed.text_row("The cat, the CAT sat")
    words, chars = at < hashed.BUCKETS, at >= hashed.BUCKETS
    assert math.isclose(x[words] @ x[words], 1) and math.isclose(x[chars] @ x[chars], 1)
    # the, cat, sat; the cat, cat the, cat sat: three are there twice
    assert sorted(np.round(x[words] ** 2 * 15).tolist()) == [1, 1, 1, 4, 4, 4]
    grams = Counter(g for w in "the cat, the cat sat".split() for n in (2, 3, 4) for p in [f" {w} "] for g in (p[i : i + n] for i in range(len(p) - n + 1)))
    total = sum(n * n for n in grams.values())
    assert sorted(np.round(x[chars] ** 2 * total).tolist()) == sorted(n * n for n in grams.values())
    assert len(hashed.text_row(None)[0]) == len(hashed.text_row("  \n")[0]) == 0
    assert hashed.named([{"a": 2.0, "b": 0.5}, None])[0][1].sum() == 2.5


def plain_descent(rows, shards, outputs, places, epochs):
    """rows: (shard, order by epoch, at, x, y, weight); weights and steps written out."""
    n = len(rows)
    w, bias = np.zeros((outputs, places)), np.zeros(outputs)
    for epoch in range(epochs):
        sums, total = 0, 0
        for s in range(shards):
            v, b, t = w.copy(), bias.copy(), epoch * (n // shards)
            mine = sorted((r for r in rows if r[0] == s), key=lambda r: r[1][epoch])
            for _, _, at, x, y, weight in mine:
                p = 1 / (1 + np.exp(-(v[:, at] @ x + b)))
                step = linear.ETA / (1 + linear.ALPHA * linear.ETA * t)
                v *= 1 - step * linear.ALPHA
                v[:, at] -= step * np.outer(weight * (p - y), x)
                b -= step * weight * (p - y)
                t += 1
            sums, total = sums + len(mine) * np.hstack([v, b[:, None]]), total + len(mine)
        w, bias = sums[:, :-1] / total, sums[:, -1] / total
    return w, bias


def test_shards_of_descent_are_a_plain_loop(spark):
    rng = random.Random(2)
    texts = [(i, " ".join(rng.choices("alpha beta gamma delta epsilon".split(), k=rng.randint(1, 6))), rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(90)]
    docs = spark.createDataFrame(texts + [(91, None, 1, 0)], "id long, text string, a int, b int")
    model = linear.fit(docs, "id", "text", {"a": F.col("a"), "b": F.col("b")}, hashed.TEXT_PLACES, hashed.texts, weights={"b": F.lit(2.0)}, epochs=2, shard_rows=40)
    order = [F.xxhash64(F.col("id").cast("string"), F.lit(e)).alias(f"o{e}") for e in (0, 1)]
    placed = docs.select("id", *order).repartition(3, F.xxhash64(F.col("id").cast("string"), F.lit(17))).withColumn("shard", F.spark_partition_id()).collect()
    known = {r[0]: r for r in [*texts, (91, None, 1, 0)]}
    rows = [(r.shard, (r.o0, r.o1), *hashed.text_row(known[r.id][1]), np.array([known[r.id][2] or 0, known[r.id][3]]), np.array([known[r.id][2] is not None, 2.0])) for r in placed]
    w, bias = plain_descent(rows, 3, 2, hashed.TEXT_PLACES, 2)
    assert np.allclose(model.w, w) and np.allclose(model.bias, bias)


def test_classes_are_learned_and_ties_go_to_the_first(spark):
    words = {"news": "market falls today", "faq": "how do I open", "note": "we rate target"}
    rows = [(i, f"{words[c]} {i % 7}", c) for i in range(120) for c in words]
    docs = spark.createDataFrame([(k, t, c) for k, (_, t, c) in enumerate(rows)], "id long, text string, kind string")
    model = linear.fit_classes(docs, "id", "text", "kind", hashed.TEXT_PLACES, hashed.texts)
    label, score = linear.best_class(model.classes, F.col("probabilities"))
    got = linear.predict(docs, model, "text", hashed.texts, exclusive=True).select("kind", label.alias("label"), score.alias("score"), F.aggregate("probabilities", F.lit(0.0), lambda a, p: a + p).alias("sum")).collect()
    assert all(r.kind == r.label and abs(r.sum - 1) < 1e-9 and 0 < r.score <= 1 for r in got)
    tie = spark.createDataFrame([([0.4, 0.4, 0.2],)], "probabilities array<double>").select(label).first()[0]
    assert tie == model.classes[0]
    assert linear.fit_classes(docs.where("kind = 'faq'"), "id", "text", "kind", hashed.TEXT_PLACES, hashed.texts) is None
    assert linear.fit(docs.limit(0), "id", "text", {"a": F.lit(1)}, hashed.TEXT_PLACES, hashed.texts) is None


def plain_selection(classes, thresholds, p):
    ranked = sorted(((c, round(x + 1e-12, 2)) for c, x in zip(classes, p, strict=True)), key=lambda x: -x[1])
    chosen = [x for x in ranked if x[1] >= thresholds[x[0]]] or ranked[:1]
    if len(chosen) == 1 and len(ranked) > 1 and ranked[1][1] >= max(0.12, chosen[0][1] - 0.08):
        chosen = ranked[:2]
    return chosen[:4]


def test_labels_are_selected_and_thresholds_tuned_as_in_plain_python(spark):
    rng = random.Random(3)
    classes = ["a", "b", "c", "d", "e"]
    rows = [([round(rng.random() * rng.choice([0.3, 1]), 2) for _ in classes], [rng.randint(0, 1) for _ in classes]) for _ in range(200)] + [([0.1, 0.1, 0.1, 0.1, 0.1], [0] * 5)]
    scored = spark.createDataFrame(rows, "probabilities array<double>, y array<int>")
    truth = {c: F.element_at("y", k + 1) for k, c in enumerate(classes)}
    thresholds = linear.tuned_thresholds(scored, classes, truth)

    def f1(k, t):
        hit = sum(p[k] >= t and y[k] for p, y in rows)
        return 2 * hit / max(1, sum(p[k] >= t for p, _ in rows) + sum(y[k] for _, y in rows))

    for k, c in enumerate(classes):
        assert f1(k, thresholds[c]) == max(f1(k, t) for t in linear.THRESHOLDS)
    assert set(linear.tuned_thresholds(scored.limit(0), classes, truth).values()) == {linear.USUAL_THRESHOLD}
    got = scored.select("probabilities", linear.selected_labels(classes, thresholds, F.col("probabilities")).alias("s")).collect()
    for r in got:
        assert [(x.label, x.score) for x in r.s] == plain_selection(classes, thresholds, r.probabilities)


def enumerated(chain, u):
    """Every sequence of tags of one text and its score."""
    out = {}
    for y in itertools.product(range(3), repeat=len(u)):
        out[y] = sum(u[t, k] for t, k in enumerate(y)) + sum(chain.move[a, b] for a, b in itertools.pairwise(y))
    return out


def test_chain_is_exact_on_short_texts():
    rng = np.random.default_rng(4)
    chain = crf.Chain.of(rng.normal(size=crf.SIZE))
    texts = ["a", "Ab 1", "xy", "", "  zé的", "abcab"]
    places, sizes = crf.features(texts)
    u = chain.batch(places, sizes)
    z, one, both = chain.marginals(u, sizes)
    best = chain.viterbi(u, sizes)
    for r, n in enumerate(sizes):
        scores = enumerated(chain, u[r, :n])
        total = math.log(sum(map(math.exp, scores.values())))
        if n:
            assert math.isclose(z[r], total)
            assert tuple(best[r]) == max(scores, key=scores.get)
        for t in range(n):
            for k in range(3):
                assert math.isclose(one[r, t, k], sum(math.exp(s - total) for y, s in scores.items() if y[t] == k), abs_tol=1e-9)
                for j in range(3):
                    if t + 1 < n:
                        assert math.isclose(both[r, t, k, j], sum(math.exp(s - total) for y, s in scores.items() if (y[t], y[t + 1]) == (k, j)), abs_tol=1e-9)


def test_features_of_a_block_are_those_of_each_text():
    texts = ["ab", "", "x", "Über 9 的的", "tail"]
    places, sizes = crf.features(texts)
    each = [crf.features([t])[0] for t in texts]
    assert sizes.tolist() == [2, 0, 1, 9, 4] and (places == np.concatenate(each)).all()
    flags = crf.features(["A1 "])[0]
    assert flags[0, 16] != crf.BUCKETS and flags[1, 16] == crf.BUCKETS and flags[2, 17] != crf.BUCKETS and flags[0, 18] != crf.BUCKETS and flags[2, 19] != crf.BUCKETS


def test_slope_is_the_derivative():
    rng = np.random.default_rng(5)
    w = rng.normal(size=crf.SIZE) * 0.3
    texts, tags = ["a B1", "xyz", "q"], [np.array([0, 0, 1, 2]), np.array([1, 2, 2]), np.array([0])]
    places, sizes = crf.features(texts)
    loss, slope = crf.loss_and_slope(crf.Chain.of(w), places, sizes, tags)
    used = [*rng.choice(np.flatnonzero(slope), 25), *range(crf.SIZE - 9, crf.SIZE)]
    for i in used:
        up = w.copy()
        up[i] += 1e-6
        assert math.isclose((crf.loss_and_slope(crf.Chain.of(up), places, sizes, tags)[0] - loss) / 1e-6, slope[i], abs_tol=1e-4)


def test_the_minimum_has_no_descent_left():
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(60, 20)), rng.normal(size=60)
    f = lambda w: (0.5 * ((a @ w - b) ** 2).sum(), a.T @ (a @ w - b))
    w, trace = crf.minimised(f, np.zeros(20), 8.0, 0.1, 200, 1e-12)
    g = f(w)[1] + 0.2 * w
    assert (w == 0).any() and (w != 0).any() and all(x >= y for x, y in itertools.pairwise(trace))
    assert np.allclose(g[w != 0], -8.0 * np.sign(w[w != 0]), atol=1e-3) and (np.abs(g[w == 0]) <= 8.0 + 1e-3).all()


def test_texts_that_repeat_count_as_often_as_they_are_there():
    w = np.random.default_rng(6).normal(size=crf.SIZE) * 0.3
    texts, tags, times = ["a B1", "", "xyz", "q"], [np.array([0, 0, 1, 2]), np.zeros(0, int), np.array([1, 2, 2]), np.array([0])], [3, 2, 1, 5]
    again = [i for i, n in enumerate(times) for _ in range(n)]
    loss, slope = crf.loss_and_slope(crf.Chain.of(w), *crf.features([texts[i] for i in again]), [tags[i] for i in again])
    got, weighed = crf.loss_and_slope(crf.Chain.of(w), *crf.features(texts), tags, np.array(times, float))
    assert math.isclose(got, loss) and np.allclose(weighed, slope)


def test_the_field_is_fitted_on_all_questions(spark, monkeypatch):
    """Without weights each character costs log 3; half of the questions are one text."""
    questions = spark.range(20_000).selectExpr("id as query_id", "if(id % 2 = 0, 'why did it fall', concat('news of ', id)) as query", "8 as start", "10 as stop", "id % 7 as entity_id")
    losses = []
    monkeypatch.setattr(crf, "minimised", lambda f, w, *_: (w, losses.append(f(w)[0])))
    learned.fitted_field(spark, SF, questions)
    known = questions.where("entity_id % 5 != 0")
    assert math.isclose(losses[0], known.agg(F.sum(F.length("query"))).first()[0] * math.log(3), rel_tol=1e-9)


def test_the_field_finds_names_it_never_saw(spark):
    rng = random.Random(7)
    name = lambda: "".join(rng.choices("abcdefgh", k=4)).title() + " " + "".join(rng.choices("mnopq", k=3)).title()
    rows = []
    for _ in range(300):
        n = name()
        before = rng.choice(["why did ", "news of ", "is "])
        rows.append((before + n + " fall", [(len(before), len(before) + len(n))], n))
    rows += [("what is a fund", [], None), ("", [], None), (None, None, None), ("null spans", None, None)] * 5
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:int,stop:int>>, name string")
    chain, trace = crf.fit(df, "text", "spans", iterations=30)
    assert trace[-1] < 0.2 * trace[0]
    new = [(f"why did {n} fall", n) for n in (name() for _ in range(60))]
    got = crf.mentions(spark.createDataFrame([*new, (None, None), ("", None)], "text string, name string"), chain, "text").collect()
    assert sum([m.text for m in r.mentions] == [r.name] for r in got if r.name) >= 54
    assert all(r.mentions == [] for r in got if not r.text)
    assert crf.spans_of("ab cd", np.array([2, 0, 1, 1, 2])) == [{"start": 3, "stop": 5, "text": "cd"}]
    empty, _ = crf.fit(df.limit(0), "text", "spans", iterations=2)
    assert not empty.emit.any()


def naive(text, names):
    return sorted((i, i + len(p), p) for p in set(names) if p for i in range(len(text)) if text.startswith(p, i))


def naive_labels(text, names):
    taken, out = [False] * len(text), []
    for p in sorted({p for p in names if p}, key=lambda p: (-len(p), p)):
        at = text.find(p)
        while at >= 0:
            if any(taken[at : at + len(p)]):
                at = text.find(p, at + 1)
                continue
            taken[at : at + len(p)] = [True] * len(p)
            out.append((at, at + len(p), p))
            at = text.find(p, at + len(p))
    return sorted(out)


@pytest.mark.parametrize("most", [1, 12, 10**6])
def test_patterns_are_found_as_by_naive_search(spark, most):
    rng = random.Random(9)
    names = ["ab", "b", "abab", "ba a", "的", "aé", "bab", "", None, "ab"]
    texts = [(i, "".join(rng.choices("ab é的", k=rng.randint(0, 25)))) for i in range(120)] + [(120, None), (121, "")]
    df, p = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame([(n,) for n in names], "pattern string")
    known = [n for n in names if n]
    got = {}
    for r in patterns.occurrences(df, "t", p, ["id"], most).collect():
        got.setdefault(r.id, []).append((r.start, r.stop, r.pattern))
    assert {k: sorted(v) for k, v in got.items()} == {i: naive(t, known) for i, t in texts if t and naive(t, known)}
    spans = {r.id: [(s.start, s.stop, s.text) for s in r.spans] for r in patterns.labelled(df, "t", p, ["id"], most).collect()}
    assert spans == {i: naive_labels(t or "", known) for i, t in texts}
    assert patterns.labelled(df, "t", p.limit(0), ["id"]).where("size(spans) > 0").count() == 0


def test_a_ranker_standardises_and_learns(spark):
    rng = np.random.default_rng(10)
    rows = [(int(i), float(rng.normal(3, 2)), float(rng.normal(-1, 5)), None if i % 9 == 0 else 7.0) for i in range(400)]
    rows = [(*r, int(r[1] - 0.2 * r[2] > 3.2)) for r in rows]
    df = spark.createDataFrame(rows, "id long, f double, g double, h double, relevance int")
    model = ranking.fit(df, ["f", "g", "h"], "relevance", F.col("id"), epochs=5)
    x = np.array([[r[1], r[2], r[3] or 0.0] for r in rows])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.std, x.std(axis=0))
    got = {r.id: r.s for r in df.select("id", model.score().alias("s")).collect()}
    want = 1 / (1 + np.exp(-((x - x.mean(axis=0)) / x.std(axis=0) @ np.array(model.w) + model.bias)))
    assert all(abs(got[r[0]] - p) < 1e-4 for r, p in zip(rows, want, strict=True))
    assert sum((got[r[0]] > 0.5) == bool(r[4]) for r in rows) > 380
    assert ranking.fit(df.where("relevance = 1"), ["f"], "relevance", F.col("id")) is None


def test_missing_labels_of_queries_get_defaults(spark):
    q = spark.createDataFrame([(1,), (2,)], "query_id long")
    known = spark.createDataFrame([(1, "etf", ["a"], "today")], "query_id long, wanted string, keywords array<string>, time_scope string")
    got = {r.query_id: r for r in ranking.with_defaults(q, known, "query_id").collect()}
    assert (got[2].wanted, got[2].keywords, got[2].time_scope) == ("unknown", [], "unspecified") and got[1].wanted == "etf"


def test_evaluation_ranks_every_pool_and_the_metrics_follow(spark):
    rows = learned.ir14(spark, SF).toPandas()
    assert len(rows) and (rows.groupby("query_id")["relevance"].sum() > 0).all()
    for _, pool in rows.groupby("query_id"):
        assert len(pool) == pool["relevance"].sum() + 40 and pool["doc_id"].is_unique
        for m in ("baseline", "learned", "hybrid"):
            want = pool.sort_values([m, "doc_id"], ascending=[False, True])["doc_id"].tolist()
            assert pool.sort_values(f"{m}_rank")["doc_id"].tolist() == want
    assert np.allclose(rows["hybrid"], np.clip(0.35 * rows["baseline"] + 0.65 * rows["learned"], 0, 1), atol=1e-4)
    quality = {(r.method, r.held_out): r for r in learned.ml10(spark, SF).collect()}
    for (m, held), r in quality.items():
        pools = [p for _, p in rows[rows["held_out"] == held].groupby("query_id")]
        first = [p.loc[(p["relevance"] == 1) & (p[f"{m}_rank"] <= 10), f"{m}_rank"].min() for p in pools]
        assert r.queries == len(pools) and math.isclose(r.mrr, np.mean([0 if np.isnan(f) else 1 / f for f in first]), abs_tol=1e-6)
        gains = [(1 / np.log2(1 + p.loc[(p["relevance"] == 1) & (p[f"{m}_rank"] <= 10), f"{m}_rank"])).sum() / sum(1 / math.log2(1 + i) for i in range(1, min(10, p["relevance"].sum()) + 1)) for p in pools]
        assert math.isclose(r.ndcg, np.mean(gains), abs_tol=1e-6)
    assert all(quality["learned", h].ndcg >= quality["baseline", h].ndcg for h in (True, False) if ("learned", h) in quality)
    assert S.FEATURE_NAMES == learned.fitted_ranker(spark, SF).names


def test_features_of_a_batch_are_made_a_stretch_at_a_time(spark):
    import pyarrow as pa

    from evidrel.learning import vectors

    texts = ["a b", None, "x" * (vectors.STRETCH_BYTES + 5), "", *["words " * 1000] * 1000]
    parts = list(vectors.stretches(pa.array(texts, pa.string())))
    assert pa.concat_arrays(parts).to_pylist() == texts
    assert all(len(p) <= vectors.STRETCH_ROWS and (len(p) == 1 or sum(len(t or "") for t in p.to_pylist()) <= vectors.STRETCH_BYTES) for p in parts)
    assert list(vectors.stretches(pa.array([], pa.string()))) == [] and [len(p) for p in vectors.stretches(pa.array([[1.0]] * 300))] == [256, 44]

    def featurize(values):
        assert len(values) <= 256
        return [(np.array([len(v) % 4]), np.array([1.0])) for v in values]

    rows = spark.range(2000).selectExpr("id", "repeat('a', cast(id % 4 as int)) AS text", "id % 4 = 1 AS y").coalesce(1)
    model = linear.fit(rows, "id", "text", {"y": F.col("y")}, 4, featurize)
    got = linear.predict(rows, model, "text", featurize, exclusive=False, columns=["id"])
    assert got.columns == ["id", "probabilities"] and all((r.probabilities[0] > 0.5) == (r.id % 4 == 1) for r in got.collect())
