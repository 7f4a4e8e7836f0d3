"""Similarity join, components, searches and the pipeline against brute force and edge cases."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from evidrel.llm import ann, graph, jaccard, topk
from evidrel.llm.shards import usable


def grams(text, n):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if x]
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n, percent):
    sets = {i: grams(t, n) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = sorted((find(ids[x]), find(ids[y])))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows(seed, families=8, copies=7, alone=25):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{k}" for k in range(40)]
    passage = rng.choices(vocabulary, k=30)
    for f in range(families):
        base = rng.choices(vocabulary, k=rng.randint(20, 140))
        for _ in range(copies):
            c = list(base)
            for _ in range(rng.randint(0, 3)):
                c[rng.randrange(len(c))] = rng.choice(vocabulary)
            rows.append(" ".join(c).upper() if rng.random() < 0.2 else " \t".join(c))
    for _ in range(alone):
        rows.append(" ".join(rng.choices(vocabulary, k=rng.randint(1, 60)) + passage * (rng.random() < 0.6)))
    rows += ["one", "one", "One two", "one two", "", None, " \n ", "x y z " * 3000, "x y z " * 3000]
    rng.shuffle(rows)
    return [(i * 3, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("n,percent,hot", [(3, 90, None), (5, 80, 1), (3, 90, 0)])
def test_join_is_brute_force(spark, monkeypatch, n, percent, hot):
    if hot is not None:  # the sketch only steers cost: hot tokens and longer prefixes change no result
        monkeypatch.setattr(jaccard, "HOT", hot)
        monkeypatch.setattr(jaccard, "COSTLY", (3, 10))
        monkeypatch.setattr(jaccard, "adapted", _adapted(hot, (3, 10)))
    rows = near_rows(n + percent)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as n", "'t' as token")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_classes(docs, n=n, percent=percent).collect()}
    assert got == brute_components(rows, n, percent)


def _adapted(hot, costly):
    """The function with other constants, for workers that import the module anew."""
    was = jaccard.adapted

    def adapted(s, excess, percent, bound=None, sd=0.0):
        from evidrel.llm import jaccard as j

        j.HOT, j.COSTLY = hot, costly
        return was(s, excess, percent)

    return adapted


def test_join_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join_classes(none).count() == 0
    rows = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None)], "doc_id long, text string")
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_classes(rows).collect()} == {(1, 1, 1), (2, 0, 2)}


def test_sets_of_exact_hashes():
    texts = ["A b  c d", "a B\tc\x0bd", "a b c", "b", "", "é é é é"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    sets = jaccard.shingle_sets(data, offsets, 3)
    assert [len(s) for s in sets] == [len(grams(t, 3)) for t in texts]
    assert set(sets[0]) == set(sets[1]) and set(sets[2]) < set(sets[0])


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 1), (20, 21), (30, 30), (None, 4)] + [(100, 100 + k) for k in range(1, 60)] + [(k, k + 1) for k in range(200, 260)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 1 for k in (1, 2, 3, 7, 8, 9)} | {20: 20, 21: 20} | {k: 100 for k in range(100, 160)} | {k: 200 for k in range(200, 261)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(seed=1, n=900, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[: n // 3] = x[0] + rng.normal(scale=0.02, size=(n // 3, d))
    x[n // 3 : n // 2] = x[n // 3]
    return x


def brute_top(ids, x, k, asks):
    out = {}
    for i in np.flatnonzero(asks(ids)):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def test_exact_search_is_brute_force(spark):
    x = np.floor(vectors() * 8)
    ids = np.random.default_rng(0).permutation(len(x)) * 2
    df = spark.createDataFrame([(int(i), v.tolist(), 1) for i, v in zip(ids, x, strict=True)], "vec_id long, v array<double>, shard int").drop("shard")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 7, shard_rows=100, block_rows=20).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    got = {q: [v[1:] for v in sorted(rows)] for q, rows in got.items()}
    assert got == brute_top(ids, x, 7, lambda i: i % 20 == 0)


def test_tree_bounds_hold():
    x, q = vectors(3), vectors(4)[:20]
    tree = topk.Tree(x, leaf=16)
    bound = tree.bounds(q)
    for node, (a, b) in enumerate(tree.span):
        assert (x[tree.order[a:b]] @ q.T <= bound[:, node] + 1e-9).all()
    assert sorted(tree.order) == list(range(len(x)))


def test_recall_and_scores_of_the_approximate_search(spark):
    x = vectors(5, 1500, 24)
    x /= np.linalg.norm(x, axis=1)[:, None]
    ids = np.arange(len(x)) * 5
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, v array<double>")
    want, got = brute_top(ids, x, 10, lambda i: i % 20 == 0), {}
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 10).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = (r.rank, r.score)
    assert got.keys() == want.keys()
    assert np.mean([len(got[q].keys() & {i for i, _ in w}) / len(w) for q, w in want.items()]) >= 0.9
    for q, rows in got.items():
        assert sorted(r for r, _ in rows.values()) == list(range(1, 11))
        for i, (_, s) in rows.items():
            assert abs(s - x[i // 5] @ x[q // 5]) < 1e-9


def test_search_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [None, 1.0]), (4, [float("inf"), 0.0]), (5, [0.0, 0.0]), (20, [1.0, 2.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1))
    v = usable(df, "vec_id", "embedding", zero=True)
    assert {r.vec_id for r in v.collect()} == {0, 5, 7, 20}
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(v, F.col("vec_id") % 20 == 0, 20).collect()}
    assert got == {(0, 1, 20, 5.0), (0, 2, 5, 0.0), (20, 1, 0, 5.0), (20, 2, 5, 0.0)}
    some = usable(df, "vec_id", "embedding", zero=False)
    assert {r.vec_id for r in some.collect()} == {0, 7, 20}
    assert {(r.query_id, r.vec_id) for r in ann.nearest(some, F.col("vec_id") % 20 == 0, 20).collect()} == {(0, 20), (20, 0)}
    assert topk.top_k(v.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0
    assert ann.nearest(v.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0


def test_pipeline_stages_decide(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "", "en", "s", 0), (9003, "123 456", "en", "s", 7), (None, "the thing of the thing", "en", "s", 22)], docs.schema)
    columns, sizes = docs.columns, []
    docs = docs.unionByName(extra)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        sizes.append((name, docs.count(), out.count()))
        assert out.columns[: len(columns)] == columns
        if name == "language":
            assert not {9001, 9002, 9003} & {r.doc_id for r in out.select("doc_id").collect()}
        if name == "near_duplicates":
            want = brute_components([(r.doc_id, r.text) for r in docs.where("doc_id is not null").collect()], 5, 80)
            assert {r.doc_id for r in out.where("doc_id is not null").collect()} == {i for i, (_, c) in want.items() if i == c}
        docs = corpus_pipeline.written(out, f"test-{name}")
    assert "piece_ids" in docs.columns and docs.where("size(piece_ids) > 0").count() > 0
    assert [n for n, _, _ in sizes] == ["language", "line_dedup", "near_duplicates", "mixture", "encode"]


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def repeated_vectors(spark, kinds):
    """Every id twice: once with its own vector, once with one that is larger in the first component."""
    x = vectors(6, 400, 16) if kinds == "real" else np.floor(vectors(6, 400, 16) * 8)
    rows = [(int(i) * 4, v.tolist()) for i, v in enumerate(x)]
    rows += [(i, [v[0] + 1, *v[1:]]) for i, v in rows] + rows[:50]
    return x, spark.createDataFrame(rows, "vec_id long, v array<double>")


def test_repeated_ids_ask_once_and_are_found_once(spark):
    x, df = repeated_vectors(spark, "whole")
    want, got = brute_top(np.arange(len(x)) * 4, x, 7, lambda i: i % 20 == 0), {}
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 7, shard_rows=60, block_rows=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert {q: [v[1:] for v in sorted(rows)] for q, rows in got.items()} == want
    x, df = repeated_vectors(spark, "real")
    rows = ann.nearest(df, F.col("vec_id") % 20 == 0, 7, shard_rows=150).collect()
    assert len(rows) == len({(r.query_id, r.vec_id) for r in rows}) == len({(r.query_id, r.rank) for r in rows}) == 7 * 80
    assert all(abs(r.score - x[r.vec_id // 4] @ x[r.query_id // 4]) < 1e-9 for r in rows)


def test_queries_go_only_to_shards_that_can_answer(spark):
    """Tight clusters far apart: what is searched beyond a query's own shard stays linear."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(16, 8)) * 100
    x = np.vstack([c + rng.normal(scale=0.5, size=(100, 8)) for c in centres])
    lo, hi = x.reshape(16, 100, 8).min(axis=1), x.reshape(16, 100, 8).max(axis=1)
    q = x[::100]
    kth = np.array([np.sort(x[100 * i : 100 * i + 100] @ v)[-6] for i, v in enumerate(q)])
    open_to = topk.box_bounds(q, lo, hi) >= kth[:, None]
    assert all(open_to[i, i] for i in range(16)) and open_to.sum() <= 64
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    at = ann.projected(unit, 1.0).reshape(16, 100, -1)
    kth = np.array([np.sort(unit[100 * i : 100 * i + 100] @ v)[-6] for i, v in enumerate(unit[::100])])
    open_to = ann.reaches(unit[::100], kth, at.min(axis=1), at.max(axis=1), 1.0)
    assert all(open_to[i, i] for i in range(16)) and open_to.sum() <= 64


def test_prefix_matches_cut_candidates_before_sets_are_made(spark, monkeypatch):
    """Pairs that share fewer prefix tokens than they must show go, and no link with them."""
    monkeypatch.setattr(jaccard, "COSTLY", (3, 10))
    monkeypatch.setattr(jaccard, "adapted", _adapted(10**6, (3, 10)))
    rows = near_rows(11, alone=120)
    docs = spark.createDataFrame([(i, t) for i, t in rows if t], "doc_id long, text string")
    counts = jaccard.token_counts(docs, 3)
    made = jaccard.sketches(docs, counts, 3, 50).where("n > 0").cache()
    ids = [r.doc_id for r in made.collect()]
    pairs = spark.createDataFrame([(a, b) for a in ids for b in ids if a < b], "a long, b long")
    near = {(r.a, r.b) for r in jaccard.near_pairs(pairs, made, 50).collect()}
    without = {(r.a, r.b) for r in jaccard.near_pairs(pairs, made.withColumns({"m": F.lit(0), "boiler": F.lit(False)}), 50).collect()}
    sets = {i: grams(t, 3) for i, t in rows}
    linked = {(a, b) for a in ids for b in ids if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    assert linked <= near
    assert len(near) < len(without)


def test_chance_makes_no_token_hot_in_a_large_corpus():
    """With a mean counter of 5000 and more, as 35 GB and more give, boilerplate and dear prefixes stay rare."""
    rng = np.random.default_rng(1)
    for mean in (5000, 14_000_000):
        counts = rng.poisson(mean, jaccard.BUCKETS).astype(np.int64)
        counts[:50] += 12 * int(np.sqrt(mean))  # tokens that are truly frequent
        excess, (bound, sd) = jaccard._excess(counts), jaccard.noise(counts)
        made = [jaccard.adapted(np.unique(rng.integers(0, 1 << 64, 400, dtype=np.uint64)), excess, 90, bound, sd) for _ in range(400)]
        assert np.mean([boiler for _, _, boiler, _, _ in made]) < 0.01 and np.mean([m > 1 for _, m, _, _, _ in made]) < 0.05
        assert (excess[:50] > bound).mean() > 0.95
