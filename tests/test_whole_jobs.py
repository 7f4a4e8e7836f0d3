"""Queries do the whole job: results against brute force where the head of a text or a part of the rows would not do."""

import math
from collections import Counter

import numpy as np

from evidrel import plans


def tables(spark, folder, **rows):
    """Small tables as the queries read them."""
    for name, (values, schema) in rows.items():
        spark.createDataFrame(values, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def documents(texts, first=0):
    return [(first + i, t, "en", f"src{i % 20}", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long"


def cosines(queries, texts):
    """{(query, doc): cosine} of word-bound 2- to 4-grams of title, summary and body, pair by pair."""

    def grams(text):
        padded = [f" {w} " for w in text.lower().split()]
        return Counter(p[i : i + n] for p in padded for n in (2, 3, 4) for i in range(len(p) - n + 1))

    docs = {d: grams(" ".join([t.split("\n")[0], t[:300], t])) for d, t in texts.items()}
    df = Counter(g for c in docs.values() for g in c)
    idf = {g: math.log((1 + len(docs)) / (1 + n)) + 1 for g, n in df.items()}

    def unit(c):
        w = {g: n * idf[g] for g, n in c.items() if g in idf}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {g: x / norm for g, x in w.items()}

    docs = {d: unit(c) for d, c in docs.items()}
    return {(q, d): sum(x * w.get(g, 0.0) for g, x in unit(grams(t)).items()) for q, t in queries.items() for d, w in docs.items()}


FILL = "plain words that every one of these pages has in it\n" * 8
SEARCHED = [FILL + f"page {i} tells of {w}, 😀 a" for i, w in enumerate(["tidal turbines", "sourdough bread", "alpine marmots", "copper etching", "river deltas"])] * 5
ASKED = ["please tell me what the pages that I may read here have to say, of all things, on tidal turbines", "sourdough bread", "zzqqxx", "alpine marmots a"]


def test_retrieval_reads_whole_texts(spark, tmp_path):
    sf = tables(spark, tmp_path, documents=documents(SEARCHED), benchmark=(list(enumerate(ASKED)), "item_id long, text string"))
    want = cosines(dict(enumerate(ASKED)), dict(enumerate(SEARCHED)))
    got = {(r.query_id, r.doc_id): r.score for r in plans.QUERIES["ir1_ir3_cosine"](spark, sf).collect()}
    assert got.keys() == {k for k, v in want.items() if v >= 0.3} and all(abs(v - want[k]) < 1e-4 for k, v in got.items())
    hits = plans.QUERIES["ir4_t1_top_hits"](spark, sf).collect()
    for q in range(len(ASKED)):
        ranked = sorted((-round(v, 4), d) for (k, d), v in want.items() if k == q and round(v, 4) >= 0.02)[:10]
        assert [r.doc_id for r in sorted(hits, key=lambda r: r.position) if r.query_id == q] == [d for _, d in ranked]
    assert {r.doc_id % 5 for r in hits if r.query_id == 0 and r.position <= 5} == {0}


def test_pairs_are_the_hits_of_the_retrieval(spark, tmp_path):
    sf = tables(spark, tmp_path, documents=documents(SEARCHED, 3), benchmark=(list(enumerate(ASKED)), "item_id long, text string"))
    want = {k: round(v, 4) for k, v in cosines(dict(enumerate(ASKED)), dict(enumerate(SEARCHED, 3))).items() if v > 0}
    least = [0.02, 0.02, 0.05, 0.05, 0.05]
    got = {(r.query_id, r.doc_id) for r in plans.QUERIES["pf7_least_score"](spark, sf).collect()}
    assert got == {(q, d) for (q, d), v in want.items() if v >= least[(d - 3) % 20 % 5]}
    got = {(r.query_id, r.doc_id) for r in plans.QUERIES["f9_term_bonus"](spark, sf).collect()}
    assert got == want.keys() and {d for q, d in got if q == 0} == set(range(3, 28))
    assert all(r.risk for r in plans.QUERIES["a1_coverage"](spark, sf).collect())


def test_documents_come_before_structured_items_at_any_id(spark, tmp_path):
    rows = [(7, *documents(["alike"])[0][0][1:]), (2_000_000, *documents(["alike too"])[0][0][1:])]
    sf = tables(spark, tmp_path, documents=(rows, documents([])[1]), benchmark=([(1, "alike")], "item_id long, text string"))
    assert [r.executed for r in plans.QUERIES["a5_executed_sources"](spark, sf).collect()] == ["news,market_api"]


def test_near_duplicate_groups_are_greedy(spark):
    """Against pairwise cosines and the greedy walk, in plain Python."""
    from evidrel.operators import retrieval as R

    base = "shares of the brewer fell after a weak report and analysts cut their targets"
    rows = []
    for q in (1, 2):
        texts = [base, base + " today", "an unrelated note on tides", base.upper(), "", None, "an unrelated note on tides!", base + " again now", "other words", "yet more words", "words once more"]
        rows += [(q, i + 1, f"e{q}-{i}", ["news", "faq"][(i * q) % 3 == 0], t, "") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "query_id long, position int, evidence_id string, source_type string, title string, summary string")
    got = {(r.query_id, r.evidence_id): (r.group_type, list(r.members)) for r in R.near_duplicate_groups(df).collect()}

    def vectors(texts):
        counts = [Counter(p[i : i + n] for w in (t or "").lower().split() for p in [f" {w} "] for n in (2, 3, 4) for i in range(len(p) - n + 1)) for t in texts]
        df = Counter(g for c in counts for g in c)
        out = []
        for c in counts:
            w = {g: n * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in c.items()}
            norm = math.sqrt(sum(x * x for x in w.values())) or 1
            out.append({g: x / norm for g, x in w.items()})
        return out

    want = {}
    for q in (1, 2):
        mine = [r for r in rows if r[0] == q]
        v, gone, kept = vectors([r[4] for r in mine]), set(), Counter()
        for i, r in enumerate(mine):
            if i in gone or kept[r[3]] >= 3:
                continue
            kept[r[3]] += 1
            like = [j for j in range(i + 1, len(mine)) if j not in gone and sum(x * v[j].get(g, 0) for g, x in v[i].items()) >= 0.85]
            gone |= set(like)
            want[q, r[2]] = ("news_cluster" if like else "single", [r[2], *[mine[j][2] for j in like]])
    assert got == want


def test_places_do_not_depend_on_the_stretches(spark):
    from evidrel.operators import tables as T

    ids = [(i * 37) % 5003 * 3 for i in range(1, 700)]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    want = {i: n for n, i in enumerate(sorted(ids))}
    assert {r.doc_id: r.place for r in T.numbered(df, "doc_id", stretch=50).collect()} == want
    assert {r.doc_id: r.place for r in T.numbered(df, "doc_id").collect()} == want
    assert T.numbered(df.limit(0), "doc_id").count() == 0
    after = {r.doc_id: r.following for r in T.adjacent(df, "doc_id", "text").collect()}
    assert after == {a: None if b is None else f"t{b}" for a, b in zip(sorted(ids), [*sorted(ids)[1:], None])}


def test_norms_by_join_are_the_same(spark, tmp_path, monkeypatch):
    from evidrel.operators import retrieval as R
    from evidrel.plans import evidence as E

    sf = tables(spark, tmp_path, documents=documents(SEARCHED, 3), benchmark=(list(enumerate(ASKED)), "item_id long, text string"))
    rows = lambda: {(r.query_id, r.doc_id, round(r.cosine, 9)) for r in plans.search.cosines(spark, sf).collect()}
    found = lambda: {tuple(r) for r in E.candidates(spark, sf).collect()}
    want, hits = rows(), found()
    monkeypatch.setattr(R, "MOST_GRAMS", 10)
    assert rows() == want and found() == hits
    monkeypatch.setattr(R, "MOST_QUERIES", 2)
    assert rows() == want and found() == hits


def test_terms_are_found_through_grams_as_by_search():
    from evidrel.operators import retrieval as R

    terms = ["of", "Tidal", "idal tur", "abcdabcd", "İx", "ß", "aß", "a", "😀x", "bcdab", "-1.", "ZZ", "tidal", "nowhere"]
    texts = ["", "  \n", "A Tidal turbine of İx", "abcdab bcdabcd", "xabcdabcdx", "tidal\tturbine", "idal turbine -1.5 maß 😀xy", "zz ZZz O F of", "TIDAL " * 50]
    requests = [{"industry_terms": [terms[i], None], "keywords": [terms[i - 1], terms[i - 1]], "entity_names": None, "symbols": [], "source_plan": None, "product_type": "fund", "intent_labels": [], "topic_labels": []} for i in range(len(terms))]
    keyed = R.keyed_texts([" " + " ".join(t.lower().split()) + " " if t.split() else None for t in texts])
    table = R.Terms(requests)
    held = table.held(keyed, texts)
    assert {(i, t) for i in range(len(texts)) for t in table.terms if held[i, table.place[t]]} == {(i, t) for i, x in enumerate(texts) for t in terms if len(t) >= 2 and t in x}
    got = R.Rules(requests, table).bonus(held)
    for j, r in enumerate(requests):
        for i, x in enumerate(texts):
            n = sum(t is not None and len(t) >= 2 and t in x for t in [*r["industry_terms"], *r["keywords"]])
            assert got[i, j] == min(0.06 * n, 0.18)
    assert R.Rules([{**requests[0], "industry_terms": [], "keywords": None}], R.Terms([])).bonus(np.zeros((2, 0), bool)).tolist() == [[0.0], [0.0]]


def test_blocks_of_documents_are_bounded():
    import pyarrow as pa

    from evidrel.operators import retrieval as R

    texts = [None, "x" * (R.BLOCK_BYTES + 1), "", *["words " * 20_000] * 60, *["a"] * 300]
    batch = pa.record_batch({"doc": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    parts = list(R.blocks_of(iter([batch, batch.slice(0, 0), batch])))
    assert [d for p in parts for d in p.column("doc").to_pylist()] == 2 * list(range(len(texts)))
    assert all(p.num_rows <= R.DOCUMENT_BLOCK and (p.num_rows == 1 or sum(len(t or "") for t in p.column("text").to_pylist()) <= R.BLOCK_BYTES) for p in parts)


def test_long_requests_make_no_large_tables():
    """Cosines of 64 requests that hold 300 000 grams, as by a walk over each request's own."""
    import tracemalloc

    from evidrel.operators import retrieval as R

    rng = np.random.default_rng(3)
    own = np.unique(rng.integers(0, 1 << 62, 300_000))
    mine = [np.sort(rng.choice(len(own), 2000, replace=False)) for _ in range(64)]
    weight = [rng.random(2000) for _ in mine]
    g, q, w = np.concatenate(mine), np.repeat(np.arange(64), 2000), np.concatenate(weight)
    order = np.lexsort((q, g))
    asked = R.Asked(own, 1 + rng.random(len(own)), 3.0, [(own, (g[order].astype(np.int32), q[order].astype(np.int32), w[order]), list(range(64)))])
    strange = np.setdiff1d(rng.integers(0, 1 << 62, 500), own)
    keyed = [None if i % 9 == 4 else (np.union1d(rng.choice(own, 3000, replace=False), strange), rng.integers(1, 4, 3000 + len(strange))) for i in range(64)]
    tracemalloc.start()
    ((at, got),) = R.block_cosines(asked, keyed, np.full(64, np.nan))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert at == list(range(64)) and peak < 100 << 20
    for i, made in enumerate(keyed):
        if made is None:
            assert not got[i].any()
            continue
        idf = dict(zip(own.tolist(), asked.idf.tolist()))
        doc = {k: n * idf.get(k, 3.0) for k, n in zip(made[0].tolist(), made[1].tolist())}
        norm = sum(x * x for x in doc.values()) ** 0.5
        for j in range(0, 64, 7):
            want = sum(x * doc.get(k, 0.0) for k, x in zip(own[mine[j]].tolist(), weight[j].tolist())) / norm
            assert abs(got[i, j] - want) < 1e-9


def test_long_requests_are_sent_in_groups(spark, tmp_path, monkeypatch):
    from evidrel.operators import retrieval as R
    from evidrel.plans import evidence as E

    sf = tables(spark, tmp_path, documents=documents(SEARCHED, 3), benchmark=(list(enumerate(ASKED)), "item_id long, text string"))
    rows = lambda: {(r.query_id, r.doc_id, round(r.cosine, 9)) for r in plans.search.cosines(spark, sf).collect()}
    found = lambda: {tuple(r) for r in E.candidates(spark, sf).collect()}
    want, hits = rows(), found()
    long = spark.createDataFrame([(i, "word " * 600_000) for i in range(8)], "query long, text string")
    parts = [sorted(r.query for r in p.select("query").collect()) for p in R.query_groups(long)]
    assert len(parts) > 1 and sorted(sum(parts, [])) == list(range(8))
    monkeypatch.setattr(R, "MOST_ASKED", 30)
    monkeypatch.setattr(R, "TABLE_CELLS", 50)
    assert rows() == want and found() == hits


def test_bonuses_are_those_of_the_sql_without_joins(spark, tmp_path):
    """Odd requests and documents: repeated ids, terms with white space at an end, words that no request holds, no words."""
    import duckdb

    asked = [(1, "a\n bc it 😀x Bc dd ee"), (2, "qq"), (2, "tidal of On the land"), (3, "É éa maß ÉA éa ß É"), (4, ""), (5, None), (6, "  x  "), (7, "x\ty zz ZZ x\ty it zz It")]
    texts = ["qq", "a\nb", "Of tidal land\nbc 😀xy it", "éa maß", "ZZ x\ty", "", None, "\n ", "vvv", "It " * 300 + "x\ty", "land a\n x", "qq of the tidal"]
    docs = [(i, t, "en", f"src{i % 20}", len(t or "")) for i, t in enumerate(texts)]
    sf = tables(spark, tmp_path, documents=(docs, documents([])[1]), benchmark=(asked, "item_id long, text string"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet/*.parquet'")
    made = plans.QUERIES["f9_term_bonus"](spark, sf)
    rows = lambda found: Counter((q, d, round(b, 9)) for q, d, b in found)
    want = rows(con.sql(plans.ORACLE["f9_term_bonus"]).fetchall())
    assert len({b for *_, b in want}) > 2 and sum(n for (q, d, _), n in want.items() if (q, d) == (2, 11)) == 2
    assert rows(made.collect()) == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Scan parquet") == 1


def test_shared_grams_are_those_of_the_sets(monkeypatch):
    from evidrel.operators import retrieval as R

    rng = np.random.default_rng(9)
    grams = [np.unique(rng.integers(0, 60, n)) for n in (30, 12, 3, 1, 0, 25, 2)]
    keyed = [None if n is None else (np.unique(rng.integers(0, 70, n)), None) for n in (1, 0, None, 2, 5, 40, 3, 8)]
    for first in (64, 2):
        monkeypatch.setattr(R, "FIRST_GRAMS", first)
        got = R.Sharing(grams).shared(keyed)
        assert got.tolist() == [[k is not None and bool(np.isin(k[0], g).any()) for g in grams] for k in keyed]
    assert R.Sharing([]).shared(keyed).shape == (len(keyed), 0)
