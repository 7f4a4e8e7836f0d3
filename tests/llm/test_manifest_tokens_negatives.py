"""Merkle manifest, byte-level BPE and hard negatives against plain Python, SQL and the library."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from evidrel.llm import bytebpe, merkle, queries, vafile
from tests.test_plans import SF, TABLES, canonical


@pytest.mark.parametrize("name", ["op11_merkle", "op13_hard_negatives"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert canonical(got) == canonical(want)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves):
    """Root and proofs of a list of digests."""
    if not leaves:
        return None, []
    proofs, level, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            proofs[k] += [x for j, x in enumerate(level) if j // 8 == i // 8 and j != i]
        level, at = [h(*level[j : j + 8]) for j in range(0, len(level), 8)], [i // 8 for i in at]
    return level[0], proofs


def plain_manifest(rows):
    groups = {}
    for r in rows:
        leaf = h(*map(field, r))
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    subroots, out = {}, []
    for g in names:
        groups[g].sort()
        subroots[g] = tree([x[2] for x in groups[g]])
    root, above = tree([subroots[g][0] for g in names])
    for k, g in enumerate(names):
        for (known, i, leaf), proof in zip(groups[g], subroots[g][1], strict=True):
            out.append((i if known else None, leaf, subroots[g][0], root, h(*proof, *above[k])))
    return sorted(out, key=str)


def manifest_rows():
    rows = [(i, f"s{i % 3}", "big", 7, "T" * (i % 11)) for i in range(-3, 137)]
    rows += [(i, None, "nine", None, "Abc é 的") for i in range(9)] + [(i, "x", "eight", 1, None) for i in range(8)]
    rows += [(1, "x", None, 1, ""), (2, "x", None, 1, ""), (5, "x", "", 1, "A" * 300_000), (None, "a", "eight", 2, "null id"), (None, "b", "eight", 2, "Null Id")]
    rows += [(3, "x", "eight", 1, None), (4, "other", "eight", 1, None)]  # a repeated row, a repeated id
    return rows + [(k, "x", f"l{k}", 1, "Alone") for k in range(12)]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def write_documents(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' AS g", "'clash' AS leaf", "1 AS idx").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("take", [slice(None), slice(0, 1), slice(0, 8), slice(0, 9), slice(0, 0)])
def test_manifest_is_the_plain_tree(spark, tmp_path, take):
    rows = manifest_rows()
    random.Random(3).shuffle(rows)
    rows = rows[take]
    out = queries.op11_merkle(spark, write_documents(spark, tmp_path, rows)).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in out), key=str) == plain_manifest(rows)
    bad = {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0}
    changed = {h(*map(field, r)) for r in rows if r[0] in bad and r[4] and r[4] != r[4].translate({c: c + 32 for c in range(65, 91)})}
    for r in out:
        assert r.verified == (r.folded_root == r.root) == (r.leaf not in changed)


def test_a_proof_convinces_of_its_leaf_only(spark):
    rows = spark.createDataFrame(manifest_rows(), SCHEMA)
    out = merkle.manifest(rows, merkle.leaf("doc_id", "text"), "lang", ["doc_id"], {"text": F.col("text")})
    other = F.when(F.col("text") == "", "x").otherwise("")
    got = out.select((merkle.fold(F.col("leaf"), F.col("proof")) == F.col("root")).alias("own"), (merkle.fold(merkle.leaf("doc_id", other), F.col("proof")) == F.col("root")).alias("other")).distinct().collect()
    assert [(r.own, r.other) for r in got] == [(True, False)]


@pytest.fixture(scope="module")
def model():
    return queries.byte_model()


@pytest.fixture(scope="module")
def library(model):
    ranks = {raw: i for i, raw in enumerate(model.tokens)}
    return tiktoken.Encoding("own", pat_str=model.pattern, mergeable_ranks=ranks, special_tokens={})


PARTS = ["a", "aa", "aaaa", " ", "  ", "'", "'re", "r", "0", "12", "\n", "\t", "ab", "é", "的", "th", "he", " the", "ing", " ", "\x1c", "😀", "é"]


def test_tokens_are_those_of_the_library(model, library):
    c, rng = bytebpe.codec(model), random.Random(5)
    ascii_tokens = [t.decode() for t in model.tokens if t and max(t) < 128]
    for k in range(4000):
        text = "".join(rng.choices(PARTS if k % 2 else ascii_tokens, k=rng.randint(0, 40)))
        assert c.encode(text).tolist() == library.encode_ordinary(text), text
    for cp in [*range(0x3100), *range(0xFF00, 0x10200), *range(0x1F300, 0x1F700), *range(0x3100, 0x110000, 97)]:
        if not 0xD800 <= cp < 0xE000:
            text = f"a{chr(cp)}b {chr(cp)}{chr(cp)} 1{chr(cp)}."
            assert c.encode(text).tolist() == library.encode_ordinary(text), hex(cp)


def test_prefixes_are_those_of_merging(model):
    ranks = {raw: i for i, raw in enumerate(model.tokens)}
    c, rng = bytebpe.Codec(model), random.Random(8)
    for _ in range(150):
        raw = "".join(rng.choices(PARTS, k=rng.randint(1, 12))).encode()
        last = c.prefixes(raw)
        for end in range(1, len(raw) + 1):
            assert c.spelled(last, end) == bytebpe.merged(raw[:end], ranks)[0]
            assert c.prefixes(raw, last[: end + 1]) == last  # appends go on from any prefix


def test_a_vocabulary_with_a_token_that_merging_never_makes():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"xbc": 259, b"zzz": 260}
    c = bytebpe.Codec(bytebpe.Model(ranks, r"\S+|\s+"))
    lib = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    for text in ["abc", "xbc", "abcabc", "zzz", "zzzz", "xabc", "bcbc zzz abc"]:
        assert c.encode(text).tolist() == lib.encode_ordinary(text)


def test_blocks_of_the_pattern_change_nothing(model, library, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(bytebpe, "BLOCK_CHARS", 7)
    c = bytebpe.Codec(model)
    for text in ["".join(rng.choices(PARTS, k=60)) for _ in range(300)] + ["a" * 500, " " * 300 + "x", "'" * 99 + "re"]:
        assert c.encode(text).tolist() == library.encode_ordinary(text)


def test_edits_and_appends_encode_only_what_is_near(spark, model, library):
    rng = random.Random(6)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(400)]
    rows = []
    for k, t in enumerate(texts):
        a = rng.randint(0, len(t))
        rows.append((k, t, a, rng.randint(a, len(t)), "".join(rng.choices(PARTS, k=rng.randint(0, 3)))))
    long = "some words of a long text " * 20_000
    rows += [(400, long, None, None, " and more"), (401, long, 250_000, 250_004, "x"), (402, None, None, None, "new"), (403, "gone", 0, 99, None), (404, "", -4, None, None)]
    docs = spark.createDataFrame(rows, "k int, text string, edit_from int, edit_to int, edit_text string")
    out = bytebpe.revise(bytebpe.prefix_states(docs, model), model).collect()
    assert len(out) == len(rows)
    for r in out:
        k, text, a, b, new = rows[r.k]
        text, new = text or "", new or ""
        a = len(text) if a is None else max(a, 0)
        want = text[:a] + new + text[a if b is None else b :]
        assert r.text == want and list(r.token_ids) == library.encode_ordinary(want)
        assert r.bytes_encoded < 40 or r.k < 400


def test_tokens_of_edge_texts_round_trip(spark, model):
    texts = ["", None, "plain", "plain", "x" * 400_000, "a\x00b\r\n\t", "é的😀", " \n" * 5000]
    docs = spark.createDataFrame([(k, t, "clash") for k, t in enumerate(texts)], "doc_id long, text string, token_ids string")
    ids = bytebpe.encode(docs, model)
    assert ids.columns == ["doc_id", "text", "token_ids"]
    for r in bytebpe.decode(ids, model).collect():
        assert bytes(r.decoded).decode() == (texts[r.doc_id] or "")
    assert bytebpe.encode(docs.limit(0), model).count() == 0
    odd = spark.createDataFrame([([5, -1, None, 10**6],), (None,), ([],)], "token_ids array<int>")
    assert {bytes(r.decoded) for r in bytebpe.decode(odd, model).collect()} == {model.tokens[5], b""}


def plain_negatives(rows, asks, positives, negatives, low, high):
    once = {}
    for i, label, v in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        once.setdefault(i, (label, np.array(v)))
    out = []
    for a in once:
        if asks(a):
            label, q = once[a]
            s = sorted((-float(v @ q), i) for i, (_, v) in once.items() if i != a and len(v) == len(q))
            for ps, p in [(-x, i) for x, i in s if once[i][0] == label][:positives]:
                hit = [(i, -x) for x, i in s if once[i][0] != label and low * ps <= -100 * x <= high * ps][:negatives]
                out += [(a, p, rank, i, ps, ns) for rank, (i, ns) in enumerate(hit, 1)]
    return sorted(out)


@pytest.mark.parametrize("dim,spread,options", [(8, 6, {}), (16, 40, {"part_rows": 60, "share_from": 0}), (8, 6, {"block_bytes": 300}), (3, 1, {"part_rows": 100})])
def test_hard_negatives_are_brute_force(spark, dim, spread, options):
    rng = np.random.default_rng(dim + spread)
    centres = rng.normal(0, spread, (12, dim))
    rows = [(i, int(rng.integers(0, 4)), np.floor(centres[i % 12] + rng.normal(0, spread / 2, dim)).tolist()) for i in range(-50, 400)]
    rows += [(7, 2, [1.0] * dim), (20, 0, [0.0] * dim), (401, 1, [1e6] * dim), (402, 3, [5.0] * dim), (403, 3, [5.0] * dim), (500, 1, [2.0] * 3), (505, 1, [3.0] * 2), (510, 2, [3.0] * 2)]
    v = spark.createDataFrame(rows, "vec_id long, label int, v array<double>").repartition(5)
    out = vafile.hard_negatives(v, F.col("vec_id") % 5 == 0, 3, 4, 30, 90, **options)
    got = sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in out.collect())
    assert got == plain_negatives(rows, lambda i: i % 5 == 0, 3, 4, 30, 90) and got
    assert vafile.hard_negatives(v.limit(0), F.col("vec_id") % 5 == 0, 3, 4, 30, 90).count() == 0


def test_bounds_hold_and_few_rows_are_scored():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1, keepdims=True))
    shape = vafile.Approximation(list(x[:500]), x.min(axis=0), x.max(axis=0))
    rows = vafile.Rows(np.arange(4000), np.arange(4000) % 10, np.ascontiguousarray(shape.cells(x).T), x)
    scored = 0
    for q in x[:20]:
        lo, up = shape.bounds(q, rows.cells)
        assert (lo <= x @ q).all() and (x @ q <= up).all()
        ask = vafile.Ask(-1, 3, q, False, [0, 1], [(3000.0, 9000.0), (8000.0, 20000.0)], 10, [float("-inf")] * 2)
        scored += ask.look(shape, rows)
    assert scored < 0.2 * 20 * 4000  # of 0.9 * 20 * 4000 that are asked about


def test_null_labels_and_vectors_take_no_part(spark, tmp_path):
    rows = [(100, 1, [0.5, 0.5]), (1, 1, [0.6, 0.4]), (2, 2, [0.25, 0.25]), (3, None, [0.25, 0.25]), (4, 2, None), (5, 2, [0.25, None]), (6, 2, [float("nan"), 0.2]), (7, 0, [0.9, 0.9]), (8, 2, [float("inf"), 0.2]), (None, 2, [0.25, 0.25]), (9, 2, [])]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("v", F.lit("clash")).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op13_hard_negatives(spark, str(tmp_path)).collect()
    # row 7's label becomes 1, so it is the best positive; row 2 is below its window and inside that of row 1
    assert [(r.anchor_id, r.positive_id, r["rank"], r.negative_id) for r in sorted(got)] == [(100, 1, 1, 2)]
