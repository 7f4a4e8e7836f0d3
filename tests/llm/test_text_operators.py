"""Language, toxicity, lines, pieces, personal data and pages against brute force and edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as model_pb

from evidrel.llm import langid, linededup, mixing, pieces, pii, toxicity, webpage
from evidrel.llm.queries import PIECE_MODEL

EDGE = [(1, None), (2, ""), (3, "12 34 !"), (4, "word " * 40_000), (5, "same text here"), (6, "same text here"), (None, "no id"), (8, "\x00é▁😀\n\n  x ")]


def edge(spark, extra=""):
    rows = spark.createDataFrame(EDGE, "doc_id long, text string")
    return rows.selectExpr("doc_id", "text", *([extra] if extra else []))


def language_rows(n=60):
    rng, out = random.Random(5), []
    for i in range(n):
        for k, (lang, syllables) in enumerate({"aa": ["the", "ing", "th", "wh"], "bb": ["que", "ción", "los", "ñ"]}.items()):
            out.append((2 * i + k, " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(5, 200))), lang))
    return out


def test_language_is_learned_and_edges_are_defined(spark):
    rows = language_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id % 5 != 0"))
    got = {r.doc_id: r for r in langid.identify(docs.withColumn("Score", docs.doc_id), model).collect()}
    held = [r for r in rows if r[0] % 5 == 0]
    assert sum(got[i].lang_pred == lang for i, _, lang in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    odd = langid.identify(edge(spark), model).collect()
    assert len(odd) == len(EDGE)
    assert {r.lang_pred for r in odd if r.doc_id in (1, 2, 3)} == {"und"}
    assert len({(r.lang_pred, r.score) for r in odd if r.doc_id in (5, 6)}) == 1
    assert langid.identify(docs.limit(0), model).count() == 0
    assert langid.fit(docs.limit(0)) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


def test_windows_cover_every_byte():
    data = np.frombuffer(bytes(range(1, 251)) * 5, np.uint8)
    offsets = np.array([0, 0, 3, 1250])
    x, doc, used = langid.windows(data, offsets, 64)
    for d in range(3):
        assert b"".join(x[i, : used[i]].tobytes() for i in np.flatnonzero(doc == d)) == data[offsets[d] : offsets[d + 1]].tobytes()


def test_toxicity_finds_planted_words_and_roots(spark):
    rng, rows = random.Random(7), []
    for i in range(500):
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(rng.randint(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["zorgus", "zorguna", "zorguti"]))
            words.append(rng.choice(["vexmo", "vexmi"]))
        rows.append((i, " ".join(words), "aa", int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text", "lang"), docs.where("doc_id % 3 != 1").select("doc_id", "toxic"))
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [r for r in rows if r[0] % 3 == 1]
    assert sum(got[i].predicted == y for i, *_, y in held) >= 0.95 * len(held)
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    odd = toxicity.score(edge(spark, "1 as score"), model).collect()
    assert len(odd) == len(EDGE) and len({r.score for r in odd if r.doc_id in (1, 2)}) == 1
    assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.fit(docs.select("doc_id", "text", "lang"), docs.where("toxic = 0").select("doc_id", "toxic")) is None


def test_toxicity_learns_from_all_labels_in_shards(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SHARD_DOCS", 150)
    rng, rows, seen = random.Random(8), [], {}
    for i in range(600):
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(rng.randint(5, 40))]
        toxic = i % 3 == 0
        rows.append((i, " ".join(words + ["zorgus", "vexmo"] if toxic else words), "aa" if i % 2 else "bb", int(toxic)))
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string, toxic int")
    counts, bins = toxicity.language_counts, toxicity.logit_bins
    monkeypatch.setattr(toxicity, "language_counts", lambda t, n: seen.setdefault("words", counts(t, n)))
    monkeypatch.setattr(toxicity, "logit_bins", lambda t, *m: seen.setdefault("bins", (t.select("shard").distinct().count(), bins(t, *m)))[1])
    model = toxicity.fit(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    shards, table = seen["bins"]
    assert shards == 4 and table["n"].sum() == 600 and table["pos"].sum() == 200  # each document once, none left out
    assert seen["words"].sum(axis=0).tolist() == [sum(len(t.split()) for _, t, lang, _ in rows if lang == x) for x in ("aa", "bb")]
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, model).collect()}
    assert sum(got[i] == y for i, *_, y in rows) >= 0.95 * len(rows)


def brute_lines(rows, min_chars=40, min_docs=5):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                held.setdefault(k, []).append(i)
    gone = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if gone.get(key(x), i) == i]
        out[i] = (len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    return out


def test_line_dedup_is_brute_force(spark):
    rng = random.Random(3)
    pool = [f"Line {k} " + "é" * rng.randint(20, 60) for k in range(12)] + ["short", ""]
    rows = [(i, "\n".join(rng.choice([x, x.upper(), f" \t{x} "]) for x in rng.choices(pool, k=rng.randint(1, 9)))) for i in range(80)] + [(90, None), (91, ""), (92, "x" * 50 + "\n" + "x" * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_lines", "'k' as key")
    for batches, fanout in ((1, 2), (5, 2)):
        got = linededup.drop_repeated_lines(docs, batches=batches, fanout=fanout).collect()
        assert {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got} == brute_lines(rows)
    assert linededup.drop_repeated_lines(docs.limit(0)).count() == 0
    assert linededup.drop_repeated_lines(edge(spark)).count() == len(EDGE)


def test_runs_are_compacted_and_counts_add_up(spark):
    runs = linededup.LineRuns(spark, fanout=2)
    for b in range(4):
        runs.add(spark.createDataFrame([(10 * b + k, k, 0) for k in range(3)], "doc_id long, h1 long, h2 long"))
    assert sum(map(len, runs.levels)) == 1
    assert {(r.h1, r.n_docs, r.keeper) for r in runs.compacted().collect()} == {(k, 4, 30 + k) for k in range(3)}


@pytest.fixture(scope="module")
def unigram():
    """The given pieces with a unigram type; scores of -1e9, which single precision cannot add to, become -40000."""
    m = model_pb.ModelProto()
    m.ParseFromString(pieces.read_model(PIECE_MODEL))
    m.trainer_spec.model_type = 1
    for p in m.pieces:
        p.score = max(p.score, -40000.0)
    return m.SerializeToString()


def test_pieces_are_those_of_the_library(unigram):
    sp, codec, rng = sentencepiece.SentencePieceProcessor(model_proto=unigram), pieces.Codec(unigram), random.Random(1)
    words = ["the", "and", "thing", "Ünïque", "naïve", "x1", "  ", "ción", "über", "a", ".", ",", "12", "日本", "ﬁ"]
    for _ in range(400):
        t = " ".join(rng.choices(words, k=rng.randint(0, 9)))
        assert np.frombuffer(codec.encode(t), np.int32).tolist() == sp.encode(t), t


def test_viterbi_is_the_best_segmentation(unigram):
    codec = pieces.Codec(unigram)
    score = {p: s for p, (_, s, _) in ((p, codec.automaton.get(p)) for p in codec.automaton.keys())}
    for text in ["▁thethe", "▁onthing", "▁and", "▁😀a", "qqq"]:
        best = [0.0] + [-1e18] * len(text)
        for e in range(1, len(text) + 1):
            for b in range(e):
                s = score.get(text[b:e], codec.unknown if e - b == 1 else None)
                if s is not None:
                    best[e] = max(best[e], best[b] + s)
        ids = codec.viterbi(text)
        total = sum(score[p] for p in (codec.unit[i].decode("utf-8", "ignore").replace(" ", "▁") for i in ids) if p in score)
        assert total == best[-1] or codec.unknown in (best[-1] - total, (best[-1] - total) / 2)


def test_pieces_round_trip(spark):
    model = pieces.read_model(PIECE_MODEL)
    ids = pieces.encode(edge(spark, "0 as piece_ids"), model)
    got = pieces.decode(ids, model).collect()
    assert len(got) == len(EDGE)
    assert all(r.decoded == (r.text or "") for r in got)
    assert all(len(r.piece_ids) == 0 for r in got if not r.text)
    assert pieces.encode(edge(spark).limit(0), model).count() == 0
    assert pieces.Codec(model).decode(np.array([-1, 10**6, 3 + 0xFF])) == "�"


def test_mixing_meets_its_targets(spark):
    rng, rows, labels = random.Random(2), [], []
    for i in range(400):
        d = ["a", "b", "c"][i % 10 // 4]
        rows.append((i, " ".join(rng.choices({"a": ["ant", "ape"], "b": ["bee", "bat"], "c": ["cat", "cow"]}[d] + ["of"], k=30))))
        labels += [(i, d)] if i % 2 else []
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as domain")
    labelled = spark.createDataFrame(labels, "doc_id long, domain string")
    weights = {"a": 0.5, "b": 0.3, "c": 0.2}
    got = mixing.mix(docs, labelled, weights).collect()
    total = sum(r.tokens for r in got)
    for k, d in enumerate("abc"):
        assert abs(sum(r.rate * r.tokens * r.p[k] for r in got) / total - weights[d]) < 0.01
        truth = [r for r in got if ["a", "b", "c"][r.doc_id % 10 // 4] == d]
        assert np.mean([r.p[k] for r in truth]) > 0.8
    assert all(r.rate >= 0 and abs(r.copies - r.rate) < 1 for r in got)
    odd = mixing.mix(edge(spark), labelled, weights).collect()
    assert len(odd) == len(EDGE) and all(abs(sum(r.p) - 1) < 1e-9 for r in odd)
    assert mixing.mix(docs.limit(0), labelled, weights).count() == 0
    assert mixing.mix(docs, labelled.limit(0), weights).count() == 400


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    keep = [lambda m: True, lambda m: all(int(x) <= 255 for x in m[0].split(".")), lambda m: 13 <= len(digits(m)) <= 19 and pii.luhn(digits(m)), lambda m: 9 <= len(digits(m)) <= 15]
    return sorted((k, m.start(), m.end()) for k in range(4) for m in re.finditer(PATTERNS[k], t) if keep[k](m))


def test_base_spans_are_the_patterns():
    rng = random.Random(9)
    for _ in range(20_000):
        t = "".join(rng.choice("ab@@..--+ 0123()%_é4242 ") for _ in range(rng.randint(0, 40)))
        assert sorted(pii.base_spans(t)) == brute_spans(t), t
    assert pii.luhn("4207051279108084") and not pii.luhn("4207051279108085")


def test_long_runs_stay_linear():
    assert pii.base_spans("a" * 300_000) == [] and pii.base_spans("1" * 300_000) == [] and pii.base_spans("@" * 100_000) == []


def test_field_keeps_labels_consistent(spark):
    text = "mail a.b@x.example.com or +1 (375) 555-4393 now; later call 555-4393. Version 2.0 and 10.20.30.40"
    clean = "Nothing here but version 2.0 of 1999 and 12 34 56."
    docs = spark.createDataFrame([(k, text if k % 2 else clean) for k in range(60)] + EDGE, "doc_id long, text string").selectExpr("*", "'y' as spans")
    once = text.replace("later call 555-4393", "later call us")
    model = pii.fit(spark.createDataFrame([(k, once if k % 2 else clean) for k in range(200)], "doc_id long, text string"))
    got = {r.doc_id: r for r in pii.find(docs, model).collect()}
    assert "phone:" + f"{text.rindex('555-4393')}:{text.rindex('555-4393') + 8}" in got[11].spans
    assert (got[11].n_email, got[11].n_ip, got[11].n_card, got[11].n_phone) == (1, 1, 0, 1)
    assert got[10].spans == "" and got[10].base_sha256 == hashlib.sha256(b"").hexdigest()
    base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in brute_spans(text))
    assert got[11].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
    assert set(base.split(",")) <= set(got[11].spans.split(","))
    assert pii.find(docs.limit(0), model).count() == 0
    assert pii.find(docs, pii.fit(docs.limit(0))).count() == docs.count()


def test_beliefs_are_exact_on_a_tree():
    rng = np.random.default_rng(0)
    u, pair = rng.normal(size=(3, pii.LABELS)), rng.normal(size=(2, pii.LABELS, pii.LABELS))
    edges = np.array([[0, 1], [1, 2]])
    joint = np.exp(u[0][:, None, None] + u[1][None, :, None] + u[2][None, None, :] + pair[0][:, :, None] + pair[1][None, :, :])
    p = pii.beliefs(u, edges, pair, sweeps=60)
    for k, axes in enumerate([(1, 2), (0, 2), (0, 1)]):
        assert np.allclose(p[k], joint.sum(axis=axes) / joint.sum(), atol=1e-6)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id=wrap><div class=story><h2>Title {0}</h2><p>First &eacute; {0}<br>more<p>Second <b>bold</b>  text {0}</p><div class="share">Share this</div><p>Read our rules</div>
<div class="comments"><p>nice {0}</div></div><footer>&copy; us {0}</footer></body></html>"""


def test_template_and_markup_are_left_out(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format(f"n{i} " + "lorem " * 30)) for i in range(12)]
    rows += [(20, "http://h.example/a", "<html><body><nav>x</nav><article><h1>A &amp; B</h1><p>one<p>two\n three</article><aside>y</aside>"), (21, None, None), (22, "odd", ""), (23, "http://z.example", "<" * 50 + "<div>" * 3000 + "deep")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as text", "1 as host", "2 as salt")
    got = {r.page_id: r for r in webpage.main_text(docs).collect()}
    body = lambda i: f"n{i} " + "lorem " * 30
    for i in range(12):
        t = re.sub(" +", " ", body(i)).strip()
        assert got[i].text == f"Title {t}\n\nFirst é {t} more\n\nSecond bold text {t}", got[i].text
        assert got[i].n_chars == len(got[i].text)
    assert got[20].text == "A & B\n\none\n\ntwo three"
    assert got[21].text == "" and got[22].text == "" and got[23].text.endswith("deep") and len(got) == len(rows)
    assert webpage.main_text(docs.limit(0)).count() == 0


def test_tree_matching_keeps_order():
    a, b = (webpage.Folded(webpage.parse(x)) for x in ("<div><p>1</p><ul><li>x</ul><h2>t</h2></div>", "<div><h1>0</h1><p>1</p><h2>t</h2><ul><li>x</ul></div>"))
    size, pairs = webpage.tree_match(a, b)
    assert size == 5  # root, div, p, ul and li; h2 would cross
    assert all(a.keys[i] == b.keys[j] for i, j in pairs)


def test_a_key_stands_in_one_run_only_because_of_the_anti_join(spark, monkeypatch):
    frame = lambda ids, keys: spark.createDataFrame([(i, k, 0) for i in ids for k in keys], "doc_id long, h1 long, h2 long")
    batches = [frame([1, 2], [5, 6]), frame([3], [5, 7]), frame([4, 4, 9], [5])]

    def runs():
        r = linededup.LineRuns(spark, fanout=5)
        for b in batches:
            r.add(b)
        return sorted(tuple(x) for x in r.keys().collect()), sorted(tuple(x) for x in r.compacted().collect())

    keys, counted = runs()
    assert keys == [(5, 0, 2, 2), (6, 0, 2, 2), (7, 0, 1, 3)]
    assert counted == [(5, 0, 5, 9), (6, 0, 2, 2), (7, 0, 1, 3)]
    join = type(batches[0]).join
    monkeypatch.setattr(type(batches[0]), "join", lambda a, b, on=None, how=None: a if how == "left_anti" else join(a, b, on, how))
    assert runs()[1] != counted


def test_line_dedup_of_repeated_ids_equals_the_sql(spark, tmp_path):
    import duckdb

    from evidrel.llm.queries import OP7_SQL, op7_line_dedup

    rng = random.Random(8)
    pool = [f"Line {k} " + "é" * 50 for k in range(6)] + ["short", "x" * 45]
    rows = [(rng.choice([None, *range(12)]), "\n".join(rng.choices(pool, k=rng.randint(1, 6)))) for _ in range(60)]
    rows += rows[:9] + [(3, "\n".join(f"own line {k} " + "y" * 40 for k in range(5000)) + "\n" + pool[0])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(str(tuple(r)) for r in op7_line_dedup(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(str(r) for r in con.sql(OP7_SQL).fetchall())


def test_samples_are_bounded_for_any_data(spark):
    from pyspark.sql import functions as F

    from evidrel.llm.common import hashed_sample

    rows = [(i, f"l{i % 250}", f"t{i}") for i in range(2000)] + [(5, "l5", f"r{k}") for k in range(300)] + [(7, None, "x"), (None, "l1", "y")]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = hashed_sample(df, "doc_id", F.col("lang"), 3).collect()
    counts = {}
    for r in got:
        counts.setdefault(r.class_value, []).append(r.doc_id)
    assert len(counts) == 250 and all(len(v) <= 3 and len(set(v)) == len(v) for v in counts.values())
    assert sum(map(len, counts.values())) >= 700
    assert sorted(map(tuple, got)) == sorted(map(tuple, hashed_sample(df.repartition(7), "doc_id", F.col("lang"), 3).collect()))


def test_many_languages_are_all_learned(spark):
    rng = random.Random(1)
    rows = [(k * 4 + i, " ".join(chr(0x4E00 + 40 * k + rng.randrange(40)) for _ in range(60)), f"l{k:03}") for k in range(250) for i in range(4)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    import pickle

    assert len(pickle.loads(model)[1]) == 250


def test_a_kept_domain_stays_and_targets_are_met(spark):
    """Rates of the kept domain are at least 1 inside the fit, so totals meet the targets within 1 %."""
    rng, rows, labels = random.Random(12), [], []
    words = {"clean": ["ant", "ape", "asp"], "poor": ["bee", "bat", "ape"], "toxic": ["cat", "cow", "asp"]}
    for i in range(900):
        d = ["clean", "clean", "clean", "poor", "toxic"][i % 5]
        rows.append((i, " ".join(rng.choices(words[d] + ["of", "the"], k=rng.randint(3, 25)))))
        labels += [(i, d)] if i % 2 else []
    docs, labelled = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, domain string")
    weights = {"clean": 0.78, "poor": 0.1, "toxic": 0.12}
    got = mixing.mix(docs, labelled, weights, keep="clean").collect()
    kept = [r for r in got if r.p[0] >= max(r.p)]
    assert all(r.rate >= 1 and r.copies >= 1 for r in kept) and 400 < len(kept) < 700
    clean = sum(r.tokens * r.p[0] for r in got)
    for k, d in enumerate(sorted(weights)):
        assert abs(sum(r.rate * r.tokens * r.p[k] for r in got) / clean - weights[d] / weights["clean"]) < 0.01
    assert 0 < sum(r.copies == 0 for r in got)


def test_rates_are_those_of_nonnegative_least_squares(spark):
    """Of all nonnegative rates that meet the targets, those nearest to 1: against projected steps in plain numpy."""
    rng = np.random.default_rng(5)
    p, tokens = rng.dirichlet([0.6, 0.4, 0.3], 300), rng.integers(1, 50, 300)
    df = spark.createDataFrame([(int(t), x.tolist(), 0.0) for t, x in zip(tokens, p, strict=True)], "tokens long, p array<double>, least double")
    weights = [0.6, 0.25, 0.15]
    u, reached, _ = mixing.fit_rates(df, weights)
    assert np.allclose(reached, weights, atol=1e-3)
    v, a = np.zeros(3), (p * tokens[:, None]) / tokens.sum()
    for _ in range(20_000):  # dual ascent of least squares distance from 1, weighted by tokens, under r >= 0
        v += 2.0 * (a.T @ np.maximum(0, 1 - p @ v) - weights)
    assert np.allclose(np.maximum(0, 1 - p @ v), np.maximum(0, 1 - p @ np.array(u)), atol=0.02)


def test_the_field_finds_what_patterns_miss(spark):
    """Bare mentions planted into held-out documents: precision and recall of the spans that the field adds."""
    import pickle

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text, pii.base_spans(r.text)) for r in docs.where("text rlike '[0-9@]'").collect()]
    held = [r for r in rows if r[2] and r[0] % 2 == 0]
    model = pii.fit(spark.createDataFrame([r[:2] for r in rows if r[0] % 2], "doc_id long, text string"))
    planted = [pii.with_mentions(t, base, i) for i, t, base in held]
    bases = [pii.base_spans(t) for t, *_ in planted]
    added = pii.added_spans([t for t, *_ in planted], bases, pickle.loads(model))
    right = sum((k, s, e) in true for (_, true, _), spans in zip(planted, added, strict=True) for k, s, e in spans)
    wrong = sum(any(s < b and a < e for _, a, b in false) for (_, _, false), spans in zip(planted, added, strict=True) for _, s, e in spans)
    total, behind = sum(len(true) for _, true, _ in planted), sum(s >= len(t) for (_, t, _), spans in zip(held, added, strict=True) for _, s, _ in spans)
    print("mentions", total, "added behind the texts", behind, "right", right, "decoys", wrong)
    assert total >= 20 and right >= 0.7 * total and right >= 0.9 * behind
    # without skip edges the mentions cannot be told from the decoys
    W, A, S = pickle.loads(model)
    lone = pii.added_spans([t for t, *_ in planted], bases, (W, A, np.zeros_like(S)))
    found = sum((k, s, e) in true for (_, true, _), spans in zip(planted, lone, strict=True) for k, s, e in spans)
    assert found < right
