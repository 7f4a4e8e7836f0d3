"""Retrieval: TF-IDF scan, predicates, ranking, selection and near-duplicate groups.

Queries and documents are tables; one request is one row. The scan reads the
documents twice: once to count the documents of each gram, once to multiply
their weights with those of the queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidrel.functions.text import word_bound_grams
from evidrel.sources.batches import small_batches

DOCUMENT_SOURCES = ["news", "announcement", "faq", "product_doc", "research_note"]
#: Documents and queries multiplied at a time, queries sent to the tasks at a time, and grams that a task counts before it sums them.
DOCUMENT_BLOCK, QUERY_BLOCK, MOST_QUERIES, GRAMS_HELD = 128, 256, 8192, 1_000_000
#: Bytes of text of a block of documents, unless one document has more.
BLOCK_BYTES = 2 << 20
#: Gram counts sent to the tasks at most (16 bytes each); beyond them document norms come from a join.
MOST_GRAMS = 8_000_000
#: Grams of a block of queries that are looked for first: those that most of its queries hold.
FIRST_GRAMS = 64
#: Numbers in a dense table of weights, of documents or of queries; and characters of queries sent to the tasks at a time, unless one query has more.
TABLE_CELLS, MOST_ASKED = 1 << 22, 4_000_000
#: A key that no gram has.
DOCUMENTS = 0x1FFFFE << 42
LEAST_SCORE = {"news": 0.02, "announcement": 0.02, "research_note": 0.05, "faq": 0.05, "product_doc": 0.05}


def gram_counts(texts: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, gram, tf) of word-bound 2- to 4-grams."""
    return texts.select(key, F.explode(word_bound_grams(text)).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("tf"))


def spaced(text: Column) -> Column:
    """Lower-cased words between single spaces, one at either end; null without words."""
    words = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.when(words != "", F.concat(F.lit(" "), words, F.lit(" ")))


def has_words(text: Column) -> Column:
    """Whether ``spaced`` is not null, told without spacing the text out a second time."""
    return text.rlike(r"\S")


def gram_keys(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The word-bound 2- to 4-grams of a spaced text as sorted 64-bit keys, and how often each is there.

    A gram lies in a padded word if no space is inside it. Keys of 2 and 3
    characters are exact, those of 4 are hashes of 63 bits.
    """
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    inner = c != 32
    two = (c[:-1] << np.uint64(21)) | c[1:]  # a code point has 21 bits and is below 0x110000
    three = ((two[:-1] << np.uint64(21)) | c[2:])[inner[1:-1]]
    four = ((two[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (two[2:] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)))[inner[1:-2] & inner[2:-1]]
    four ^= four >> np.uint64(29)
    four = (four * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1 << 63)
    return np.unique(np.concatenate([two | np.uint64(0x1FFFFF << 42), three, four]).view(np.int64), return_counts=True)


def run_hashes(text: str) -> np.ndarray:
    """64-bit hashes of all runs of two and three characters of a text, by place."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    two = (c[:-1] << np.uint64(21)) | c[1:]
    return np.concatenate([two | np.uint64(0x1FFFFF << 42), (two[:-1] << np.uint64(21)) | c[2:]]) * np.uint64(0x9E3779B97F4A7C15)


def blocks_of(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches in blocks of at most DOCUMENT_BLOCK rows and about BLOCK_BYTES bytes of text, so that a task holds no batch as Python values."""
    for b in batches:
        ends, lo = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while lo < b.num_rows:
            fits = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BLOCK_BYTES, "right"))
            hi = min(max(fits, lo + 1), lo + DOCUMENT_BLOCK)
            yield b.slice(lo, hi - lo)
            lo = hi


def norms_of(block: pa.RecordBatch) -> np.ndarray:
    """The column norm; null is not a number."""
    return pc.fill_null(block.column("norm"), float("nan")).to_numpy(zero_copy_only=False)


def document_counts(texts: DataFrame) -> DataFrame:
    """(key, df) of the grams of spaced texts, and the number of texts at DOCUMENTS; each task sums before it hands on."""

    def summed(held: list[np.ndarray]) -> pa.RecordBatch:
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.record_batch({"key": keys, "df": n.astype(np.int64)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in blocks_of(batches):
            held.append(np.full(b.num_rows, DOCUMENTS))
            for t in b.column("text").to_pylist():
                held.append(gram_keys(t)[0])
                size += len(held[-1])
                if size >= GRAMS_HELD:
                    yield summed(held)
                    held, size = [], 0
        if held:
            yield summed(held)

    return texts.mapInArrow(run, "key long, df long").groupBy("key").agg(F.sum("df").alias("df"))


@dataclass
class Asked:
    """What a scan sends to its tasks: idf of the grams that several documents or a query hold, and blocks of query vectors."""

    known: np.ndarray
    idf: np.ndarray
    single: float  # idf of a gram that one document holds
    blocks: list[tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray], list[int]]]  # grams, (gram, query, weight) of those that are there, places of the queries
    norms: DataFrame | None = None  # (doc, norm), where the counts of all grams are too many to send

    def with_norms(self, texts: DataFrame, key: str = "doc") -> DataFrame:
        """texts with a column norm: null where tasks can tell it from the counts they have."""
        return texts.withColumn("norm", F.lit(None).cast("double")) if self.norms is None else texts.join(self.norms.withColumnRenamed("doc", key), key, "left")

    def sent(self) -> Asked:
        return Asked(self.known, self.idf, self.single, self.blocks)


def document_norms(texts: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(doc, norm) of the TF-IDF vectors of spaced texts (doc, text), joined gram by gram with their counts (key, df)."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks_of(batches):
            for i, text in enumerate(b.column("text").to_pylist()):
                keys, n = gram_keys(text)
                yield pa.record_batch({"doc": b.column("doc").take(pa.array(np.full(len(keys), i))), "key": keys, "tf": n.astype(np.int64)})

    rows = texts.select("doc", "text").mapInArrow(grams, f"doc {texts.schema['doc'].dataType.simpleString()}, key long, tf long")
    w = F.col("tf") * (F.log((1 + F.lit(total)) / (1 + F.coalesce("df", F.lit(1)))) + 1)
    return rows.join(counts, "key", "left").groupBy("doc").agg(F.sqrt(F.sum(w * w)).alias("norm"))


def asked_vectors(texts: DataFrame, asked: list[str]) -> Asked:
    """Unit TF-IDF vectors of spaced queries over the grams of spaced documents (text)."""
    spark = texts.sparkSession
    grams = [gram_keys(t) for t in asked]
    wanted = np.unique(np.concatenate([np.array([DOCUMENTS]), *[k for k, _ in grams]]))
    mine = spark.createDataFrame(pa.table({"key": wanted, "asked": np.ones(len(wanted), bool)}))
    counts = document_counts(texts.select("text")).join(F.broadcast(mine), "key", "left").where("df > 1 or asked").persist()
    few = counts.count() <= MOST_GRAMS
    common = (counts if few else counts.where("asked")).select("key", "df").toArrow().sort_by("key")
    known, df = common["key"].to_numpy(), common["df"].to_numpy()
    i, here = places(known, np.array([DOCUMENTS]))
    total = int(df[i[0]]) if here.any() else 0
    idf = lambda n: np.log((1 + total) / (1 + n)) + 1
    out = Asked(known, idf(df).astype(np.float64), float(idf(1.0)), [], None if few else document_norms(texts, counts.select("key", "df"), total))
    if few:
        counts.unpersist()
    for at in range(0, len(grams), QUERY_BLOCK):
        part, made = grams[at : at + QUERY_BLOCK], []
        for j, (k, n) in enumerate(part):
            i, here = places(known, k)
            w = n[here] * out.idf[i[here]]
            made.append((k[here], np.full(len(w), j, np.int32), w / np.sqrt(w @ w) if len(w) else w))
        keys, q, weight = (np.concatenate(c) for c in zip(*made, strict=True))
        own, g = np.unique(keys, return_inverse=True)
        order = np.lexsort((q, g))
        out.blocks.append((own, (g[order].astype(np.int32), q[order], weight[order]), list(range(at, at + len(part)))))
    return out


def block_cosines(asked: Asked, keyed: list[tuple[np.ndarray, np.ndarray] | None], norms: np.ndarray) -> Iterator[tuple[list[int], np.ndarray]]:
    """For each block of queries their places and the (text, query) cosines of texts given by their gram keys; a text without words (None) has 0.

    The grams are taken a stretch at a time, so that no table has more than
    TABLE_CELLS numbers however many grams the queries hold.
    """
    vectors = []
    for r, made in enumerate(keyed):
        if made is not None:
            keys, n = made
            i, here = places(asked.known, keys)
            w = n * np.where(here, asked.idf[i], asked.single)
            vectors.append((r, keys, w / (np.sqrt(w @ w) if np.isnan(norms[r]) else norms[r])))
    for own, (g, q, weight), at in asked.blocks:
        got, wide = np.zeros((len(keyed), len(at))), max(1, TABLE_CELLS // max(1, len(keyed), len(at)))
        for lo in range(0, len(own), wide):
            some = own[lo : lo + wide]
            a, b = np.searchsorted(g, np.array([lo, lo + len(some)], g.dtype))
            table, weights = np.zeros((len(some), len(at))), np.zeros((len(keyed), len(some)))
            table[g[a:b] - lo, q[a:b]] = weight[a:b]
            for r, keys, w in vectors:
                first, last = np.searchsorted(keys, some[0]), np.searchsorted(keys, some[-1], "right")
                i, here = places(some, keys[first:last])
                weights[r, i[here]] = w[first:last][here]
            got += weights @ table
            del table, weights  # before the next ones are made
        yield at, got


def keyed_texts(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    return [gram_keys(t) if t else None for t in texts]


def query_groups(queries: DataFrame) -> Iterator[DataFrame]:
    """The queries (text and more) in groups of about MOST_QUERIES and MOST_ASKED characters, so what goes to every task is bounded."""
    n, characters = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    groups = max(1, -(-n // MOST_QUERIES), -(-characters // MOST_ASKED))
    for g in range(groups):
        yield queries if groups == 1 else queries.where(F.pmod(F.xxhash64(*queries.columns[:1]), F.lit(groups)) == g)


class Running:
    """The k best rows of each group that a task has met: by score to four places, then by id.

    A group's kth score bars worse rows of later blocks, so a task holds and hands
    on about k rows of each group, however many documents it reads. Scores so near
    to a rounding border that another rounding may differ are kept as well.
    """

    def __init__(self, groups: int, k: int):
        self.k, self.least = k, np.full(groups, -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n, self.most = 0, 4 * k * groups + 100_000

    def add(self, group: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        ok = score >= self.least[group] - 1e-4
        if ok.any():
            self.held.append((group[ok], ids[ok], score[ok]))
            self.n += int(ok.sum())
            if self.n > self.most:
                self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.held:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        group, ids, score = (np.concatenate(c) for c in zip(*self.held, strict=True))
        tens = score * 1e4
        order = np.lexsort((ids, -np.floor(tens + 0.5), group))
        group, ids, score, tens = group[order], ids[order], score[order], tens[order]
        begins = np.flatnonzero(np.diff(group, prepend=-1))
        rank = np.arange(len(group)) - np.repeat(begins, np.diff(np.append(begins, len(group))))
        last = rank == self.k - 1
        self.least[group[last]] = np.maximum(self.least[group[last]], score[last])
        near = (np.abs(tens % 1 - 0.5) < 1e-6) & (score >= self.least[group] - 1e-4)
        keep = (rank < self.k) | near
        self.held, self.n = [(group[keep], ids[keep], score[keep])], int(keep.sum())
        self.most = max(self.most, 2 * self.n)
        return self.held[0]


def cosine(queries: DataFrame, docs: DataFrame, query_text: Column, doc_text: Column, query_key: str = "query_id", doc_key: str = "doc_id", least: float = 0.0, top: int | None = None) -> DataFrame:
    """(query, doc, cosine) of pairs that share a gram, with a cosine of at least ``least``.

    Grams that no document holds count for nothing. top: hits that cannot be
    among a query's best ``top`` by cosine to four places may be left out.
    Queries go to every task, MOST_QUERIES at a time, as do the document counts
    of grams that several documents hold; documents stay where they are read,
    so pairs with common grams need no join.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.where(has_words(doc_text)).select(F.col(doc_key).alias("doc"), spaced(doc_text).alias("text"))
    kinds = {query_key: queries.schema[query_key].dataType.simpleString(), doc_key: docs.schema[doc_key].dataType.simpleString()}
    schema, parts = f"{query_key} {kinds[query_key]}, {doc_key} {kinds[doc_key]}, cosine double", []
    for group in query_groups(queries.select(F.col(query_key).alias("query"), spaced(query_text).alias("text")).where("text is not null")):
        asked = group.toArrow().to_pydict()
        vectors = asked_vectors(texts, asked["text"])
        shared = spark.sparkContext.broadcast((vectors.sent(), np.array(asked["query"])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vectors, ids = shared.value
            best = Running(len(ids), top) if top is not None else None
            for part in blocks_of(batches):
                docs = part.column("doc").to_numpy(zero_copy_only=False)
                for mine, got in block_cosines(vectors, keyed_texts(part.column("text").to_pylist()), norms_of(part)):
                    d, q = np.nonzero((got > 0) & (got >= least))
                    if best is not None:
                        best.add(np.asarray(mine)[q], docs[d], got[d, q])
                    elif len(d):
                        yield pa.record_batch({query_key: ids[mine][q], doc_key: docs[d], "cosine": got[d, q]})
            q, d, score = best.rows() if best is not None else ([], [], [])
            if len(q):
                yield pa.record_batch({query_key: ids[q], doc_key: d, "cosine": score})

        parts.append(vectors.with_norms(texts).mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, parts)


def bonus_terms(r: dict) -> list[str]:
    """The terms of a request that can give a bonus, repeated ones again."""
    return [t for t in [*(r["industry_terms"] or []), *(r["keywords"] or []), *(r["entity_names"] or [])] if t is not None and len(t.strip(" ")) >= 2]


class Terms:
    """The distinct bonus terms of all requests, and which of them texts hold.

    A text that holds an ASCII term without white space has all the term's grams
    in its own lower-cased ones, so only such terms are looked for in it; and a
    text that holds any term has all its runs of two and three characters as they
    are written, of which a table of their hashes misses none.
    """

    def __init__(self, requests: list[dict]):
        self.terms = sorted({t for r in requests for t in bonus_terms(r)})
        self.place = {t: i for i, t in enumerate(self.terms)}
        sure = [t.isascii() and not any(c.isspace() for c in t) for t in self.terms]
        made = [gram_keys(t.lower())[0] for t, ok in zip(self.terms, sure, strict=True) if ok]
        self.gramed, self.plain = np.flatnonzero(sure), [i for i, ok in enumerate(sure) if not ok]
        self.keys, self.own = np.unique(np.concatenate([np.zeros(0, np.int64), *made]), return_inverse=True)
        self.begins = np.cumsum([0, *map(len, made)])[:-1].astype(np.int64)
        runs = [run_hashes(t) for t in self.terms]
        self.runs, self.first_run = np.concatenate([np.zeros(0, np.uint64), *runs]), np.cumsum([0, *map(len, runs)])[:-1].astype(np.int64)

    def paired(self, text: str) -> np.ndarray:
        """Which terms have their runs in a table of the text's runs; of those that the text holds, all."""
        runs = run_hashes(text)
        size = min((8 * len(runs) + 1024).bit_length(), TABLE_CELLS.bit_length() - 1)  # 8 to 16 places a run, until the table is full
        bits, table = np.uint64(64 - size), np.zeros(1 << size, bool)
        table[runs >> bits] = True
        return np.logical_and.reduceat(table[self.runs >> bits], self.first_run)

    def held(self, keyed: list[tuple[np.ndarray, np.ndarray] | None], texts: list[str]) -> np.ndarray:
        """(text, term): whether the whole text has the term in it; ``keyed`` are the texts' gram keys."""
        out = np.zeros((len(texts), len(self.terms)), bool)
        for row, (made, text) in enumerate(zip(keyed, texts, strict=True)):
            likely = self.plain
            if made is not None and len(self.gramed):
                there = places(made[0], self.keys)[1]
                likely = [*self.gramed[np.logical_and.reduceat(there[self.own], self.begins)], *likely]
            likely = np.asarray(likely, np.int64)
            if len(likely):
                out[row, [i for i in likely[self.paired(text)[likely]].tolist() if self.terms[i] in text]] = True
        return out


class Rules:
    """The predicates and bonus of a block of requests against a block of documents, as matrices (document, request)."""

    def __init__(self, requests: list[dict], terms: Terms):
        self.plans = np.array([[r["source_plan"] is None or s in r["source_plan"] for r in requests] for s in DOCUMENT_SOURCES], bool).reshape(len(DOCUMENT_SOURCES), len(requests))
        self.symbols, pairs = {}, []
        for j, r in enumerate(requests):
            for s in r["symbols"] or []:
                self.symbols.setdefault(s, []).append(j)
            pairs += [(terms.place[t], j) for t in bonus_terms(r)]
        term, self.asks = np.array(pairs, np.int64).reshape(-1, 2).T
        self.own, self.term = np.unique(term, return_inverse=True)
        self.about = np.array([bool(r["symbols"]) for r in requests])
        self.bound = np.array([self.skips_bound(r) for r in requests])

    @staticmethod
    def skips_bound(r: dict) -> bool:
        """Whether a request without symbols passes over documents about an entity."""
        intents, topics = set(r["intent_labels"] or []), set(r["topic_labels"] or [])
        if r["product_type"] in ("stock", "index", "generic_market"):
            return not (r["industry_terms"] or "industry" in topics)
        return r["product_type"] in ("fund", "etf") and bool(intents & {"product_info", "trading_rule_fee"} or "product_mechanism" in topics)

    def allowed(self, kinds: np.ndarray, symbols: list) -> np.ndarray:
        """Which documents a request may take: their source is planned, and their entities suit it."""
        n = len(kinds)
        known = kinds >= 0
        ok = np.zeros((n, len(self.about)), bool)
        ok[known] = self.plans[kinds[known]]
        meets, has = np.zeros_like(ok), np.zeros(n, bool)
        for d, own in enumerate(symbols):
            for s in own if own is not None else []:
                has[d] = True
                meets[d, self.symbols.get(s, [])] = True
        strict = np.isin(kinds, [DOCUMENT_SOURCES.index(s) for s in ("news", "announcement", "research_note")])
        ok &= ~(strict[:, None] & self.about & ~meets)
        return ok & ~(~self.about & has[:, None] & self.bound)

    def bonus(self, held: np.ndarray) -> np.ndarray:
        """.06 for each term of two characters or more that the whole text holds (see ``Terms.held``), at most .18; repeated terms count again."""
        counts = np.zeros((len(self.own), len(self.about)))
        np.add.at(counts, (self.term, self.asks), 1)
        return np.minimum(0.06 * (held[:, self.own] @ counts), 0.18)


REQUEST_FIELDS = ["keywords", "entity_names", "symbols", "industry_terms", "source_plan", "product_type", "intent_labels", "topic_labels"]


def scan(requests: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, doc_id, source_type, score): candidates of each request, its best k of each source at least.

    requests: query_id, query and REQUEST_FIELDS; docs: doc_id, source_type,
    title, summary, body, entity_symbols. The score is the cosine of the request
    (query, entity names, keywords, symbols) and the whole document plus the
    term bonus, to four places. A document counts where the plan names its
    source (a null plan: all five), where news, announcements and research notes
    share a symbol with a request that has some, where it is not bound to an
    entity that the request is not about, and where the score reaches its
    source's least. Every document is scored where it is read; a task hands on
    its best k of each request and source.
    """
    spark = docs.sparkSession
    small_batches(spark)
    whole = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.coalesce("body", F.lit("")))
    rows = docs.select("doc_id", "source_type", "entity_symbols", whole.alias("whole"), spaced(whole).alias("text"))
    words = lambda c: F.coalesce(F.array_join(c, " "), F.lit(""))
    text = spaced(F.concat_ws(" ", F.coalesce("query", F.lit("")), words("entity_names"), words("keywords"), words("symbols")))
    schema, parts = "query_id long, doc_id long, source_type string, score double", []
    for group in query_groups(requests.select("query_id", text.alias("text"), *REQUEST_FIELDS).where("text is not null")):
        asked = group.toArrow().to_pylist()
        vectors = asked_vectors(rows.where(has_words(F.col("whole"))).withColumnRenamed("doc_id", "doc"), [r["text"] for r in asked])
        terms = Terms(asked)
        shared = spark.sparkContext.broadcast((vectors.sent(), np.array([r["query_id"] for r in asked]), terms, [Rules([asked[j] for j in at], terms) for *_, at in vectors.blocks]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vectors, ids, terms, rules = shared.value
            least = np.array([LEAST_SCORE[s] for s in DOCUMENT_SOURCES])
            code = {s: i for i, s in enumerate(DOCUMENT_SOURCES)}
            best = Running(len(DOCUMENT_SOURCES) * len(ids), k)
            for part in blocks_of(batches, "whole"):
                kinds = np.array([code.get(s, -1) for s in part.column("source_type").to_pylist()])
                docs, symbols = part.column("doc_id").to_numpy(zero_copy_only=False), part.column("entity_symbols").to_pylist()
                keyed = keyed_texts(part.column("text").to_pylist())
                held = terms.held(keyed, part.column("whole").to_pylist())
                for (mine, got), rule in zip(block_cosines(vectors, keyed, norms_of(part)), rules, strict=True):
                    score = np.round(np.maximum(got + rule.bonus(held), 0), 4)
                    score[~rule.allowed(kinds, symbols)] = -1
                    score[score < least[kinds][:, None]] = -1
                    d, q = np.nonzero(score >= 0)
                    best.add(kinds[d] * len(ids) + np.asarray(mine)[q], docs[d], score[d, q])
            group, d, score = best.rows()
            if len(group):
                yield pa.record_batch({"query_id": ids[group % len(ids)], "doc_id": d, "source_type": np.array(DOCUMENT_SOURCES)[group // len(ids)].tolist(), "score": score})

        parts.append(vectors.with_norms(rows, "doc_id").mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, parts)


class Sharing:
    """Which requests of a block share a gram with texts, told without weights.

    Nearly every text shares one of the few grams that most requests hold; only
    where these leave a request open are the others looked for.
    """

    def __init__(self, grams: list[np.ndarray]):
        keys, q = np.concatenate([np.zeros(0, np.int64), *grams]), np.repeat(np.arange(len(grams), dtype=np.int32), [len(k) for k in grams])
        self.own, g, n = np.unique(keys, return_inverse=True, return_counts=True)
        self.q, self.ends = q[np.argsort(g, kind="stable")], np.cumsum(n)
        self.begins = self.ends - n
        first = np.sort(np.argsort(-n, kind="stable")[:FIRST_GRAMS])
        self.first, self.by_first = self.own[first], np.zeros((len(first), len(grams)), bool)
        for row, i in enumerate(first):
            self.by_first[row, self.q[self.begins[i] : self.ends[i]]] = True

    def shared(self, keyed: list[tuple[np.ndarray, np.ndarray] | None]) -> np.ndarray:
        """(text, request): whether they share a gram; ``keyed`` are the texts' gram keys, None without words."""
        out = np.zeros((len(keyed), self.by_first.shape[1]), bool)
        for row, made in enumerate(keyed):
            if made is None:
                continue
            out[row] = self.by_first[places(made[0], self.first)[1]].any(axis=0)
            if not out[row].all():
                i, here = places(self.own, made[0])
                begins, n = self.begins[i[here]], (self.ends - self.begins)[i[here]]
                out[row, self.q[np.repeat(begins - np.cumsum(n) + n, n) + np.arange(n.sum())]] = True
        return out


def bonuses(requests: DataFrame, docs: DataFrame, doc_text: Column) -> DataFrame:
    """(query_id, doc_id, bonus): the term bonus of requests (query_id, query, REQUEST_FIELDS) for every document whose text shares a gram with the query.

    Requests go to every task in groups, as for ``cosine``; documents are read
    once a group, and neither they nor the pairs are joined. Texts of requests
    that repeat an id count together.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.where(has_words(doc_text) & F.col("doc_id").isNotNull()).select("doc_id", doc_text.alias("whole"), spaced(doc_text).alias("text"))
    schema, parts = f"query_id long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, bonus double", []
    for group in query_groups(requests.where("query_id is not null").select("query_id", spaced(F.col("query")).alias("text"), *REQUEST_FIELDS)):
        asked, own = group.toArrow().to_pylist(), {}
        for r in asked:
            own.setdefault(r["query_id"], []).append(gram_keys(r["text"])[0] if r["text"] else np.zeros(0, np.int64))
        blocks, terms = [asked[at : at + QUERY_BLOCK] for at in range(0, len(asked), QUERY_BLOCK)], Terms(asked)
        made = [(np.array([r["query_id"] for r in block]), Sharing([np.unique(np.concatenate(own[r["query_id"]])) for r in block]), Rules(block, terms)) for block in blocks]
        shared = spark.sparkContext.broadcast((terms, made))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            terms, made = shared.value
            for part in blocks_of(batches, "whole"):
                docs, keyed = part.column("doc_id").to_numpy(zero_copy_only=False), keyed_texts(part.column("text").to_pylist())
                held = terms.held(keyed, part.column("whole").to_pylist())
                for ids, sharing, rules in made:
                    d, q = np.nonzero(sharing.shared(keyed))
                    if len(d):
                        yield pa.record_batch({"query_id": ids[q], "doc_id": docs[d], "bonus": rules.bonus(held)[d, q]})

        parts.append(rows.mapInArrow(run, schema))
    return reduce(DataFrame.unionByName, parts)


def places(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where keys would be in a sorted table, and which are there."""
    i = np.searchsorted(table, keys)
    i[i == len(table)] = 0
    return i, table[i] == keys if len(table) else np.zeros(len(keys), bool)


def allowed_sources(plan: Column) -> Column:
    """The plan's document sources; all without a plan; none if the plan names none."""
    every = F.array(*map(F.lit, DOCUMENT_SOURCES))
    return F.when(plan.isNull(), every).otherwise(F.array_intersect(every, plan))


def allowed_sources_or_all(plan: Column) -> Column:
    """As allowed_sources, but a plan without document sources allows all."""
    every, some = F.array(*map(F.lit, DOCUMENT_SOURCES)), allowed_sources(plan)
    return F.when(F.size(some) == 0, every).otherwise(some)


def reaches_least(source: Column, score: Column) -> Column:
    least = F.create_map(*[F.lit(x) for kv in LEAST_SCORE.items() for x in kv])
    return score >= F.coalesce(F.element_at(least, source), F.lit(0.0))


def skips_bound_document(symbols: Column, doc_symbols: Column, product: Column, intents: Column, topics: Column, industry_terms: Column) -> Column:
    """A document about some entity, for a query about none, is skipped unless the query is about an industry or product."""
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    industry = ~none(industry_terms) | F.coalesce(F.array_contains(topics, "industry"), F.lit(False))
    generic = F.coalesce(F.arrays_overlap(intents, F.array(F.lit("product_info"), F.lit("trading_rule_fee"))), F.lit(False)) | F.coalesce(F.array_contains(topics, "product_mechanism"), F.lit(False))
    rule = F.when(product.isin("stock", "index", "generic_market"), ~industry).when(product.isin("fund", "etf"), generic).otherwise(False)
    return none(symbols) & ~none(doc_symbols) & rule


def diversified(hits: DataFrame, k: int, query: str = "query_id", source: str = "source_type", order: list[Column] | None = None, plan: Column | None = None) -> DataFrame:
    """Top k of each query: the best hit of each planned source in the order of the plan, then by score.

    Adds ``position`` from 1. Ties go to the smaller doc_id.
    """
    order = order or [F.desc("score"), F.col("doc_id")]
    plan = F.col("source_plan") if plan is None else plan
    place = F.when(F.array_contains(F.array(*map(F.lit, DOCUMENT_SOURCES)), F.col(source)), F.array_position(plan, F.col(source)))
    best = F.row_number().over(W.partitionBy(query, source).orderBy(*order))
    picked = hits.withColumn("__p", F.when((best == 1) & (place > 0), place).otherwise(F.lit(1 << 30)))
    out = picked.withColumn("position", F.row_number().over(W.partitionBy(query).orderBy("__p", *order)))
    return out.where(F.col("position") <= k).drop("__p")


def usable_document(retrieval: Column, rank: Column) -> Column:
    return F.when(retrieval.isNull(), F.coalesce(rank, F.lit(0.0)) >= 0.55).otherwise(retrieval > 0)


def selected(ranked: DataFrame, k: int, plan: Column | None = None) -> DataFrame:
    """Top k usable documents of each query (query_id, evidence_id, source_type, source_name, source_url, rank_score, retrieval_score).

    Of each planned source the one with an address, not from a seed, with the
    best scores; then by rank score.
    """
    name = F.lower(F.coalesce("source_name", F.lit("")))
    ranked = ranked.where(usable_document(F.col("retrieval_score"), F.col("rank_score")))
    first = [F.desc((F.coalesce("source_url", F.lit("")) != "").cast("int")), F.desc((~F.contains(name, F.lit("seed")) & ~F.startswith(name, F.lit("public_"))).cast("int")), F.desc("rank_score"), F.desc("retrieval_score"), F.col("evidence_id")]
    plan = F.col("source_plan") if plan is None else plan
    place = F.array_position(plan, F.col("source_type"))
    best = F.row_number().over(W.partitionBy("query_id", "source_type").orderBy(*first))
    out = ranked.withColumn("__p", F.when((best == 1) & (place > 0) & F.col("source_type").isin(DOCUMENT_SOURCES), place).otherwise(F.lit(1 << 30)))
    out = out.withColumn("position", F.row_number().over(W.partitionBy("query_id").orderBy("__p", F.desc("rank_score"), "evidence_id")))
    return out.where(F.col("position") <= k).drop("__p")


def text_cosines(texts: list[str | None]) -> np.ndarray:
    """Cosines of all pairs of a few spaced texts; the weights are of these texts alone. A text without words is like none."""
    made = [gram_keys(t) if t else (np.zeros(0, np.int64), np.zeros(0, np.int64)) for t in texts]
    vocabulary, df = np.unique(np.concatenate([np.zeros(0, np.int64), *[k for k, _ in made]]), return_counts=True)
    idf = np.log((1 + len(texts)) / (1 + df)) + 1
    out, vectors = np.eye(len(texts)), []
    for keys, n in made:
        at = np.searchsorted(vocabulary, keys)
        w = n * idf[at]
        vectors.append((at, w / np.sqrt(w @ w) if len(w) else w))
    row = np.zeros(len(vocabulary))
    for i, (at, w) in enumerate(vectors):
        row[at] = w
        for j in range(i):
            out[i, j] = out[j, i] = row[vectors[j][0]] @ vectors[j][1]
        row[at] = 0
    return out


def near_duplicate_groups(ranked: DataFrame, least: float = 0.85, most_per_source: int = 3) -> DataFrame:
    """(query_id, evidence_id, group_id, group_type, members) of the candidates that stay.

    ranked: (query_id, position, evidence_id, source_type, title, summary), the
    candidates of a query being few. In rank order each candidate that is left
    opens a group and takes in later ones that are alike; at most
    ``most_per_source`` of a source type stay.
    """
    text = spaced(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))
    rows = ranked.select("query_id", "position", "evidence_id", "source_type", text.alias("text"))

    def greedy(f: pd.DataFrame) -> pd.DataFrame:
        f, counts, out = f.sort_values("position").reset_index(drop=True), {}, []
        like, left = text_cosines(f["text"].tolist()) >= least, np.ones(len(f), bool)
        for i in range(len(f)):
            if not left[i]:
                continue
            left[i], source = False, f["source_type"][i]
            if counts.get(source, 0) >= most_per_source:
                continue
            counts[source] = counts.get(source, 0) + 1
            taken = np.flatnonzero(like[i] & left)
            left[taken] = False
            e = f["evidence_id"][i]
            members = [e, *f["evidence_id"][taken]]
            out.append((f["query_id"][i], e, f"group_{e}", "news_cluster" if len(members) > 1 else "single", members))
        return pd.DataFrame(out, columns=["query_id", "evidence_id", "group_id", "group_type", "members"])

    return rows.groupBy("query_id").applyInPandas(greedy, "query_id long, evidence_id string, group_id string, group_type string, members array<string>")
