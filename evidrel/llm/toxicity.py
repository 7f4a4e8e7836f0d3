"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word is the lower-cased run of letters and digits; its embedding is the sum of
four hashed rows (its first 3, 4 and 5 bytes and the whole word), so inflected
forms of a root share most of it. Filters of one, two and three words are
max-pooled over the whole document and a linear layer gives a logit. Decision
thresholds are calibrated by language: a naive Bayes over the same hashed words
says which language a text is in, and the logit is shifted so that 0.7 is the
threshold of that language. Both learn from all labelled rows: shards of them
train in numpy where they lie and are averaged after every pass, words of
languages and logits for the thresholds are counted over all of them.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidrel.llm.common import arrow_rows, byte_buffer, drop_scratch, kept, mix64, written
from evidrel.llm.convnet import AdaGrad, Net, new_net, train_step

BUCKETS = 1 << 15
FEATURES = 4
DIM, WIDTHS, FILTERS = 8, (1, 2, 3), 8
PAD = max(WIDTHS) - 1
#: Labelled documents of a shard, until there are as many shards as are averaged at most.
SHARD_DOCS, MOST_SHARDS = 8000, 256
#: Bits of the set of labelled ids (4 MB).
ID_BITS = 1 << 25
#: Documents, and bytes of their words, that a task holds and shuffles at a time.
HELD_DOCS, HELD_BYTES = 8192, 16 << 20
#: Rows of E that are averaged together; bins of a unit of the logit.
ROWS_CHUNK, BINS = 8192, 256
EPOCHS, BATCH, RATE, DECAY, DROP = 6, 32, 0.15, 1e-6, 0.2
#: The score at which a text counts as toxic.
THRESHOLD = 0.7
#: Positives of a language needed before its threshold leaves the common one.
LEAST = 12


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features (words, FEATURES) of lower-cased texts and each text's first word.

    Rows are 1 + feature * BUCKETS + bucket; row 0 is the empty position.
    """
    n = len(offsets) - 1
    inside = ((data >= 48) & (data <= 57)) | ((data >= 97) & (data <= 122)) | (data >= 128)
    before = np.r_[False, inside[:-1]] if len(data) else inside
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.r_[inside[1:], False] if len(data) else inside
    cut = offsets[1:-1] - 1
    after[cut[(cut >= 0) & (cut < len(data))]] = False
    stop = np.flatnonzero(inside & ~after) + 1
    size = stop - start
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    ids = np.empty((len(start), FEATURES), np.int32)
    head = np.zeros(len(start), np.uint64)
    for j in range(8):
        head |= np.where(size > j, padded[start + j], 0).astype(np.uint64) << np.uint64(8 * j)
        if j in (2, 3, 4):
            ids[:, j - 2] = mix64(head + np.uint64(j + 1)) % np.uint64(BUCKETS)
    tail = np.zeros(len(start), np.uint64)
    for j in range(8):
        tail |= np.where(size > 8 + j, padded[np.maximum(stop - 1 - j, 0)], 0).astype(np.uint64) << np.uint64(8 * j)
    ids[:, 3] = mix64(head ^ mix64(tail + size.astype(np.uint64))) % np.uint64(BUCKETS)
    ids += 1 + np.arange(FEATURES, dtype=np.int32) * BUCKETS
    return ids, np.searchsorted(start, offsets[:n])


def padded_rows(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The documents' words one after another with PAD + 1 empty positions behind each, and their starts."""
    counts = np.diff(np.append(first, len(ids)))
    starts = first + np.arange(len(first)) * (PAD + 1)
    rows = np.zeros((len(ids) + len(first) * (PAD + 1), FEATURES), np.int32)
    rows[np.arange(len(ids)) + np.repeat(np.arange(len(first)) * (PAD + 1), counts)] = ids
    return rows, starts


def lower_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return byte_buffer(pc.utf8_lower(texts.cast(pa.large_utf8())))


class Languages:
    """Naive Bayes over hashed whole words: which calibration a text gets."""

    def __init__(self, counts: np.ndarray):
        counts = counts + 0.5
        self.table = np.log(counts / counts.sum(axis=0)).astype(np.float32)

    def __call__(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        counts = np.diff(np.append(first, len(ids)))
        out = np.zeros(len(first), np.int64)
        some = np.flatnonzero(counts)
        if len(some):
            s = np.add.reduceat(self.table[ids[:, 3] - 1 - 3 * BUCKETS], first[some], axis=0)
            out[some] = s.argmax(axis=1)
        return out


def logits(net: Net, ids: np.ndarray, first: np.ndarray, block: int = 60_000) -> np.ndarray:
    """The toxic logit of each document; documents are taken a block of words at a time."""
    out, lo, n = np.empty(len(first)), 0, len(first)
    ends = np.append(first, len(ids))
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + block, "right")) - 1)
        rows, starts = padded_rows(ids[ends[lo] : ends[hi]], ends[lo:hi] - ends[lo])
        x = net.E[rows[:, 0]]
        for j in range(1, FEATURES):
            x += net.E[rows[:, j]]
        h = []
        behind = (np.append(starts[1:], len(rows))[:, None] - 1 - np.arange(PAD)).ravel()  # filters that begin there reach the next document
        for w, W in net.W.items():
            y = x @ W[0]
            for k in range(1, w):
                y[:-k] += x[k:] @ W[k]
            y[behind] = -np.inf
            h.append(np.maximum.reduceat(y, starts, axis=0) + net.b[w])
        z = np.maximum(np.hstack(h), 0) @ net.V + net.c
        out[lo:hi] = z[:, 1] - z[:, 0]
        lo = hi
    return out


def started(seed: int = 0) -> Net:
    net = new_net(1 + FEATURES * BUCKETS, DIM, WIDTHS, FILTERS, 2, seed)
    net.E *= 0.3
    net.E[0] = 0
    return net


def unpacked(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of packed documents one after another, and each document's first word."""
    ids = np.frombuffer(b"".join(words), np.uint16).reshape(-1, FEATURES).astype(np.int32) + 1 + np.arange(FEATURES, dtype=np.int32) * BUCKETS
    size = np.array([len(x) for x in words], np.int64) // (2 * FEATURES)
    return ids, np.cumsum(size) - size


def train(net: Net, opt: AdaGrad, words: list[bytes], y: np.ndarray, weight: np.ndarray, rng: np.random.Generator, touched: np.ndarray) -> None:
    """One pass over documents in random order; the rows of E that they use are marked as touched."""
    ids, first = unpacked(words)
    ends = np.append(first, len(ids))
    touched[ids.ravel()] = True
    order = rng.permutation(len(y))
    for i in range(0, len(order), BATCH):
        k = order[i : i + BATCH]
        part = np.concatenate([ids[ends[d] : ends[d + 1]] for d in k])
        sizes = np.array([ends[d + 1] - ends[d] for d in k])
        part, starts = padded_rows(part, np.cumsum(sizes) - sizes)
        drop = (rng.random((len(k), FILTERS * len(WIDTHS))) >= DROP).astype(np.float32) / (1 - DROP)
        train_step(net, opt, part, starts, y[k], weight[y[k]], DECAY, drop)


def small_weights(net: Net, opt: AdaGrad) -> list[np.ndarray]:
    """All weights but E, and their summed squares; the arrays themselves."""
    named = [("V", net.V), ("c", net.c), *[x for w in WIDTHS for x in ((("W", w), net.W[w]), (("b", w), net.b[w]))]]
    return [x for key, weights in named for x in (weights, opt.sums.setdefault(key, np.full(weights.shape, 1e-6, np.float32)))]


def epoch(table: DataFrame, net: Net, opt: AdaGrad, weight: np.ndarray, number: int) -> None:
    """Every shard goes through its documents from the weights given; these then move by the mean of the shards' moves.

    A row of E moves by the mean over the shards whose documents use it. Shards
    hand on the rows that they use, in ROWS_CHUNK ranges that are added up apart.
    """
    spark = table.sparkSession
    opt.sums.setdefault("E", np.full(net.E.shape, 1e-6, np.float32))
    small_weights(net, opt)
    shared = spark.sparkContext.broadcast(pickle.dumps((net, opt)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def moves() -> Iterator[pa.RecordBatch]:
            net0, opt0 = pickle.loads(shared.value)
            small = np.concatenate([(a - b).ravel() for a, b in zip(small_weights(net, opt), small_weights(net0, opt0), strict=True)])
            yield pa.record_batch({"c": pa.array([-1], pa.int32()), "rows": pa.array([b""], pa.binary()), "w": pa.array([small.astype(np.float64).tobytes()], pa.binary())})
            used = np.flatnonzero(touched)
            for c in np.unique(used // ROWS_CHUNK):
                r = used[used // ROWS_CHUNK == c]
                w = np.hstack([net.E[r] - net0.E[r], opt.sums["E"][r] - opt0.sums["E"][r]]).astype(np.float64)
                yield pa.record_batch({"c": pa.array([c], pa.int32()), "rows": pa.array([r.astype(np.int64).tobytes()], pa.binary()), "w": pa.array([w.tobytes()], pa.binary())})

        def learn() -> None:
            if words:
                train(net, opt, words, np.array(ys), weight, rng, touched)
                words.clear()
                ys.clear()

        shard, words, ys, held = None, [], [], 0
        for b in batches:
            for s, x, y in zip(*(b.column(c).to_pylist() for c in ("shard", "words", "y")), strict=True):
                if s != shard:
                    learn()
                    if shard is not None:
                        yield from moves()
                    (net, opt), shard, held = pickle.loads(shared.value), s, 0
                    rng, touched = np.random.default_rng([number, s]), np.zeros(len(net.E), bool)
                words.append(x)
                ys.append(y)
                held += len(x)
                if len(words) == HELD_DOCS or held >= HELD_BYTES:
                    learn()
                    held = 0
        learn()
        if shard is not None:
            yield from moves()

    def added(f: pd.DataFrame) -> pd.DataFrame:
        if f["c"].iloc[0] < 0:
            w = np.mean([np.frombuffer(x) for x in f["w"]], axis=0)
            return pd.DataFrame({"c": f["c"][:1], "rows": [b""], "w": [w.tobytes()]})
        total, n = np.zeros((ROWS_CHUNK, 2 * DIM)), np.zeros(ROWS_CHUNK)
        for rows, w in zip(f["rows"], f["w"], strict=True):
            r = np.frombuffer(rows, np.int64) % ROWS_CHUNK
            total[r] += np.frombuffer(w).reshape(-1, 2 * DIM)
            n[r] += 1
        r = np.flatnonzero(n)
        return pd.DataFrame({"c": f["c"][:1], "rows": [(r + int(f["c"].iloc[0]) * ROWS_CHUNK).astype(np.int64).tobytes()], "w": [(total[r] / n[r, None]).tobytes()]})

    schema = "c int, rows binary, w binary"
    got = table.where("not aside").select("shard", "words", "y").mapInArrow(run, schema).groupBy("c").applyInPandas(added, schema).toPandas()  # one model
    shared.unpersist()
    for c, rows, w in zip(got["c"], got["rows"], got["w"], strict=True):
        w = np.frombuffer(w)
        if c < 0:
            at = 0
            for x in small_weights(net, opt):
                x += w[at : at + x.size].reshape(x.shape).astype(np.float32)
                at += x.size
        else:
            r, w = np.frombuffer(rows, np.int64), w.reshape(-1, 2 * DIM).astype(np.float32)
            net.E[r] += w[:, :DIM]
            opt.sums["E"][r] += w[:, DIM:]


def language_counts(table: DataFrame, names: list[str]) -> np.ndarray:
    """(bucket, language): how often all documents have a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column("words").to_pylist()
            ids, first = unpacked(words)
            lang = np.searchsorted(names, np.array(b.column("lang").to_pylist(), object).astype(str))
            key, n = np.unique((ids[:, 3] - 1 - 3 * BUCKETS).astype(np.int64) * len(names) + np.repeat(lang, np.diff(np.append(first, len(ids)))), return_counts=True)
            yield pa.record_batch({"key": key, "n": n.astype(np.int64)})

    got = table.select("words", "lang").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toPandas()  # BUCKETS rows a language
    out = np.zeros(BUCKETS * len(names))
    out[got["key"].to_numpy(np.int64)] = got["n"]
    return out.reshape(BUCKETS, len(names))


def logit_bins(table: DataFrame, net: Net, languages: Languages) -> pd.DataFrame:
    """(guess, aside, bin, n, pos, low, high): all documents by told language and logit, BINS bins a unit."""
    shared = table.sparkSession.sparkContext.broadcast(pickle.dumps((net, languages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, languages = pickle.loads(shared.value)
        for b in batches:
            ids, first = unpacked(b.column("words").to_pylist())
            z = logits(net, ids, first)
            yield pa.record_batch({"guess": languages(ids, first), "aside": b.column("aside"), "z": z, "y": b.column("y")})

    rows = table.select("words", "aside", "y").mapInArrow(run, "guess long, aside boolean, z double, y int")
    return rows.groupBy("guess", "aside", F.floor(F.col("z") * BINS).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"), F.min("z").alias("low"), F.max("z").alias("high")).toPandas()


def best_threshold(bins: pd.DataFrame, common: float | None = None) -> float:
    """The logit between bins with the best F1; of equals, the middle of the widest gap."""
    total, pos = bins["n"].sum(), bins["pos"].sum()
    if pos < LEAST or total - pos < LEAST:
        return 0.0 if common is None else common
    f = bins.groupby("bin").agg(n=("n", "sum"), pos=("pos", "sum"), low=("low", "min"), high=("high", "max")).sort_index(ascending=False)
    low, high = f["low"].to_numpy(), f["high"].to_numpy()
    f1 = 2 * f["pos"].cumsum().to_numpy() / (f["n"].cumsum().to_numpy() + pos)
    gap = np.append(low[:-1] - high[1:], 0)
    f1[gap <= 0] = -1
    top = np.flatnonzero(f1 >= f1.max() - 1e-12)
    i = top[gap[top].argmax()]
    return float((low[i] + high[min(i + 1, len(high) - 1)]) / 2)


def likely_labelled(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """Texts whose id may be among the labels' (h): a set of ID_BITS bits of their hashes spares the shuffle most others; a join must follow."""
    place = lambda h: F.pmod(F.xxhash64(h, F.lit(11)), F.lit(ID_BITS))
    byte = labels.select(place("h").alias("p")).groupBy(F.floor(F.col("p") / 8).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1, cast(p % 8 as int)))").alias("bits"))
    got = byte.toArrow()  # ID_BITS / 8 rows at most, whatever the number of labels
    bits = np.zeros(ID_BITS // 8, np.uint8)
    bits[got["at"].to_numpy()] = got["bits"].to_numpy().astype(np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(bits.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(shared.value, np.uint8)
        for b in batches:
            p = b.column(b.num_columns - 1).to_numpy()
            yield b.filter(pa.array((bits[p >> 3] >> (p & 7) & 1).astype(bool))).select(range(b.num_columns - 1))

    return texts.withColumn("__p", place("h")).mapInArrow(run, texts.schema)


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", lang_col: str | None = "lang", id_col: str = "doc_id") -> bytes | None:
    """A model fitted on all labelled rows of docs, as bytes; None without both classes.

    Of rows that repeat an id one counts. Documents lie in shards by a hash of
    their id, about SHARD_DOCS in each until there are MOST_SHARDS; the network
    is trained by passes over all shards (see ``epoch``). One of four documents
    is kept out of the training; all of these calibrate the thresholds.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    lang = F.col(lang_col) if lang_col else F.lit(None)
    chosen = labels.select(F.col(id_col).alias("h"), (F.col(label_col) == 1).cast("int").alias("y")).where("h is not null and y is not null").groupBy("h").agg(F.min_by("y", F.xxhash64("h", "y")).alias("y"))
    shards = int(min(MOST_SHARDS, max(1, -(-chosen.count() // SHARD_DOCS))))
    texts = docs.select(F.col(id_col).alias("h"), F.col(text_col).alias("text"), F.coalesce(lang.cast("string"), F.lit("")).alias("lang"))
    rows = likely_labelled(texts.where("text is not null"), chosen).join(chosen.hint("merge"), "h").select(F.xxhash64("h").alias("h"), F.xxhash64("text", "lang").alias("t"), "y", "lang", "text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, first = word_ids(*lower_buffer(b.column("text")))
            ends = np.append(first, len(ids))
            packed = [(ids[ends[i] : ends[i + 1]] - 1 - np.arange(FEATURES) * BUCKETS).astype(np.uint16).tobytes() for i in range(b.num_rows)]
            yield pa.record_batch([*b.columns[:4], pa.array(packed, pa.binary())], names=["h", "t", "y", "lang", "words"])

    made = rows.mapInArrow(features, "h long, t long, y int, lang string, words binary")
    made = made.withColumns({"shard": F.pmod("h", F.lit(shards)).cast("int"), "aside": F.pmod(F.xxhash64("h"), F.lit(4)) == 0})
    made = made.repartition(shards, "shard").withColumn("n", F.row_number().over(Window.partitionBy("shard", "h").orderBy("t"))).where("n = 1").drop("n", "t")
    table = written(made.sortWithinPartitions("shard", F.xxhash64("h", F.lit(3))), "toxic-words")
    counts = table.groupBy("aside", "y").count().toPandas()
    if counts["y"].nunique() < 2:
        drop_scratch(table)
        return None
    names = sorted(r[0] for r in table.select("lang").distinct().collect())  # languages
    languages = Languages(language_counts(table, names))
    share = np.array([counts["count"][(counts["y"] == k) & ~counts["aside"]].sum() for k in (0, 1)], np.float32)
    weight = np.sqrt(share.sum() / np.maximum(share, 1)).astype(np.float32)
    net, opt = started(), AdaGrad(RATE)
    for number in range(EPOCHS):
        epoch(table, net, opt, weight, number)
    bins = logit_bins(table, net, languages)
    drop_scratch(table)
    aside = bins[bins["aside"]]
    common = best_threshold(aside, best_threshold(bins))
    shift = np.array([best_threshold(aside[aside["guess"] == k], common) for k in range(len(names))])
    return pickle.dumps((net, languages, shift, names))


def score(docs: DataFrame, model: bytes | None, text_col: str = "text", columns: list[str | Column] = ()) -> DataFrame:
    """score (0 to 1) and predicted (score >= THRESHOLD) for every row, after ``columns``.

    Null and empty texts are scored as texts without words. Without a model
    every score is 0. Very long texts are scored whole; an empty table gives an
    empty table; other columns pass through under their names.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    keep = kept(docs, columns, ["score", "predicted"])
    base = docs.select(*keep)
    if model is None:
        return base.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    shared = spark.sparkContext.broadcast(model)  # the size is fixed by the architecture
    schema = base.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, languages, shift, _ = pickle.loads(shared.value)
        for b in batches:
            ids, first = word_ids(*lower_buffer(b.column(b.num_columns - 1)))
            z = logits(net, ids, first) - shift[languages(ids, first)]
            s = 1 / (1 + np.exp(-np.clip(z + np.log(THRESHOLD / (1 - THRESHOLD)), -60, 60)))
            yield pa.record_batch([*b.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], names=names)

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)

