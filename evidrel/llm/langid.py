"""Language identification by a byte convolutional network.

The whole text is cut into fixed-length windows of bytes. Filters of several
widths run over each window, are max-pooled over it, and a softmax gives the
window's language probabilities; a document's are the mean of its windows',
weighted by their bytes. The network is trained in numpy on labelled text, its
weights are a few megabytes at any corpus size, and windows are scored in
batches: a filter's response is a sum of table look-ups by byte pair.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidrel.llm.common import arrow_rows, byte_buffer, hashed_sample, kept
from evidrel.llm.convnet import AdaGrad, Net, new_net, softmax, train_step

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Documents of each language that the fit uses, of all languages together, and windows of each document.
FIT_DOCS, FIT_ALL, FIT_WINDOWS = 300, 48_000, 4
EPOCHS, BATCH, RATE = 5, 32, 0.08
UNDETERMINED = "und"


def windows(data: np.ndarray, offsets: np.ndarray, length: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of a batch of texts (padded with zero bytes), their document and their bytes."""
    sizes = np.diff(offsets)
    counts = -(-sizes // length)
    doc = np.repeat(np.arange(len(sizes)), counts)
    if not len(doc):
        return np.zeros((0, length), np.uint8), doc, doc
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    start, used = offsets[:-1][doc] + nth * length, np.minimum(length, sizes[doc] - nth * length)
    at = start[:, None] + np.arange(length)
    x = data[np.minimum(at, len(data) - 1)]
    x[np.arange(length) >= used[:, None]] = 0
    return x, doc, used


def fit_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """At most ``most`` windows of each text, spread evenly over all of it."""
    for b in batches:
        data, offsets = byte_buffer(b.column("text"))
        x, doc, used = windows(data, offsets)
        keep = []
        for d in range(b.num_rows):
            lo, hi = np.searchsorted(doc, [d, d + 1])
            if hi > lo:
                keep.extend(np.unique(np.linspace(lo, hi - 1, min(most, hi - lo)).round().astype(int)))
        keep = np.array(keep, np.int64)
        yield pa.record_batch(
            [b.column("h").take(pa.array(doc[keep])), b.column("lang").take(pa.array(doc[keep])), pa.array([x[i].tobytes() for i in keep], pa.binary())],
            names=["h", "lang", "window"],
        )


def train(x: np.ndarray, y: np.ndarray, classes: int, seed: int = 0) -> Net:
    """The network fitted to windows x (n, WINDOW) of bytes with classes y."""
    net = new_net(256, 8, WIDTHS, FILTERS, classes, seed)
    net.E[0] = 0
    opt, rng = AdaGrad(RATE), np.random.default_rng(seed)
    share = np.bincount(y, minlength=classes).astype(np.float32)
    weight = (1 / np.maximum(share, 1))[y] * len(y) / classes
    pad = max(WIDTHS) - 1
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), BATCH):
            k = order[i : i + BATCH]
            rows = np.zeros((len(k), WINDOW + pad), np.int64)
            rows[:, :WINDOW] = x[k]
            train_step(net, opt, rows.reshape(-1, 1), np.arange(len(k)) * (WINDOW + pad), y[k], weight[k].astype(np.float32))
    return net


class Scorer:
    """The fitted network with its filter responses tabulated by byte and byte pair."""

    def __init__(self, net: Net, labels: list[str]):
        self.net, self.labels, self.tables = net, labels, {}
        for w, W in net.W.items():
            one = [net.E @ W[k] for k in range(w)]
            two = [(one[k][:, None, :] + one[k + 1][None, :, :]).reshape(65536, -1) for k in range(0, w - 1, 2)]
            self.tables[w] = (two, one[-1] if w % 2 else None)

    def window_probabilities(self, x: np.ndarray, step: int = 64) -> np.ndarray:
        """Class probabilities of windows; positions run along the first axis, so pooling is contiguous."""
        out = np.empty((len(x), len(self.labels)), np.float32)
        n = x.shape[1]
        buffers = np.empty((2, n, step, FILTERS), np.float32)
        for i in range(0, len(x), step):
            part = x[i : i + step].T
            z = np.zeros((n + max(WIDTHS), part.shape[1]), np.intp)
            z[:n] = part
            pair = z[:-1] * 256 + z[1:]
            y, more = buffers[:, :, : part.shape[1]] if part.shape[1] == step else np.empty((2, n, part.shape[1], FILTERS), np.float32)
            h = []
            for w, (two, one) in self.tables.items():
                two[0].take(pair[:n], axis=0, out=y, mode="clip")
                for k in range(1, len(two)):
                    y += two[k].take(pair[2 * k : 2 * k + n], axis=0, out=more, mode="clip")
                if one is not None:
                    y += one.take(z[w - 1 : w - 1 + n], axis=0, out=more, mode="clip")
                h.append(y.max(axis=0) + self.net.b[w])
            out[i : i + step] = softmax(np.maximum(np.hstack(h), 0) @ self.net.V + self.net.c)
        return out

    def documents(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Mean probabilities of each text's windows; zeros for a text without bytes."""
        n = len(offsets) - 1
        total = np.zeros((n, len(self.labels)))
        block = 1 << 20  # bytes of text at a time
        lo = 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + block, "right")) - 1)
            x, doc, used = windows(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            if len(doc):
                p = self.window_probabilities(x) * used[:, None]
                first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                total[lo + doc[first]] = np.add.reduceat(p, first, axis=0) / np.add.reduceat(used, first)[:, None]
            lo = hi
        return total


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", docs: int = FIT_DOCS) -> bytes | None:
    """A scorer fitted on labelled rows, as bytes; None where no row has both text and language.

    The sample is bounded: at most ``docs`` documents of each language chosen by
    a hash of the id (fewer where there are so many languages that they would
    pass FIT_ALL, but one at least), FIT_WINDOWS windows of each.
    """
    arrow_rows(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("text is not null and text != '' and lang is not null")
    languages = rows.select(F.count_distinct("lang")).first()[0]
    rows = hashed_sample(rows, "h", F.col("lang"), max(1, min(docs, FIT_ALL // max(languages, 1)))).select(F.xxhash64("h").alias("h"), "text", F.col("class_value").alias("lang"))
    got = rows.mapInArrow(lambda b: fit_rows(b, FIT_WINDOWS), "h long, lang string, window binary").toPandas()
    if not len(got):
        return None
    got = got.sort_values(["h", "window"], kind="stable")
    labels = sorted(got["lang"].unique())
    x = np.frombuffer(b"".join(got["window"]), np.uint8).reshape(-1, WINDOW)
    y = np.searchsorted(labels, got["lang"].to_numpy(dtype=object).astype(str))
    return pickle.dumps((train(x, y, len(labels)), labels))


def identify(docs: DataFrame, model: bytes | None, text_col: str = "text", columns: list[str | Column] = ()) -> DataFrame:
    """lang_pred and score for every row, after ``columns`` (all of docs' where none are named).

    A text that is null or has no letter gets ``und`` and score 0; so does every
    text where there was nothing to learn from. Very long texts are scored whole,
    a megabyte at a time. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    keep = kept(docs, columns, ["lang_pred", "score"])
    base = docs.select(*keep)
    text = F.when(F.col(text_col).rlike(r"\p{L}"), F.col(text_col))
    rows = docs.select(*keep, text.alias("__text"))
    if model is None:
        return base.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    shared = spark.sparkContext.broadcast(model)  # the size is fixed by the architecture
    schema = base.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    names = [f.name for f in schema]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*pickle.loads(shared.value))
        labels = np.array(scorer.labels, dtype=object)
        for b in batches:
            data, offsets = byte_buffer(b.column(b.num_columns - 1))
            p = scorer.documents(data, offsets)
            some = np.diff(offsets) > 0
            pred = np.where(some, labels[p.argmax(axis=1)], UNDETERMINED)
            best = np.where(some, np.clip(p.max(axis=1), 0, 1), 0.0)
            yield pa.record_batch([*b.columns[:-1], pa.array(pred, pa.string()), pa.array(best, pa.float64())], names=names)

    return rows.mapInArrow(score, schema)
