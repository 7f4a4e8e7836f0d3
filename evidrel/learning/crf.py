"""A linear-chain conditional random field over the characters of a text: where mentions begin and go on.

Each character has hashed features of itself and its two neighbours on either
side. Training minimises the negative log-likelihood of tagged rows with
absolute and squared penalties by a quasi-Newton method that keeps to one orthant
a step; every evaluation is a Spark job that sums exact forward-backward
gradients over the tasks. Decoding is Viterbi, in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidrel.learning.vectors import MOST_TASKS, SCHEMA, chunks, summed
from evidrel.sources.batches import small_batches
from evidrel.sources.scratch import dropped, written

TAGS = ["O", "B-ENT", "I-ENT"]
#: Buckets of character features; places 0 to FLAGS - 1 are the flags', BUCKETS holds what is absent.
BUCKETS, SEED = 1 << 16, 42
OFFSETS = (-2, -1, 0, 1, 2)
FLAGS = 2 * len(OFFSETS) + 5
#: Absolute and squared penalty.
C1, C2 = 0.1, 0.1
ITERATIONS, TOLERANCE, MEMORY = 60, 1e-4, 6
#: Texts of a task, until there are as many tasks as vectors may be summed of.
TASK_ROWS = 2000
#: Characters of texts that are taken through the chain together.
BLOCK_CHARS = 1 << 18


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The places of the features of all characters of some texts, (characters, features), absent ones BUCKETS; and the texts' lengths."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    first, last = np.repeat(ends - sizes, sizes), np.repeat(ends - 1, sizes)
    known, at = np.unique(codes, return_inverse=True)
    chars = [chr(c) for c in known]
    kind = np.array([(c.isdigit(), c.isalpha(), c.isupper(), c.isspace()) for c in chars], bool).reshape(-1, 4)[at]
    n = len(codes)
    out, here = np.full((n, FLAGS + len(OFFSETS)), BUCKETS, np.int64), np.arange(n)
    for k, o in enumerate(OFFSETS):
        ok = (here + o >= first) & (here + o <= last)
        row, there = here[ok], here[ok] + o
        mixed = (codes[there].astype(np.uint64) + np.uint64((SEED + k) << 32)) * np.uint64(0x9E3779B97F4A7C15)
        out[row, k] = FLAGS + ((mixed >> np.uint64(24)) % np.uint64(BUCKETS - FLAGS)).astype(np.int64)
        for flag in (0, 1):  # a digit, a letter
            out[row, 5 + 2 * k + flag] = np.where(kind[there, flag], 2 * k + flag, BUCKETS)
    base = 2 * len(OFFSETS)
    out[:, 15] = base  # every character
    out[:, 16] = np.where(kind[:, 2], base + 1, BUCKETS)
    out[:, 17] = np.where(kind[:, 3], base + 2, BUCKETS)
    out[:, 18] = np.where(here == first, base + 3, BUCKETS)
    out[:, 19] = np.where(here == last, base + 4, BUCKETS)
    return out, sizes


def tags_of(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """The tag of each of n characters; spans out of range or empty do not count, later ones overwrite."""
    out = np.zeros(n, np.int64)
    for a, b in spans:
        if 0 <= a < b <= n:
            out[a], out[a + 1 : b] = 1, 2
    return out


@dataclass
class Chain:
    """emit[place, tag] (the last place is 0) and move[tag, next tag]."""

    emit: np.ndarray
    move: np.ndarray

    @classmethod
    def of(cls, w: np.ndarray) -> Chain:
        emit = np.zeros((BUCKETS + 1, len(TAGS)))
        emit[:BUCKETS] = w[: BUCKETS * len(TAGS)].reshape(BUCKETS, len(TAGS))
        return cls(emit, w[BUCKETS * len(TAGS) :].reshape(len(TAGS), len(TAGS)))

    def scores(self, places: np.ndarray) -> np.ndarray:
        return self.emit[places].sum(axis=1)

    def batch(self, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores of texts' characters, padded to the longest: (texts, characters, tags)."""
        u = np.zeros((len(sizes), int(sizes.max(initial=0)), len(TAGS)))
        u[np.arange(u.shape[1]) < sizes[:, None]] = self.scores(places)
        return u

    def marginals(self, u: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log Z of each text, the tags' and the neighbouring tags' probabilities (0 beyond a text's end)."""
        n, length, k = u.shape
        a, b = np.zeros_like(u), np.zeros_like(u)
        both = np.zeros((n, max(length - 1, 0), k, k))
        if length:
            a[:, 0] = u[:, 0]
        for t in range(1, length):
            x = a[:, t - 1, :, None] + self.move
            a[:, t] = np.where((t < sizes)[:, None], np.logaddexp.reduce(x, axis=1) + u[:, t], a[:, t - 1])
        for t in range(length - 2, -1, -1):
            x = self.move + (u[:, t + 1] + b[:, t + 1])[:, None, :]
            b[:, t] = np.where((t + 1 < sizes)[:, None], np.logaddexp.reduce(x, axis=2), 0.0)
        z = np.logaddexp.reduce(a[:, -1], axis=1) if length else np.zeros(n)
        live = np.arange(length) < sizes[:, None]
        one = np.where(live[:, :, None], np.exp(np.minimum(a + b - z[:, None, None], 0)), 0)
        for t in range(length - 1):
            x = a[:, t, :, None] + self.move + (u[:, t + 1] + b[:, t + 1])[:, None, :] - z[:, None, None]
            both[:, t] = np.where((t + 1 < sizes)[:, None, None], np.exp(np.minimum(x, 0)), 0)
        return z, one, both

    def viterbi(self, u: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """The best tags of each text; of equal ones the tag first in order, from the end on."""
        n, length, k = u.shape
        best, back = u[:, 0].copy() if length else np.zeros((n, k)), np.zeros((n, length, k), np.int64)
        for t in range(1, length):
            x = best[:, :, None] + self.move
            back[:, t] = x.argmax(axis=1)
            best = np.where((t < sizes)[:, None], x.max(axis=1) + u[:, t], best)
        out = []
        for r in range(n):
            tags, at = np.zeros(sizes[r], np.int64), int(best[r].argmax())
            for t in range(sizes[r] - 1, -1, -1):
                tags[t] = at
                at = back[r, t, at]
            out.append(tags)
        return out


def loss_and_slope(chain: Chain, places: np.ndarray, sizes: np.ndarray, tags: list[np.ndarray], times: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Negative log-likelihood of tagged texts (without penalties), each as often as ``times`` says (else once), and its gradient by all weights."""
    k, times = len(TAGS), np.ones(len(sizes)) if times is None else times
    u = chain.batch(places, sizes)
    z, one, both = chain.marginals(u, sizes)
    live = np.arange(u.shape[1]) < sizes[:, None]
    y, at = np.zeros(live.shape, np.int64), np.nonzero(live)
    y[live] = np.concatenate([np.zeros(0, np.int64), *tags])
    one[at[0], at[1], y[live]] -= 1
    loss = float(times @ z) - times[at[0]] @ u[at[0], at[1], y[live]]
    pairs = np.nonzero(live[:, 1:])
    steps = np.bincount(y[pairs[0], pairs[1]] * k + y[pairs[0], pairs[1] + 1], times[pairs[0]], k * k).reshape(k, k)
    move = np.tensordot(times, both.sum(axis=1), 1) - steps
    loss -= (chain.move * steps).sum()
    over, grid = one[live] * times[at[0], None], np.empty((BUCKETS + 1, k))
    for tag in range(k):
        grid[:, tag] = np.bincount(places.ravel(), np.repeat(over[:, tag], places.shape[1]), BUCKETS + 1)
    return loss, np.concatenate([grid[:BUCKETS].ravel(), move.ravel()])


SIZE = BUCKETS * len(TAGS) + len(TAGS) ** 2


def _blocks(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about BLOCK_CHARS characters when padded; a longer text is alone."""
    lo = 0
    while lo < len(lengths):
        hi, widest = lo + 1, lengths[lo]
        while hi < len(lengths) and max(widest, lengths[hi]) * (hi + 1 - lo) <= BLOCK_CHARS:
            widest, hi = max(widest, lengths[hi]), hi + 1
        yield lo, hi
        lo = hi


def evaluated(rows: DataFrame, w: np.ndarray) -> tuple[float, np.ndarray]:
    """Loss and gradient over all rows (text, spans: array of start and stop, times: how many rows they stand for)."""
    shared = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, total, loss = Chain.of(shared.value), np.zeros(SIZE), 0.0
        for b in batches:
            texts, spans, times = b.column("text").to_pylist(), b.column("spans").to_pylist(), np.array(b.column("times").to_pylist(), float)
            for lo, hi in _blocks([len(t or "") for t in texts]):
                places, sizes = features([t or "" for t in texts[lo:hi]])
                tags = [tags_of(n, [(x["start"], x["stop"]) for x in s or []]) for n, s in zip(sizes, spans[lo:hi], strict=True)]
                more, slope = loss_and_slope(chain, places, sizes, tags, times[lo:hi])
                loss, total = loss + more, total + slope
        yield from chunks(0, total, loss)

    total, loss = summed(rows.select("text", "spans", "times").mapInArrow(run, SCHEMA))
    shared.unpersist()
    return (loss, total[0]) if len(total) else (0.0, np.zeros(SIZE))


def minimised(f: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, c1: float, c2: float, iterations: int, tolerance: float) -> tuple[np.ndarray, list[float]]:
    """w that makes f(w) + c1 |w| + c2 w'w small, and the objective after each step.

    Limited-memory quasi-Newton steps on the pseudo-gradient; a step's weights
    stay in the orthant that the step begins in.
    """

    def whole(w: np.ndarray) -> tuple[float, np.ndarray]:
        loss, slope = f(w)
        return loss + c2 * w @ w + c1 * np.abs(w).sum(), slope + 2 * c2 * w

    def pseudo(w: np.ndarray, g: np.ndarray) -> np.ndarray:
        up, down = g + c1, g - c1
        return np.where(w > 0, up, np.where(w < 0, down, np.where(up < 0, up, np.where(down > 0, down, 0))))

    (value, g), past, trace = whole(w), [], []
    for _ in range(iterations):
        p = pseudo(w, g)
        if not np.abs(p).max(initial=0) > 1e-9:
            break
        d, kept = -p, []
        for s, y in reversed(past):
            a = (s @ d) / (s @ y)
            kept.append(a)
            d = d - a * y
        if past:
            s, y = past[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(kept), strict=True):
            d = d + s * (a - (y @ d) / (s @ y))
        d = np.where(d * p < 0, d, 0)
        orthant = np.where(w != 0, np.sign(w), -np.sign(p))
        step = 1.0 if past else 1 / max(np.sqrt(p @ p), 1e-12)
        while True:
            new = w + step * d
            new = np.where(new * orthant > 0, new, 0)
            now, h = whole(new)
            if now <= value + 1e-4 * (p @ (new - w)) or step < 1e-10:
                break
            step /= 2
        s, y = new - w, h - g
        if s @ y > 1e-12:
            past = [*past[-(MEMORY - 1) :], (s, y)]
        done = value - now < tolerance * max(abs(now), 1)
        w, g, value = new, h, min(now, value)
        trace.append(value)
        if done:
            break
    return w, trace


def fit(rows: DataFrame, text: str | Column, spans: str | Column, iterations: int = ITERATIONS, tolerance: float = TOLERANCE, c1: float = C1, c2: float = C2) -> tuple[Chain, list[float]]:
    """A chain from rows with a text and its mentions (array of start and stop); and the objective step by step.

    Null and empty texts count for nothing, null spans are none. Without rows all weights are 0.
    Rows of one text and the same spans are taken through the chain once and count as often as they are there.
    """
    text, spans = (F.col(c) if isinstance(c, str) else c for c in (text, spans))
    small_batches(rows.sparkSession)
    each = rows.select(text.alias("text"), F.transform(spans, lambda s: F.struct(s["start"].cast("int").alias("start"), s["stop"].cast("int").alias("stop"))).alias("spans")).where(F.length("text") > 0)
    table = written(each.groupBy("text", "spans").agg(F.count(F.lit(1)).alias("times")), "crf-rows")
    dealt = written(table.repartition(int(min(MOST_TASKS, max(1, -(-table.count() // TASK_ROWS))))), "crf-dealt").coalesce(MOST_TASKS)
    dropped(table)
    w, trace = minimised(lambda w: evaluated(dealt, w), np.zeros(SIZE), c1, c2, iterations, tolerance)
    dropped(dealt)
    return Chain.of(w), trace


def spans_of(text: str, tags: np.ndarray) -> list[dict]:
    """Mentions in order: a B begins one, I goes on; an I without one before it is none, nor is blank text."""
    out, start = [], -1
    for i, t in enumerate([*tags.tolist(), 0]):
        if start >= 0 and t != 2:
            if text[start:i].strip():
                out.append({"start": start, "stop": i, "text": text[start:i]})
            start = -1
        if t == 1:
            start = i
    return out


MENTIONS = "array<struct<start:int,stop:int,text:string>>"


def mentions(rows: DataFrame, chain: Chain, text: str | Column, out: str = "mentions") -> DataFrame:
    """rows with the mentions that the chain finds in each text (null and empty: none)."""
    text = F.col(text) if isinstance(text, str) else text
    keep = [c for c in rows.columns if c != out]
    schema = rows.select(*keep).withColumn(out, F.array().cast(MENTIONS)).schema
    shared, names = rows.sparkSession.sparkContext.broadcast(chain), [f.name for f in schema]
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            texts, found = [t or "" for t in b.column(b.num_columns - 1).to_pylist()], []
            for lo, hi in _blocks([len(t) for t in texts]):
                places, sizes = features(texts[lo:hi])
                tags = c.viterbi(c.batch(places, sizes), sizes)
                found += [spans_of(t, y) for t, y in zip(texts[lo:hi], tags, strict=True)]
            yield pa.record_batch([*b.columns[:-1], pa.array(found, kind)], names=names)

    return rows.select(*keep, text.alias("__text")).mapInArrow(run, schema)
