"""Approximate nearest neighbours by collision counting.

Each part of a shard (``shards`` says how vectors are dealt) keeps one sorted
array for every random projection. A query opens a window around its own value
in all of them; the windows widen step by step in a geometric series (virtual
rehashing: the arrays stay, a wider window is the bucket of a larger radius),
and what a step adds to them is counted. Vectors that lie in enough windows are
verified on the original vectors. The query ends when the windows are so wide
for its kth distance that no nearer vector is likely to lie outside, or when a
share BETA of the part was verified. A query goes on to those shards only whose
values, in enough projections, come into the windows that its kth distance asks
for.

Largest inner product becomes nearest point by one more component that gives
all vectors the same length.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidrel.llm.shards import BLOCK_ROWS, SHARD_ROWS, search

PROJECTIONS = 48
#: Half width of the first windows, for vectors of length 1, and how much wider each step is.
FIRST, STEP = 0.3, 1.3
#: Windows that a vector must lie in, as a share of all.
ALPHA = 0.9
#: Share of a part whose verification ends a query.
BETA = 0.3
#: A window this many times as wide as the kth distance holds nearer vectors almost always.
SURE = 2.1


def directions(d: int, seed: int = 11) -> np.ndarray:
    """Random directions for vectors of d components and the added one."""
    return np.random.default_rng(seed).normal(size=(d + 1, PROJECTIONS))


def projected(x: np.ndarray, longest: float) -> np.ndarray:
    extra = np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))
    return (np.hstack([x, extra[:, None]]) / longest) @ directions(x.shape[1])


def distance(kth: np.ndarray | float, q: np.ndarray, longest: float) -> np.ndarray:
    """Of the kth score of each query, as a distance between vectors of length 1; infinite without k scores."""
    length = longest * np.linalg.norm(q, axis=-1)
    return np.where(np.isfinite(kth), np.sqrt(np.maximum(0.0, 2 - 2 * np.where(np.isfinite(kth), kth, 0) / length)), np.inf)


def collision_search(own: np.ndarray, q: np.ndarray, kth: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, longest: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the scores and ids of its k best verified rows; kth: scores that k rows elsewhere reach."""
    n, d = x.shape
    at = projected(x, longest)
    order, values = np.argsort(at, axis=0).T.copy(), np.sort(at, axis=0).T.copy()
    mine = (q / np.linalg.norm(q, axis=1)[:, None]) @ directions(d)[:d]
    need, out = int(np.ceil(ALPHA * PROJECTIONS)), []
    widths = np.array([FIRST * STEP**i for i in range(64) if i == 0 or FIRST * STEP ** (i - 1) < np.abs(values).max() + np.abs(mine).max()])
    norms = longest * np.linalg.norm(q, axis=1)
    for first in range(0, len(q), 128):  # the windows of so many queries are held at a time
        m = mine[first : first + 128]
        low, high = np.empty((2, PROJECTIONS, len(m), len(widths)), np.int64)
        for j in range(PROJECTIONS):
            low[j] = np.searchsorted(values[j], m[:, j, None] - widths)
            high[j] = np.searchsorted(values[j], m[:, j, None] + widths, "right")
        for i in range(first, first + len(m)):
            count, seen, ended = np.zeros(n, np.int64), np.zeros(n, bool), False
            score, rows, best = np.zeros(0), np.zeros(0, np.int64), float(kth[i])
            lo = hi = np.zeros(0, np.int64)
            for step, w in enumerate(widths.tolist()):
                new_lo, new_hi = low[:, i - first, step], high[:, i - first, step]
                if step:  # what the wider windows add on either side
                    spans = [*zip(range(PROJECTIONS), new_lo.tolist(), lo.tolist(), strict=True), *zip(range(PROJECTIONS), hi.tolist(), new_hi.tolist(), strict=True)]
                else:
                    spans = list(zip(range(PROJECTIONS), new_lo.tolist(), new_hi.tolist(), strict=True))
                lo, hi = new_lo, new_hi
                parts = [order[j, a:b] for j, a, b in spans if b > a]
                if parts:
                    count += np.bincount(np.concatenate(parts), minlength=n)
                new = np.flatnonzero((count >= need) & ~seen)
                if len(new):
                    seen[new] = True
                    other = new[ids[new] != own[i]]
                    score, rows = np.concatenate([score, x[other] @ q[i]]), np.concatenate([rows, other])
                    if len(score) >= k:
                        best = max(best, float(np.partition(score, len(score) - k)[len(score) - k]))
                far = math.sqrt(max(0.0, 2 - 2 * best / norms[i])) if best > -math.inf else math.inf
                if w >= SURE * far or len(score) >= max(BETA * n, k):
                    ended = True
                    break
            if not ended and len(score) < k:  # too few collisions at any radius: the rest is verified too
                rows = np.flatnonzero(ids != own[i])
                score = x[rows] @ q[i]
            top = np.lexsort((ids[rows], -score))[:k]
            out.append((score[top], ids[rows][top]))
    return out


def reaches(q: np.ndarray, kth: np.ndarray, lo: np.ndarray, hi: np.ndarray, longest: float) -> np.ndarray:
    """Whether the values of a shard come into enough windows of a query, at the width that its kth distance asks for."""
    mine, width = (q / np.linalg.norm(q, axis=1)[:, None]) @ directions(q.shape[1])[: q.shape[1]], SURE * distance(kth, q, longest)
    out = np.empty((len(q), len(lo)), bool)
    for i in range(len(q)):
        out[i] = ((mine[i] + width[i] >= lo) & (mine[i] - width[i] <= hi)).sum(axis=1) >= np.ceil(ALPHA * PROJECTIONS)
    return out


def nearest(vectors: DataFrame, queries: Column, k: int, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): about the k largest inner products of each query.

    vectors has (vec_id, v) with finite components, not all zero; every id is
    indexed. Ties go to the smaller id among the rows found; fewer than k
    candidates are all returned; of rows that repeat an id the one with the
    smallest vector takes part; other columns are not read. Scores are exact. An
    empty table gives an empty result.
    """
    longest = vectors.agg(F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).alias("m")).first()["m"] or 1.0
    longest *= 1 + 1e-9
    work = lambda own, q, kth, ids, x: collision_search(own, q, kth, ids, x, k, longest)
    return search(vectors, queries, k, work, lambda x: projected(x, longest), lambda q, kth, lo, hi: reaches(q, kth, lo, hi, longest), shard_rows, block_rows)
