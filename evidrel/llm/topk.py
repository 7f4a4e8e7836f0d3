"""Exact top-k search with one KD-tree for each part of a shard.

Each task builds the tree of its part (``shards`` says how vectors are dealt):
median splits on the widest side, tight bounding boxes. A query first searches
the part it lies in; its kth score there goes along to the shards whose box can
hold a score as good, where the best-first traversal ends as soon as no box can.

Nearness is the inner product: of a box, the largest possible product bounds it.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame

from evidrel.llm.shards import BLOCK_ROWS, SHARD_ROWS, search

LEAF = 512


class Tree:
    """A KD-tree over the rows of x; boxes are tight."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order, self.lo, self.hi, self.span, self.children = np.arange(len(x)), [], [], [], []
        todo = [(0, len(x), -1)]
        while todo:
            a, b, parent = todo.pop()
            me, rows = len(self.span), x[self.order[a:b]]
            self.lo.append(rows.min(axis=0))
            self.hi.append(rows.max(axis=0))
            self.span.append((a, b))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(me)
            side = (self.hi[me] - self.lo[me]).argmax()
            if b - a > leaf and self.hi[me][side] > self.lo[me][side]:
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(rows[:, side], mid)]
                todo += [(a, a + mid, me), (a + mid, b, me)]
        self.x = x[self.order]
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The largest product of each query with any point of each node's box."""
        return box_bounds(q, self.lo, self.hi)

    def search(self, q: np.ndarray, bound: np.ndarray, ids: np.ndarray, own: int, k: int, kth: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the rows that may be among q's k best, given that k rows elsewhere reach kth."""
        heap, found_s, found_i, n = [(-bound[0], 0)], [], [], 0
        while heap and -heap[0][0] >= kth:
            node = heapq.heappop(heap)[1]
            if self.children[node]:
                for c in self.children[node]:
                    if bound[c] >= kth:
                        heapq.heappush(heap, (-bound[c], c))
                continue
            a, b = self.span[node]
            s = self.x[a:b] @ q
            at = np.flatnonzero(s >= kth)
            at = at[ids[a + at] != own]
            if len(at):
                found_s.append(s[at])
                found_i.append(ids[a + at])
                n += len(at)
                if n >= k:
                    s, i = np.concatenate(found_s), np.concatenate(found_i)
                    if n > 8 * k:  # only the k best by score and id can stay
                        top = np.lexsort((i, -s))[:k]
                        s, i, n = s[top], i[top], k
                    found_s, found_i = [s], [i]
                    kth = max(kth, np.partition(s, len(s) - k)[len(s) - k])
        return (np.concatenate(found_s), np.concatenate(found_i)) if found_s else (np.zeros(0), np.zeros(0, np.int64))


def box_bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The largest product of each query with any point of each box."""
    return np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T


def top_k(vectors: DataFrame, queries: Column, k: int, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner product of each query.

    vectors has (vec_id, v) with finite components; rows that satisfy
    ``queries`` are the queries, every other id of their dimension is a
    candidate. Ties go to the smaller id; fewer than k candidates give all of
    them; of rows that repeat an id the one with the smallest vector takes part;
    other columns are not read. An empty table gives an empty result.
    """

    def work(own: np.ndarray, q: np.ndarray, kth: np.ndarray, ids: np.ndarray, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        tree = Tree(x)
        ids, out = ids[tree.order], []
        for lo in range(0, len(q), 1024):  # bounds of so many queries are held at a time
            bound = tree.bounds(q[lo : lo + 1024])
            for r in range(lo, min(lo + 1024, len(q))):
                s, i = tree.search(q[r], bound[r - lo], ids, own[r], k, kth[r])
                top = np.lexsort((i, -s))[:k]
                out.append((s[top], i[top]))
        return out

    reaches = lambda q, kth, lo, hi: box_bounds(q, lo, hi) >= (kth - 1e-9 * np.abs(np.where(np.isfinite(kth), kth, 0)))[:, None]
    return search(vectors, queries, k, work, lambda x: x, reaches, shard_rows, block_rows)
