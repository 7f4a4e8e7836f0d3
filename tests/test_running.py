"""A task's running best rows of each group."""

import random

import numpy as np

from evidrel.operators.retrieval import Running


def test_the_best_of_each_group_are_kept_and_little_else():
    rng = random.Random(2)
    best, rows = Running(3, 5), []
    best.most = 40
    for _ in range(200):
        block = [(rng.randrange(3), rng.randrange(10**6), rng.choice([round(rng.random(), 6), 0.5])) for _ in range(20)]
        rows += block
        best.add(*(np.array(c) for c in zip(*block, strict=True)))
    group, ids, score = best.rows()
    got = set(zip(group.tolist(), ids.tolist(), strict=True))
    for g in range(3):
        want = sorted((-np.floor(s * 1e4 + 0.5), i) for h, i, s in rows if h == g)[:5]
        assert {(g, i) for _, i in want} <= got
    assert len(group) < 40


def test_many_equal_rows_are_not_all_held():
    best = Running(1, 3)
    for k in range(50):
        best.add(np.zeros(5000, np.int64), np.arange(5000) + 5000 * (49 - k), np.full(5000, 0.25))
    assert best.rows()[1].tolist() == [0, 1, 2]
    empty = Running(4, 3).rows()
    assert all(len(c) == 0 for c in empty)
