"""A small convolutional text classifier in numpy.

A text is a sequence of positions, each with one or more hashed features whose
embeddings are summed. Filters of several widths run over the positions, each
is max-pooled over a segment (a window or a document) and a linear layer gives
class scores. Training follows the pooled maxima back: only the windows that
won a maximum receive a gradient, so updates are sparse.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Net:
    """Weights: E (rows, dim); W by width (width, dim, filters); b; V (filters of all widths, classes); c."""

    E: np.ndarray
    W: dict[int, np.ndarray]
    b: dict[int, np.ndarray]
    V: np.ndarray
    c: np.ndarray

    @property
    def widths(self) -> list[int]:
        return list(self.W)


def new_net(rows: int, dim: int, widths: tuple[int, ...], filters: int, classes: int, seed: int = 0) -> Net:
    rng = np.random.default_rng(seed)
    f32 = np.float32
    return Net(
        (rng.normal(0, 0.3, (rows, dim))).astype(f32),
        {w: rng.normal(0, (w * dim) ** -0.5, (w, dim, filters)).astype(f32) for w in widths},
        {w: np.zeros(filters, f32) for w in widths},
        rng.normal(0, 0.3, (filters * len(widths), classes)).astype(f32),
        np.zeros(classes, f32),
    )


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class AdaGrad:
    """Steps scaled by the root of each weight's summed squared gradients."""

    def __init__(self, rate: float):
        self.rate, self.sums = rate, {}

    def step(self, key, weights: np.ndarray, grad: np.ndarray, rows: np.ndarray | None = None) -> None:
        s = self.sums.setdefault(key, np.full(weights.shape, 1e-6, np.float32))
        if rows is None:
            s += grad * grad
            weights -= self.rate * grad / np.sqrt(s)
        else:
            s[rows] += grad * grad
            weights[rows] -= self.rate * grad / np.sqrt(s[rows])


def pooled(net: Net, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rectified maxima of all filters over each segment, where they were, and the position embeddings.

    ids: (positions, features), row 0 of E being the empty position; starts: the
    first position of each segment. Segments must end with enough empty
    positions that no filter reaches the next one.
    """
    x = net.E[ids[:, 0]]
    for j in range(1, ids.shape[1]):
        x = x + net.E[ids[:, j]]
    n, maxima, where = len(x), [], []
    ends = np.append(starts[1:], n)
    for w, W in net.W.items():
        y = x @ W[0] + net.b[w]
        for k in range(1, w):
            y[: n - k] += x[k:] @ W[k]
        at = np.stack([s + y[s:e].argmax(axis=0) for s, e in zip(starts, ends, strict=True)])
        at = np.minimum(at, n - w)
        maxima.append(y[at, np.arange(y.shape[1])])
        where.append(at)
    return np.maximum(np.hstack(maxima), 0), np.hstack(where), x


def train_step(net: Net, opt: AdaGrad, ids: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 0.0, keep: np.ndarray | None = None) -> float:
    """One step on a batch of segments with classes y; returns the loss before it."""
    h, where, x = pooled(net, ids, starts)
    if keep is not None:
        h = h * keep
    p = softmax(h @ net.V + net.c)
    n = len(y)
    loss = float(-(weight * np.log(p[np.arange(n), y] + 1e-9)).sum() / weight.sum())
    g = p
    g[np.arange(n), y] -= 1
    g *= (weight / weight.sum())[:, None]
    gV, gh = h.T @ g + decay * net.V, (g @ net.V.T) * (h > 0)
    if keep is not None:
        gh = gh * keep
    opt.step("V", net.V, gV)
    opt.step("c", net.c, g.sum(axis=0))
    rows, grads, at = [], [], 0
    for w, W in net.W.items():
        F = W.shape[2]
        gf, pos = gh[:, at : at + F], where[:, at : at + F]
        at += F
        gW = np.zeros_like(W)
        for k in range(w):
            gW[k] = np.einsum("nfd,nf->df", x[pos + k], gf)
            gx = gf[:, :, None] * W[k].T[None]
            keep_rows = np.abs(gf).ravel() > 0
            for j in range(ids.shape[1]):
                rows.append(ids[pos + k, j].ravel()[keep_rows])
                grads.append(gx.reshape(-1, W.shape[1])[keep_rows])
        opt.step(("W", w), W, gW + decay * W)
        opt.step(("b", w), net.b[w], gf.sum(axis=0))
    rows = np.concatenate(rows)
    if len(rows):
        unique, inv = np.unique(rows, return_inverse=True)
        total = np.zeros((len(unique), net.E.shape[1]), np.float32)
        np.add.at(total, inv, np.concatenate(grads))
        real = unique > 0
        unique, total = unique[real], total[real]
        opt.step("E", net.E, total + decay * net.E[unique], unique)
    return loss
