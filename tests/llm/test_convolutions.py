"""The tabulated and the blocked convolutions against direct ones, window by window and document by document."""

import numpy as np

from evidrel.llm import langid, toxicity
from evidrel.llm.convnet import new_net


def direct(net, x, positions):
    """Class scores of one sequence of vectors, by the definition: filters at every position, the maximum, the hidden layer."""
    h = []
    for w, W in net.W.items():
        best = np.full(W[0].shape[1], -np.inf)
        for p in range(positions):
            best = np.maximum(best, sum(x[p + k] @ W[k] for k in range(w) if p + k < len(x)))
        h.append(best + net.b[w])
    return np.maximum(np.concatenate(h), 0) @ net.V + net.c


def shaken(net, seed):
    """The network with biases that matter."""
    rng = np.random.default_rng(seed)
    for w in net.b:
        net.b[w] = rng.normal(0, 0.3, net.b[w].shape).astype(np.float32)
    net.c = rng.normal(0, 0.3, net.c.shape).astype(np.float32)
    return net


def test_tabulated_windows_are_direct_convolutions():
    net = shaken(new_net(256, 8, langid.WIDTHS, langid.FILTERS, 4, 3), 1)
    net.E[0] = 0
    rng = np.random.default_rng(2)
    x = rng.integers(1, 256, (70, langid.WINDOW)).astype(np.uint8)
    x[5, 40:] = 0  # a short window
    x[6, 1:] = 0
    got = langid.Scorer(net, ["a", "b", "c", "d"]).window_probabilities(x)
    for row in (0, 5, 6, 31, 63, 64, 69):
        padded = np.concatenate([x[row], np.zeros(max(langid.WIDTHS) - 1, np.uint8)])
        z = direct(net, net.E[padded], langid.WINDOW)
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert np.allclose(got[row], p, atol=1e-4)


def test_blocks_of_words_are_documents_one_by_one():
    rng = np.random.default_rng(4)
    net = shaken(new_net(5000, 8, (1, 2, 3), 12, 2, 5), 6)
    net.E[0] = 0  # empty positions
    sizes = [1, 3, 40, 2, 700, 1, 25]
    ids = rng.integers(1, 5000, (sum(sizes), toxicity.FEATURES))
    first = np.cumsum([0, *sizes[:-1]])
    whole = toxicity.logits(net, ids, first)
    assert np.allclose(whole, toxicity.logits(net, ids, first, block=10), atol=1e-4)
    for d, (a, n) in enumerate(zip(first, sizes, strict=True)):
        own = ids[a : a + n]
        assert np.allclose(whole[d], toxicity.logits(net, own, np.array([0])), atol=1e-4)
        rows, _ = toxicity.padded_rows(own, np.array([0]))
        z = direct(net, net.E[rows].sum(axis=1), len(rows))
        assert np.allclose(whole[d], z[1] - z[0], atol=1e-3)
