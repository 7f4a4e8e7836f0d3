"""Seeded hashed features of texts, named values and dense vectors, as sorted places and values of a row."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np

from evidrel.operators.retrieval import gram_keys

#: Buckets of each kind of feature (2^18, a fixed value of the model's format).
BUCKETS = 1 << 18
SEED = 42
WORD = re.compile(r"(?u)\b\w+\b")
#: Places and values of one row.
Row = tuple[np.ndarray, np.ndarray]
#: Rows of the values of a column.
Featurize = Callable[[list], list[Row]]


def unit(places: np.ndarray, counts: np.ndarray) -> Row:
    """Counts that fall in one place are added; the vector has length 1."""
    at, inverse = np.unique(places, return_inverse=True)
    x = np.bincount(inverse, counts, len(at)) if len(at) else np.zeros(0)
    return at, x / np.sqrt(x @ x) if len(at) else x


def word_places(text: str) -> np.ndarray:
    """The bucket of each word and of each pair of neighbouring words of a lower-cased text."""
    words = [w.encode("utf-8", "surrogatepass") for w in WORD.findall(text)]
    one = [zlib.crc32(w, SEED) for w in words]
    return np.array(one + [zlib.crc32(b" " + w, h) for w, h in zip(words[1:], one, strict=False)], np.int64) % BUCKETS


def char_places(text: str) -> Row:
    """The bucket of each word-bound gram of 2 to 4 characters of a lower-cased text, and how often it is there."""
    words = " ".join(text.split())
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    keys, n = gram_keys(f" {words} ")
    x = keys.view(np.uint64) ^ np.uint64(SEED)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64), n.astype(float)


def text_row(text: str | None) -> Row:
    """Word 1- and 2-grams in the first BUCKETS places, character grams in the next; each part of length 1. Null is empty."""
    text = (text or "").lower()
    words = word_places(text)
    a, x = unit(words, np.ones(len(words)))
    b, y = unit(*char_places(text))
    return np.concatenate([a, b + BUCKETS]), np.concatenate([x, y])


def texts(values: list[str | None]) -> list[Row]:
    return [text_row(v) for v in values]


#: Places that texts use.
TEXT_PLACES = 2 * BUCKETS


def named(values: list[dict[str, float] | None]) -> list[Row]:
    """Named values (null: none): a name's bucket holds its value."""
    out = []
    for v in values:
        v = dict(v or {})
        places = np.array([zlib.crc32(k.encode(), SEED) % BUCKETS for k in v], np.int64)
        at, inverse = np.unique(places, return_inverse=True)
        out.append((at, np.bincount(inverse, np.array(list(v.values()), float), len(at)) if len(at) else np.zeros(0)))
    return out


def dense(values: list[list[float] | None]) -> list[Row]:
    """A vector's own places; null components count as 0."""
    out = []
    for v in values:
        x = np.array([0.0 if c is None else c for c in v or []])
        out.append((np.arange(len(x)), x))
    return out
