"""Byte-level BPE by dynamic programming over byte prefixes.

Every prefix of a byte string has one encoding, so one last token. Token t is
the last one of a prefix exactly where the last token of what precedes t and t
are a pair that merging leaves apart. One pass of an Aho-Corasick automaton over
the tokens offers, at each byte, the tokens that end there; the one that fits is
stored. The stored last tokens spell out the encoding of every prefix, so bytes
may be appended without a look at those before (but for one token's length), and
after an edit only the matches near it are encoded again.

Texts are first cut by a pattern, each match encoded alone, as the vocabulary's
own library does. A match that is a token as a whole is that token.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidrel.llm.common import arrow_rows, kept

#: Matches in a generation of the cache (there are two) and the longest that enters it; pairs of tokens in the other cache.
CACHE, CACHED_CHARS, PAIRS = 300_000, 48, 1 << 18
#: Characters that the pattern reads at a time.
BLOCK_CHARS = 1 << 20
#: How far the pattern looks ahead to choose an alternative (its longest contraction).
AHEAD = 3


def merged(raw: bytes, ranks: dict[bytes, int]) -> tuple[list[int], tuple[int, int] | None]:
    """What merging makes of a byte string: the tokens and the pair merged last. The least rank goes first, of equal ones the leftmost."""
    parts, last = [raw[i : i + 1] for i in range(len(raw))], None
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], len(ranks) + 1 << 32), i) for i in range(len(parts) - 1))
        if parts[i] + parts[i + 1] not in ranks:
            break
        last = ranks[parts[i]], ranks[parts[i + 1]]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts], last


class Model:
    """A vocabulary as it goes to the tasks: each token's bytes, the pair it is made of (-1: a byte; -2: merging never makes it), the pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.tokens = [b""] * (max(ranks.values()) + 1)
        self.left, self.right = np.full(len(self.tokens), -2, np.int32), np.full(len(self.tokens), -2, np.int32)
        for raw, i in ranks.items():
            self.tokens[i] = raw
            got, pair = merged(raw, ranks)
            if got == [i]:
                self.left[i], self.right[i] = pair or (-1, -1)


def read_model(path: str, pattern: str) -> Model:
    """A file of base64 tokens and ranks, read by the driver; a vocabulary does not grow with the data."""
    with open(path, "rb") as f:
        return Model({base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}, pattern)


class Matches(dict):
    """Token ids (as 32-bit integers) of recurring matches; when full, those asked for since it was last full stay."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.before = codec, {}

    def __missing__(self, match: str) -> bytes:
        ids = self.before.get(match)
        if ids is None:
            ids = array("i", self.codec.match_ids(match.encode("utf-8", "surrogatepass"))).tobytes()
        if len(match) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.before = dict(self)
                self.clear()
            self[match] = ids
        return ids


class Codec:
    def __init__(self, model: Model):
        self.tokens, self.left, self.right = model.tokens, model.left.tolist(), model.right.tolist()
        self.ids = {raw: i for i, raw in enumerate(self.tokens) if raw}
        self.made = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right, strict=True)) if a >= 0}
        # the pattern's library reads \s as the Unicode property
        self.pattern = regex.compile(model.pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.longest = max(map(len, self.tokens))
        self.raw, self.sizes = np.frombuffer(b"".join(self.tokens), np.uint8), np.array([*map(len, self.tokens), 0])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.automaton = ahocorasick.Automaton()
        for i, raw in enumerate(self.tokens):
            if raw and self.left[i] != -2:
                self.automaton.add_word(raw.decode("latin-1"), (len(raw), i))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.cache = Matches(self)

    def apart(self, a: int, b: int) -> bool:
        """Whether merging leaves two neighbouring tokens as they are.

        Their merges are undone from the last to the first; each state shows the
        two tokens that then stood at the border. Had these a merge that comes
        before the one just undone, the border would have gone.
        """
        x, y, bound, out = a, b, len(self.tokens), True
        while True:
            over = self.made.get((x, y))
            if over is not None and over < bound:
                out = False
                break
            if self.left[x] < 0 and self.left[y] < 0:
                break
            # of equal merges the left one comes first: the right one is undone first, and one at the border comes before it
            if self.left[y] >= 0 and (y >= x or self.left[x] < 0):
                bound, y = y + 1, self.left[y]
            else:
                bound, x = x, self.right[x]
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[a << 32 | b] = out
        return out

    def prefixes(self, raw: bytes, last: list[int] = ()) -> list[int]:
        """The last token of each prefix of raw (place 0: none), going on from those of its first bytes where given."""
        last = list(last) or [-1]
        done, pairs = len(last) - 1, self.pairs
        begin = max(0, done - self.longest)
        last += [-1] * (len(raw) - done)
        for end, (size, i) in self.automaton.iter(raw[begin:].decode("latin-1")):
            end += begin + 1
            if end > done and last[end] < 0:
                start = end - size
                if start <= 0:
                    fits = start == 0
                else:
                    fits = pairs.get(last[start] << 32 | i)
                    if fits is None:
                        fits = self.apart(last[start], i)
                if fits:
                    last[end] = i
        return last

    def spelled(self, last: list[int], end: int) -> list[int]:
        """The tokens of the prefix of that many bytes."""
        out, tokens = [], self.tokens
        while end:
            out.append(last[end])
            end -= len(tokens[last[end]])
        out.reverse()
        return out

    def match_ids(self, raw: bytes) -> list[int]:
        whole = self.ids.get(raw)
        return [whole] if whole is not None else self.spelled(self.prefixes(raw), len(raw))

    def matches(self, text: str, at: int = 0) -> Iterator[list[str]]:
        """The matches from a place on where one begins, in lists of bounded size unless one match is longer."""
        size = BLOCK_CHARS
        while at < len(text):
            stop = min(len(text), at + size)
            found = self.pattern.findall(text, at, stop)
            end = at + sum(map(len, found))
            if stop < len(text):
                while found and end > stop - AHEAD:  # what follows could change these
                    end -= len(found.pop())
            size = BLOCK_CHARS if found else 2 * size
            if found:
                yield found
            at = end

    def encode(self, text: str) -> array:
        ids, get = array("i"), self.cache.__getitem__
        for some in self.matches(text):
            ids.frombytes(b"".join(map(get, some)))
        return ids

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, one after the other, and where each id's end; ids that are no token have none."""
        ids = np.where((ids >= 0) & (ids < len(self.tokens)), ids, len(self.tokens))
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return self.raw[np.repeat(self.starts[ids] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)], ends

    def state(self, text: str) -> tuple[array, array]:
        """The character at which each match begins, and the last token of each byte prefix of every match, one after the other."""
        starts, lasts, at = array("i"), array("i"), 0
        for some in self.matches(text):
            for m in some:
                starts.append(at)
                at += len(m)
                lasts.extend(self.prefixes(m.encode("utf-8", "surrogatepass"))[1:])
        return starts, lasts

    def state_ids(self, text: str, starts: array, lasts: array) -> array:
        """The token ids that a state spells out."""
        ids, at = array("i"), 0
        for k, s in enumerate(starts):
            raw = text[s : starts[k + 1] if k + 1 < len(starts) else len(text)].encode("utf-8", "surrogatepass")
            whole = self.ids.get(raw)
            ids.extend([whole] if whole is not None else self.spelled([-1, *lasts[at : at + len(raw)]], len(raw)))
            at += len(raw)
        return ids

    def edited(self, text: str, starts: array, lasts: array, a: int, b: int, new: str) -> tuple[str, array, array, int]:
        """Text, state and bytes encoded anew after text[a:b] became new.

        Matches that end well before the edit stay; those from the first old
        begin of a match behind the edit on stay too. The match that the edit
        lies in keeps the last tokens of the bytes before it.
        """
        out, shift = text[:a] + new + text[b:], len(new) - (b - a)
        ends = [*starts[1:], len(text)]
        keep = int(np.searchsorted(np.array(ends, np.int64), a - AHEAD, "right"))  # matches that end at most there
        keep = min(keep, len(starts))
        at = starts[keep] if keep < len(starts) else len(text)
        size = lambda lo, hi: len(text[lo:hi].encode("utf-8", "surrogatepass"))
        behind, old = size(0, at), {s: k for k, s in enumerate(starts) if s >= b}
        # bytes of old matches that lie before the edit, by the place where the match begins
        s2, l2, work = starts[:keep], lasts[:behind], 0
        known = {starts[k]: k for k in range(keep, len(starts)) if starts[k] < a}
        while at < len(out):
            k = old.get(at - shift) if at >= a + len(new) else None
            if k is not None:
                rest = size(0, starts[k])
                s2.extend([s + shift for s in starts[k:]])
                l2.extend(lasts[rest:])
                break
            m = self.pattern.match(out, at).group()
            raw, last = m.encode("utf-8", "surrogatepass"), ()
            k = known.get(at)
            if k is not None:
                first = size(0, at)
                same = size(at, min(a, ends[k], at + len(m)))
                last = [-1, *lasts[first : first + same]]
                work -= same
            l2.extend(self.prefixes(raw, last)[1:])
            s2.append(at)
            work += len(raw)
            at += len(m)
        return out, s2, l2, work


@lru_cache(maxsize=2)
def codec(model: Model) -> Codec:
    """The codec of a broadcast model, made once a worker."""
    return Codec(model)


def _lists(rows: list[array]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(map(bytes, rows)), np.int32)))


def encode(docs: DataFrame, model: Model, text_col: str = "text", columns: list[str | Column] = (), out: str = "token_ids") -> DataFrame:
    """``columns`` (all of docs' where none are named) and an array of token ids.

    Whole texts are encoded, of any length; null and empty texts give an empty
    array; rows that repeat an id or a text give equal arrays; an empty table
    gives an empty table; a column named as ``out`` is replaced.
    """
    arrow_rows(docs.sparkSession)
    keep = kept(docs, columns, [out])
    schema = docs.select(*keep).withColumn(out, F.array().cast("array<int>")).schema
    shared, names = docs.sparkSession.sparkContext.broadcast(model), [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for b in batches:
            ids = [c.encode(t or "") for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.record_batch([*b.columns[:-1], _lists(ids)], names=names)

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def decode(rows: DataFrame, model: Model, ids_col: str = "token_ids", columns: list[str | Column] = (), out: str = "decoded") -> DataFrame:
    """``columns`` and the bytes of each array of token ids; null and empty arrays give no bytes, ids that are no token are left out."""
    arrow_rows(rows.sparkSession)
    keep = kept(rows, columns, [out])
    schema = rows.select(*keep).withColumn(out, F.lit(b"")).schema
    shared, names = rows.sparkSession.sparkContext.broadcast(model), [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for b in batches:
            ids = b.column(b.num_columns - 1)
            known = ids.flatten()
            raw, ends = c.decode(known.fill_null(-1).to_numpy(zero_copy_only=False))
            rows_end = np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            stops = np.concatenate([[0], np.concatenate([[0], ends])[rows_end]]).astype(np.int32)
            yield pa.record_batch([*b.columns[:-1], pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(stops), pa.py_buffer(raw)])], names=names)

    return rows.select(*keep, F.col(ids_col).alias("__ids")).mapInArrow(run, schema)


def prefix_states(docs: DataFrame, model: Model, text_col: str = "text", columns: list[str | Column] = ()) -> DataFrame:
    """``columns`` and what ``revise`` needs: match_starts (characters) and last_tokens (one a byte). Null and empty texts have empty arrays."""
    arrow_rows(docs.sparkSession)
    keep = kept(docs, columns, ["match_starts", "last_tokens"])
    none = F.array().cast("array<int>")
    schema = docs.select(*keep).withColumns({"match_starts": none, "last_tokens": none}).schema
    shared, names = docs.sparkSession.sparkContext.broadcast(model), [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for b in batches:
            got = [c.state(t or "") for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.record_batch([*b.columns[:-1], _lists([s for s, _ in got]), _lists([x for _, x in got])], names=names)

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def revise(rows: DataFrame, model: Model) -> DataFrame:
    """Texts after an edit, their states, token ids and how many bytes were encoded anew.

    rows: text, match_starts and last_tokens of ``prefix_states``, and an edit:
    characters edit_from to edit_to (exclusive) become edit_text; an append has
    both at the text's end. Null text and null edit_text count as empty, a null
    edit_from as the end, a null edit_to as edit_from; places beyond the text
    count as its end. Other columns stay; the edit's columns go.
    """
    arrow_rows(rows.sparkSession)
    used = ["text", "match_starts", "last_tokens", "edit_from", "edit_to", "edit_text"]
    keep = kept(rows, [], [*used, "token_ids", "bytes_encoded"])
    ints = F.array().cast("array<int>")
    schema = rows.select(*keep, F.lit("").alias("text"), ints.alias("match_starts"), ints.alias("last_tokens"), ints.alias("token_ids"), F.lit(0).cast("long").alias("bytes_encoded")).schema
    shared, names = rows.sparkSession.sparkContext.broadcast(model), [f.name for f in schema]

    def one(c: Codec, text, starts, lasts, a, b, new) -> tuple:
        text = text or ""
        a = len(text) if a is None else min(max(a, 0), len(text))
        b = a if b is None else min(max(b, a), len(text))
        text, starts, lasts, work = c.edited(text, array("i", starts or []), array("i", lasts or []), a, b, new or "")
        return text, starts, lasts, c.state_ids(text, starts, lasts), work

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for b in batches:
            got = [one(c, *r) for r in zip(*[b.column(k).to_pylist() for k in range(b.num_columns - len(used), b.num_columns)], strict=True)]
            made = [pa.array([g[0] for g in got], pa.string()), *[_lists([g[k] for g in got]) for k in (1, 2, 3)], pa.array([g[4] for g in got], pa.int64())]
            yield pa.record_batch([*b.columns[: -len(used)], *made], names=names)

    return rows.select(*keep, *used).mapInArrow(run, schema)
