"""SentencePiece encoding and decoding with one automaton and one Viterbi pass.

The pieces of a given model (never trained here) form an Aho-Corasick automaton.
It reads a text once; at each position its output links give every piece that
ends there, and each of them relaxes the best score of that position. The
segmentation is the one with the largest sum of piece scores, as unigram models
define it; of equal sums, the one whose last piece is longest. Characters
without a piece become byte pieces.

No piece continues beyond a word mark that follows another character, so texts
are cut there and the segmentation of recurring words is kept in a bounded cache.

A model that was trained as BPE also gives pieces and scores; its segmentation
here is the best-scoring one, which can differ from the one that its merges
would reach.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidrel.llm.common import arrow_rows, kept

MARK = "▁"
#: How far below the worst piece a character without a piece scores.
UNKNOWN_PENALTY = 10.0
#: Words in the cache, and the longest that enters it.
CACHE, CACHED_CHARS = 200_000, 48


class Codec:
    """Encoder and decoder of one model, given as the bytes of its file."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.automaton, self.unit, self.byte_id = ahocorasick.Automaton(), [], {}
        chars, inner, worst = set(), False, 0.0
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value] = i
                self.unit.append(bytes([value]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.unit.append(b"")
            else:
                self.unit.append(piece.replace(MARK, " ").encode())
                if not sp.is_unused(i):
                    score = sp.get_score(i)
                    worst = min(worst, score)
                    self.automaton.add_word(piece, (len(piece), score, i))
                    chars.update(piece)
                    inner |= MARK in piece.lstrip(MARK)
        self.automaton.make_automaton()
        self.single = frozenset(x for x in chars if x in self.automaton)
        self.unknown, self.unk_id = worst - UNKNOWN_PENALTY, sp.unk_id()
        cut = "" if "\n" in chars else "\n"
        self.parts = re.compile("[\\s\\S]+" if inner else f"{MARK}+[^{MARK}{cut}]*|[^{MARK}{cut}]+" + (f"|{cut}+" if cut else ""))
        self.cache: dict[str, bytes] = {}

    def _bytes(self, char: str) -> list[int]:
        return [self.byte_id.get(b, self.unk_id) for b in char.encode("utf-8", "surrogatepass")]

    def viterbi(self, part: str) -> list[int]:
        """Piece ids of the best segmentation of a part whose spaces are marked."""
        n = len(part)
        if not self.single.issuperset(part):
            return self._with_unknown(part)
        best, size_of, id_of = [0.0] + [-math.inf] * n, [0] * (n + 1), [0] * (n + 1)
        for end, (size, score, i) in self.automaton.iter(part):
            end += 1
            score += best[end - size]
            if score > best[end]:
                best[end], size_of[end], id_of[end] = score, size, i
        out = []
        while n:
            out.append(id_of[n])
            n -= size_of[n]
        out.reverse()
        return out

    def _with_unknown(self, part: str) -> list[int]:
        """The same where some characters are no pieces: such a character scores ``unknown`` and becomes bytes."""
        n = len(part)
        best, back = [0.0] + [-math.inf] * n, [(0, -1)] * (n + 1)
        ends: list[list] = [[] for _ in range(n + 1)]
        for end, found in self.automaton.iter(part):
            ends[end + 1].append(found)
        for end in range(1, n + 1):
            for size, score, i in ends[end]:
                s = best[end - size] + score
                if s > best[end]:
                    best[end], back[end] = s, (end - size, i)
            if part[end - 1] not in self.single and best[end - 1] + self.unknown > best[end]:
                best[end], back[end] = best[end - 1] + self.unknown, (end - 1, -1)
        out, at = [], n
        while at:
            start, i = back[at]
            out.append([i] if i >= 0 else self._bytes(part[start:at]))
            at = start
        return [i for ids in reversed(out) for i in ids]

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit integers. A mark in the text itself becomes byte pieces, so decoding is exact."""
        if not text:
            return b""
        if MARK in text:
            parts = text.split(MARK)
            literal = np.array(self._bytes(MARK), np.int32).tobytes()
            return self._plain(" " + parts[0]) + b"".join(literal + self._plain(p) for p in parts[1:])
        return self._plain(" " + text)

    def _plain(self, text: str) -> bytes:
        cache, out = self.cache, []
        for part in self.parts.findall(text.replace(" ", MARK)):
            ids = cache.get(part)
            if ids is None:
                ids = np.array(self.viterbi(part), np.int32).tobytes()
                if len(part) <= CACHED_CHARS:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[part] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; ids out of range have none, bytes that are no UTF-8 become U+FFFD."""
        unit, n = self.unit, len(self.unit)
        raw = b"".join([unit[i] for i in ids.tolist() if 0 <= i < n])
        return raw.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def read_model(path: str) -> bytes:
    """A model file as bytes, read by the driver; it is a vocabulary and does not grow with the data."""
    with open(path, "rb") as f:
        return f.read()


def _flat(parts: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *[len(p) // 4 for p in parts]])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def encode(docs: DataFrame, model: bytes, text_col: str = "text", columns: list[str | Column] = (), out: str = "piece_ids") -> DataFrame:
    """``columns`` (all of docs' where none are named) and an array of piece ids.

    Whole texts are encoded, of any length. Null and empty texts give an empty
    array; an empty table gives an empty table.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    keep = kept(docs, columns, [out])
    schema = docs.select(*keep).withColumn(out, F.array().cast("array<int>")).schema
    shared, names = spark.sparkContext.broadcast(model), [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for b in batches:
            ids = [c.encode(t or "") for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.record_batch([*b.columns[:-1], _flat(ids)], names=names)

    return docs.select(*keep, F.col(text_col).alias("__text")).mapInArrow(run, schema)


def decode(pieces: DataFrame, model: bytes, ids_col: str = "piece_ids", columns: list[str | Column] = (), out: str = "decoded") -> DataFrame:
    """``columns`` and the text of each array of piece ids; null and empty arrays give an empty text."""
    spark = pieces.sparkSession
    arrow_rows(spark)
    keep = kept(pieces, columns, [out])
    schema = pieces.select(*keep).withColumn(out, F.lit("")).schema
    shared, names = spark.sparkContext.broadcast(model), [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for b in batches:
            rows = b.column(b.num_columns - 1)
            values = rows.values.to_numpy(zero_copy_only=False)
            ends = rows.offsets.to_numpy()
            some = rows.is_valid().to_numpy(zero_copy_only=False)
            texts = [c.decode(values[ends[i] : ends[i + 1]]) if some[i] else "" for i in range(len(rows))]
            yield pa.record_batch([*b.columns[:-1], pa.array(texts, pa.string())], names=names)

    return pieces.select(*keep, F.col(ids_col).alias("__ids")).mapInArrow(run, schema)
