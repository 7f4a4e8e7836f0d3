"""Joins of names with texts that hold them up to a few edits.

A name that is in a text up to d edits shares all but q d of its q-grams with
it. Of each name only its rarest grams are looked up, as many as make sure that
COMMON of them are shared; pairs with fewer are never made. What is left is
compared exactly. Grams that a name has twice count twice.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from evidrel.functions.text import CJK, best_fuzzy

#: Sizes of grams in the order in which they are tried, and how many shared grams a pair must show where its name allows.
#: An edit costs a name q grams, so longer grams than these make more of them hot ones that must be looked up.
SIZES, COMMON = (2, 1), 6


def grams(text: str, q: int) -> list[int]:
    """Keys of a text's q-grams; the second, third, ... occurrence of one has keys of its own. Equal keys only add candidates."""
    seen, out = Counter(), []
    for i in range(len(text) - q + 1):
        g = text[i : i + q]
        out.append(zlib.crc32(f"{q}:{seen[g]}:{g}".encode("utf-8", "surrogatepass")))
        seen[g] += 1
    return out


def plan(size: int, edits: int) -> tuple[int, int, int]:
    """(q, how many of the rarest grams are looked up, how many of them must be shared) for a name of that size; q is 0 where no gram is sure."""
    for least in (COMMON, 1):
        for q in SIZES:
            sure = size - q + 1 - q * edits
            if sure >= least:
                shared = min(sure, COMMON)
                return q, q * edits + shared, shared
    return 0, 0, 0


def _name_grams(names: DataFrame) -> DataFrame:
    """(name_id, gram, looked, shared) of names (name_id, name, edits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, name, edits in zip(*[c.to_pylist() for c in b.columns], strict=True):
                q, looked, shared = plan(len(name or ""), edits)
                rows += [(i, g, looked, shared) for g in grams(name, q)] if q else []
            yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((b.schema.field(0).type, pa.int64(), pa.int32(), pa.int32()))], names=["name_id", "gram", "looked", "shared"])

    kind = names.schema["name_id"].dataType.simpleString()
    return names.select("name_id", "name", F.col("edits").cast("int")).mapInArrow(run, f"name_id {kind}, gram long, looked int, shared int")


def _text_grams(texts: DataFrame) -> DataFrame:
    """(text_id, gram) of texts (text_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [[g for q in SIZES for g in grams(text or "", q)] for text in b.column(1).to_pylist()]
            rows = pa.array([k for k, found in enumerate(keys) for _ in found], pa.int64())
            yield pa.record_batch([b.column(0).take(rows), pa.array([g for found in keys for g in found], pa.int64())], names=["text_id", "gram"])

    kind = texts.schema["text_id"].dataType.simpleString()
    return texts.select("text_id", "text").mapInArrow(run, f"text_id {kind}, gram long")


def candidates(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(name_id, text_id): every pair in which a name (name_id, name, edits) may be in a text (text_id, text) up to its edits.

    Names of which no gram is sure to be shared (as many edits as characters)
    have no pairs. Null and empty names and texts have none.
    """
    held = _text_grams(texts)
    own = _name_grams(names)
    counts = held.join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = W.partitionBy("name_id").orderBy(F.coalesce("n", F.lit(0)), "gram")  # the grams of one name
    looked = own.join(counts, "gram", "left").withColumn("place", F.row_number().over(rarest)).where("place <= looked").select("name_id", "gram", "shared")
    both = looked.join(held, "gram").groupBy("name_id", "text_id").agg(F.count(F.lit(1)).alias("k"), F.first("shared").alias("shared"))
    return both.where("k >= shared").select("name_id", "text_id")


@lru_cache(maxsize=50_000)
def _gram_set(text: str, q: int) -> frozenset[int]:
    return frozenset(grams(text, q))


def may_hold(name: str, text: str, edits: int) -> bool:
    """Whether a text shares as many grams with a name as it must to hold it up to so many edits."""
    for q in SIZES:
        sure = len(name) - q + 1 - q * edits
        if sure > 0 and len(_gram_set(name, q) & _gram_set(text, q)) < sure:
            return False
    return True


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit by bit."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    return _common(at, len(a), b)


def _common(at: dict[str, int], size: int, b: str) -> int:
    whole = (1 << size) - 1
    s = whole
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & whole
    return size - s.bit_count()


def ratio(a: str, b: str) -> float:
    """100 times twice the common subsequence over both lengths; 100 for two empty texts."""
    return 200 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


@lru_cache(maxsize=100_000)
def partial_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The best ratio of the shorter text with a part of the longer one of its length (shorter at either end); 0 if one is empty or it is below ``least``.

    A part is compared only if the characters that both have could beat the best.
    """
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    best = _best_part(a, b, least)
    return max(best, _best_part(b, a, max(best, least))) if len(a) == len(b) else best


def _best_part(a: str, b: str, least: float) -> float:
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    left, m, shared, best = Counter(a), len(a), 0, 0.0
    for stop in range(1, len(b) + m):  # the part is b[stop - m : stop]
        if stop <= len(b):
            c = b[stop - 1]
            left[c] -= 1
            shared += left[c] >= 0
        if stop > m:
            c = b[stop - m - 1]
            shared -= left[c] >= 0
            left[c] += 1
        size = min(stop, len(b)) - max(stop - m, 0)
        bound = 200 * shared / (m + size)
        if bound > best and bound >= least:
            best = max(best, 200 * _common(at, m, b[max(stop - m, 0) : stop]) / (m + size))
    return best if best >= least else 0.0


def scored(pairs: DataFrame, a: str, b: str, what=partial_ratio, out: str = "score") -> DataFrame:
    """pairs with the score of two text columns; null where one is null."""
    schema = pairs.withColumn(out, F.lit(0.0)).schema
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_pylist() for c in (a, b))
            yield pa.record_batch([*batch.columns, pa.array([None if p is None or q is None else what(p, q) for p, q in zip(x, y, strict=True)], pa.float64())], names=names)

    return pairs.mapInArrow(run, schema)


def partial_join(names: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(name_id, name, text_id, text, score): pairs whose partial ratio is at least ``least`` (50 or more).

    names (name_id, name), texts (text_id, text). The shorter of the two is
    looked for in the longer one. Equal texts are compared once.
    """
    edits = lambda c: F.floor(F.length(c) * (2 * (1 - least / 100)) + 1e-9).cast("int")
    known = names.where(F.length("name") > 0).select("name").distinct().select(F.xxhash64("name").alias("name_id"), "name", edits("name").alias("edits"))
    asked = texts.where(F.length("text") > 0).select("text").distinct().select(F.xxhash64("text").alias("text_id"), "text", edits("text").alias("edits"))
    inside = candidates(known, asked.select("text_id", "text"))
    longest = known.agg(F.max(F.length("name"))).first()[0] or 0  # texts that are shorter may lie in a name
    around = candidates(asked.where(F.length("text") < longest).select(F.col("text_id").alias("name_id"), F.col("text").alias("name"), "edits"), known.select(F.col("name_id").alias("text_id"), F.col("name").alias("text")))
    around = around.select(F.col("text_id").alias("name_id"), F.col("name_id").alias("text_id"))
    pairs = lambda found, fits: found.join(known.select("name_id", "name"), "name_id").join(asked.select("text_id", "text"), "text_id").where(fits).select("name", "text")
    pairs = pairs(inside, F.length("name") <= F.length("text")).unionByName(pairs(around, F.length("name") > F.length("text")))

    def near(a: str, b: str) -> float:
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        return partial_ratio(a, b, least) if may_hold(short, long, int(len(short) * (2 * (1 - least / 100)) + 1e-9)) else 0.0

    pairs = pairs.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # comparing is dear, the pairs are small
    good = scored(pairs, "name", "text", near).where(F.col("score") >= least)
    return good.join(names.select("name_id", "name"), "name").join(texts.select("text_id", "text"), "text").select("name_id", "name", "text_id", "text", "score")


def ratio_join(names: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(name_id, text_id, score): pairs of names (name_id, name) and texts (text_id, text) whose ratio is at least ``least``.

    With part of ``least`` in common the longer one has (2 - least) / least times
    the other's length at most, which bounds the edits by the name's length.
    """
    part = least / 100
    known = names.where(F.length("name") > 0).withColumn("edits", F.floor(F.length("name") * (2 * (1 - part) / part) + 1e-9).cast("int"))
    pairs = candidates(known, texts.where(F.length("text") > 0)).join(names.select("name_id", "name"), "name_id").join(texts.select("text_id", "text"), "text_id")
    return scored(pairs, "name", "text", ratio).where(F.col("score") >= least).select("name_id", "text_id", "score")


def window_edits(size: Column) -> Column:
    """Edits that ``best_fuzzy`` allows a name of that size at most."""
    return F.when(size <= 4, 1).otherwise(F.least(F.lit(2), F.floor((size + 1) * 0.22 + 1e-9))).cast("int")


def window_join(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(name_id, text_id, m): names (name_id, name) of two characters and more and texts (text_id, text) with a near enough window (see ``best_fuzzy``)."""
    known = names.where(F.length("name") >= 2).select("name").distinct().select(F.xxhash64("name").alias("name_id"), "name", window_edits(F.length("name")).alias("edits"))
    asked = texts.where(F.length("text") > 0).select("text").distinct().select(F.xxhash64("text").alias("text_id"), "text")
    pairs = candidates(known, asked).join(known.select("name_id", "name"), "name_id").join(asked, "text_id")
    pairs = pairs.repartition(int(names.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # comparing is dear, the pairs are small
    hold = lambda name, text: float(may_hold(name, text, 1 if len(name) <= 4 else min(2, int((len(name) + 1) * 0.22 + 1e-9))))  # noqa: E731  all grams, not the rarest only
    pairs = scored(pairs.select("name", "text"), "name", "text", hold, "may").where("may > 0")
    near = pairs.withColumn("m", best_fuzzy(F.col("text"), F.col("name"))).where("m is not null").select("name", "text", "m")
    return near.join(names.select("name_id", "name"), "name").join(texts.select("text_id", "text"), "text").select("name_id", "text_id", "m")


def is_cjk(text: Column) -> Column:
    """Only CJK characters and white space."""
    return text.rlike(rf"^[\s{CJK}]*$")
