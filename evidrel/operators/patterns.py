"""Many patterns in many texts: one pass of an automaton over each text."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of patterns that one automaton holds; more make several, each of which reads the texts.
MOST_CHARS = 4_000_000
SPANS = "array<struct<start:int,stop:int,text:string>>"


def _blocks(patterns: DataFrame, most: int) -> Iterator[list[str]]:
    """The distinct patterns in blocks of about ``most`` characters, each of which fits in the driver."""
    known = patterns.select(F.col("pattern")).where("pattern != ''").distinct()
    total = known.agg(F.sum(F.length("pattern"))).first()[0] or 0
    n = int(max(1, -(-total // most)))
    block = F.pmod(F.xxhash64("pattern"), F.lit(n))
    for k in range(n):
        yield sorted(r[0] for r in known.where(block == k).collect())  # MOST_CHARS or so


def automaton(patterns: list[str]) -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for p in patterns:
        out.add_word(p, p)
    if patterns:
        out.make_automaton()
    return out


def occurrences(texts: DataFrame, text: str, patterns: DataFrame, keep: list[str], most: int = MOST_CHARS) -> DataFrame:
    """(keep, pattern, start, stop) of every place where a text holds a pattern; places may overlap.

    patterns: one column pattern; case counts, empty and null ones are never
    found, repeated ones once. Null texts hold nothing.
    """
    out = None
    schema = texts.select(*keep, F.lit("").alias("pattern"), F.lit(0).alias("start"), F.lit(0).alias("stop")).schema
    names = [f.name for f in schema]
    for some in _blocks(patterns, most):
        shared = texts.sparkSession.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            a = automaton(shared.value)
            for b in batches if shared.value else ():
                rows, found, starts, stops = [], [], [], []
                for k, t in enumerate(b.column(b.num_columns - 1).to_pylist()):
                    for end, p in a.iter(t or ""):
                        rows.append(k)
                        found.append(p)
                        starts.append(end + 1 - len(p))
                        stops.append(end + 1)
                if rows:
                    yield pa.record_batch([*[c.take(pa.array(rows)) for c in b.columns[:-1]], pa.array(found), pa.array(starts, pa.int32()), pa.array(stops, pa.int32())], names=names)

        got = texts.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    return out


def longest_first(found: list[tuple[int, int, str]], had: list[tuple[int, int, str]] = ()) -> list[tuple[int, int, str]]:
    """Of places (start, stop, pattern) those that stay beside the ones had when longer patterns come first, then earlier ones in order, then earlier places."""
    starts, out = [], {}  # places that stay never overlap: only the neighbours can be met
    for a, b, p in [*had, *sorted(found, key=lambda x: (x[0] - x[1], x[2], x[0]))]:
        k = bisect_right(starts, a)
        if (k == 0 or out[starts[k - 1]][1] <= a) and (k == len(starts) or b <= starts[k]):
            starts.insert(k, a)
            out[a] = (a, b, p)
    return [out[a] for a in starts]


def _by_length(patterns: DataFrame, most: int) -> Iterator[list[str]]:
    """The distinct patterns, longer ones first, in blocks of about ``most`` characters that split no length."""
    known = patterns.select("pattern", F.length("pattern").alias("size")).where("size > 0").distinct()
    sizes = [(r["size"], r["n"]) for r in known.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect()]  # a row for each length
    while sizes:
        top, held, k = sizes[0][0], 0, 0
        while k < len(sizes) and (k == 0 or held + sizes[k][0] * sizes[k][1] <= most):
            held, k = held + sizes[k][0] * sizes[k][1], k + 1
        yield [r[0] for r in known.where(F.col("size").between(sizes[k - 1][0], top)).select("pattern").collect()]
        sizes = sizes[k:]


def labelled(texts: DataFrame, text: str, patterns: DataFrame, keep: list[str], most: int = MOST_CHARS) -> DataFrame:
    """keep, text and spans: of each text the places of patterns without overlaps, longer patterns first; in order of place.

    Of equally long patterns those first in order go first. Patterns come in
    blocks by falling length (one length is one block); each block's pass goes on
    from the spans that longer ones took.
    """
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("text", pa.string())]))
    out = texts.select(*keep, text, F.array().cast(SPANS).alias("spans"))
    names, schema = out.columns, out.schema
    for some in _by_length(patterns, most):
        shared = texts.sparkSession.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            a = automaton(shared.value)
            for b in batches:
                spans = []
                for t, have in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                    had = [(x["start"], x["stop"], x["text"]) for x in have]
                    new = longest_first([(end + 1 - len(p), end + 1, p) for end, p in a.iter(t or "")] if shared.value else [], had)
                    spans.append([{"start": x, "stop": y, "text": p} for x, y, p in new])
                yield pa.record_batch([*b.columns[:-1], pa.array(spans, kind)], names=names)

        out = out.mapInArrow(run, schema)
    return out
