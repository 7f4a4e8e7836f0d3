"""Hard-negative mining over a vector-approximation file.

Every dimension is cut into cells, whose borders are quantiles of a bounded
sample and the true least and largest values; a row's approximation is one byte
a dimension, and each row has one. For an anchor, a table of each dimension's
least and largest contribution by cell turns approximations into lower and upper
bounds of the inner product. A row is scored exactly only if its upper bound
reaches the best known and its bounds touch a window of scores that is asked for.

Anchors are a stated query set. They go to the tasks in blocks of bounded size;
each block reads the file once for its positives and once for its negatives, and
no vector is shuffled. Where the file has many parts, a share of the rows is
searched first, and the kth scores found there are floors for all tasks, so what
tasks hand on does not grow with their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidrel.llm.common import arrow_rows, drop_path, drop_scratch, scratch, written

#: Cells of a dimension; rows of the sample that places their borders.
CELLS, FIT_ROWS = 256, 8192
#: Rows of a part of the file, rows that a task looks at together, bytes of a block of anchors.
PART_ROWS, LOOK_ROWS, BLOCK_BYTES = 8192, 8192, 4 << 20
#: Parts from which floors are sought first, in one of so many rows.
SHARE = 64


class Approximation:
    """The borders of the cells: edges[d] has CELLS + 1 ascending values."""

    def __init__(self, sample: list[np.ndarray], lo: np.ndarray, hi: np.ndarray):
        self.edges = np.empty((len(lo), CELLS + 1))
        for d in range(len(lo)):
            x = np.array([v[d] for v in sample if len(v) > d])
            inner = np.quantile(x, np.linspace(0, 1, CELLS + 1)[1:-1], method="lower") if len(x) else np.full(CELLS - 1, lo[d])
            self.edges[d] = np.concatenate([[lo[d]], np.clip(inner, lo[d], hi[d]), [hi[d]]])

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each component of rows of one length."""
        out = np.empty(x.shape, np.uint8)
        for d in range(x.shape[1]):
            out[:, d] = np.searchsorted(self.edges[d, 1:-1], x[:, d], "right")
        return out

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest contribution of each cell of each dimension to the product with q: (dimensions, CELLS) each."""
        a, b = q[:, None] * self.edges[: len(q), :-1], q[:, None] * self.edges[: len(q), 1:]
        return np.minimum(a, b), np.maximum(a, b)

    @staticmethod
    def bound(table: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Sums of a table's contributions by the cells (dimensions, rows): look-ups alone."""
        out, got = np.zeros(cells.shape[1]), np.empty(cells.shape[1])
        for values, places in zip(table, cells, strict=True):
            np.take(values, places, out=got, mode="clip")  # a byte is always in range
            out += got
        return out

    def bounds(self, q: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bound of each row's product; rounding of sums is allowed for."""
        low, high = self.tables(q)
        slack = 1e-12 * max(np.abs(low).max(initial=0), np.abs(high).max(initial=0)) * len(q)
        return self.bound(low, cells) - slack, self.bound(high, cells) + slack


class Rows:
    """Rows of one length that a task looks at together; cells are (dimensions, rows)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, cells: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.cells, self.x = ids, labels, cells, x
        self.by_label: dict[int, Rows] = {}

    def of(self, label: int) -> Rows:
        if label not in self.by_label:
            at = np.flatnonzero(self.labels == label)
            self.by_label[label] = Rows(self.ids[at], self.labels[at], np.ascontiguousarray(self.cells[:, at]), self.x[at])
        return self.by_label[label]


class Best:
    """The k best (score, then smaller id) seen so far; ``floor`` is a score that k rows are known to reach."""

    def __init__(self, k: int, floor: float):
        self.k, self.floor, self.s, self.i = k, floor, np.zeros(0), np.zeros(0, np.int64)

    def least(self, sure: np.ndarray) -> float:
        """What a row must reach, given lower bounds of rows that are sure to count."""
        return max(self.floor, np.partition(sure, len(sure) - self.k)[len(sure) - self.k]) if len(sure) >= self.k else self.floor

    def add(self, s: np.ndarray, i: np.ndarray) -> None:
        ok = s >= self.floor
        if not ok.any():
            return
        s, i = np.concatenate([self.s, s[ok]]), np.concatenate([self.i, i[ok]])
        top = np.lexsort((i, -s))[: self.k]
        self.s, self.i = s[top], i[top]
        if len(top) == self.k:
            self.floor = max(self.floor, self.s[-1])


class Ask:
    """One anchor: its vector, label and what is sought: its positives, or negatives in windows of scores."""

    def __init__(self, anchor: int, label: int, q: np.ndarray, same: bool, keys: list[int], windows: list[tuple[float, float]], k: int, floors: list[float]):
        self.anchor, self.label, self.q, self.same, self.keys, self.windows = anchor, label, q, same, keys, windows
        self.best = [Best(k, f) for f in floors]

    def look(self, shape: Approximation, rows: Rows) -> int:
        """Takes in rows of the anchor's length; returns how many were scored exactly."""
        rows = rows.of(self.label) if self.same else rows
        ok = rows.ids != self.anchor if self.same else rows.labels != self.label
        lo, up = shape.bounds(self.q, rows.cells)
        wanted = np.zeros(len(ok), bool)
        for (least, most), best in zip(self.windows, self.best, strict=True):
            wanted |= (up >= max(best.least(lo[ok & (lo >= least) & (up <= most)]), least)) & (lo <= most)
        at = np.flatnonzero(wanted & ok)
        if len(at):
            s = rows.x[at] @ self.q
            for (least, most), best in zip(self.windows, self.best, strict=True):
                hit = (s >= least) & (s <= most)
                best.add(s[hit], rows.ids[at[hit]])
        return len(at)


def _pass(file: DataFrame, shape: Approximation, asks: pd.DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor_id, key, vec_id, score): of each task the rows that may be among the k best of an anchor's window.

    asks: a row for each anchor (vec_id, label, v) with lists keys, least, most, floors.
    """
    shared = file.sparkSession.sparkContext.broadcast((shape, asks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, asks = shared.value
        by_dim: dict[int, list[Ask]] = {}
        for r in asks.itertuples(index=False):
            q = np.asarray(r.v, float)
            by_dim.setdefault(len(q), []).append(Ask(r.vec_id, r.label, q, same, list(r.keys), list(zip(r.least, r.most, strict=True)), k, list(r.floors)))

        def look(held: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(held).combine_chunks()
            ids, labels = t["vec_id"].to_numpy(), t["label"].to_numpy()
            cells, vectors = t["cells"].to_pylist(), t["v"].to_pandas().to_numpy()
            dims = np.array([len(c) for c in cells])
            for d in np.unique(dims):
                if d in by_dim:
                    at = np.flatnonzero(dims == d)
                    shown = np.frombuffer(b"".join([cells[i] for i in at]), np.uint8).reshape(-1, d)
                    rows = Rows(ids[at], labels[at], np.ascontiguousarray(shown.T), np.stack(vectors[at]))
                    for a in by_dim[d]:
                        a.look(shape, rows)

        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= LOOK_ROWS:
                look(held)
                held, n = [], 0
        if n:
            look(held)
        for some in by_dim.values():
            for a in some:
                for key, best in zip(a.keys, a.best, strict=True):
                    if len(best.i):
                        yield pa.record_batch([pa.array([a.anchor] * len(best.i), pa.int64()), pa.array([key] * len(best.i), pa.int64()), pa.array(best.i, pa.int64()), pa.array(best.s, pa.float64())], names=["anchor_id", "key", "vec_id", "score"])

    return file.select("vec_id", "label", "cells", "v").mapInArrow(run, "anchor_id long, key long, vec_id long, score double")


def _best(file: DataFrame, shape: Approximation, asks: pd.DataFrame, same: bool, k: int, floors_first: bool) -> DataFrame:
    """The k best rows of each anchor's windows: anchor_id, key, rank, vec_id, score."""
    order = W.partitionBy("anchor_id", "key").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    if floors_first:
        some = _pass(file.where(F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(SHARE)) == 0), shape, asks, same, k)
        known = {(r.anchor_id, r.key): r.score for r in ranked(some).where(F.col("rank") == k).toPandas().itertuples()}  # a row for each window of the block
        asks = asks.assign(floors=[[known.get((a, key), f) for key, f in zip(keys, floors, strict=True)] for a, keys, floors in zip(asks["vec_id"], asks["keys"], asks["floors"], strict=True)])
    return ranked(_pass(file, shape, asks, same, k))


def _once(vectors: DataFrame) -> DataFrame:
    """Each id once: of rows that repeat an id the one with the smallest label, then the smallest vector."""
    again = written(vectors.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"), "va-repeated")
    rows = vectors.select("vec_id", "label", "v")
    least = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r"))
    return rows.join(again, "vec_id", "left_anti").unionByName(least.select("vec_id", "r.label", "r.v"))


def _ends(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The least and largest value of each dimension."""

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lo, hi = np.zeros(0), np.zeros(0)
        for f in frames:
            for d in f["v"].map(len).unique():
                x = np.stack(f["v"][f["v"].map(len) == d].to_numpy())
                if d > len(lo):
                    lo, hi = np.pad(lo, (0, d - len(lo)), constant_values=np.inf), np.pad(hi, (0, d - len(hi)), constant_values=-np.inf)
                lo[:d], hi[:d] = np.minimum(lo[:d], x.min(axis=0)), np.maximum(hi[:d], x.max(axis=0))
        yield pd.DataFrame({"d": np.arange(len(lo)), "lo": lo, "hi": hi})

    got = rows.select("v").mapInPandas(part, "d int, lo double, hi double").groupBy("d").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    got = got.toPandas().sort_values("d")  # a row for each dimension
    return got["lo"].to_numpy(), got["hi"].to_numpy()


def approximated(rows: DataFrame, shape: Approximation) -> DataFrame:
    """rows with ``cells``, a byte for each component of v."""
    shared = rows.sparkSession.sparkContext.broadcast(shape)
    schema = rows.withColumn("cells", F.lit(b"")).schema

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cells, dims = np.empty(len(f), object), f["v"].map(len).to_numpy()
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                got = shared.value.cells(np.stack(f["v"].to_numpy()[at]))
                for r, i in enumerate(at):
                    cells[i] = got[r].tobytes()
            yield f.assign(cells=cells)

    return rows.mapInPandas(run, schema)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int, negatives: int, low: float, high: float, part_rows: int = PART_ROWS, block_bytes: int = BLOCK_BYTES, share_from: int = SHARE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    vectors: (vec_id, label, v) without nulls and with finite components; rows
    that satisfy ``anchors`` are the anchors. An anchor's positives are its
    first rows of the same label by inner product, itself left out; for each, the
    first rows of other labels with low % <= score / positive score <= high %
    (so none for a negative positive score, and for 0 those of score 0). Ties go
    to the smaller id; fewer than asked for give all. Rows of another length are
    not candidates. Of rows that repeat an id one takes part, that of the
    smallest label and vector. Other columns are not read; an empty table gives
    an empty result. Scores are sums of doubles: exact for integers below 2^53.
    """
    spark: SparkSession = vectors.sparkSession
    arrow_rows(spark)
    rows = written(_once(vectors.select("vec_id", F.col("label").cast("long").alias("label"), "v")).withColumn("asks", F.coalesce(anchors, F.lit(False))), "va-rows")
    n, asking, widest = rows.agg(F.count(F.lit(1)), F.count_if("asks"), F.max(F.size("v"))).first()
    path = scratch(spark, "hard-negatives")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score double, negative_score double"
    spark.createDataFrame([], schema).write.parquet(path)
    if not asking:
        drop_scratch(rows)
        return spark.read.schema(schema).parquet(path)
    lo, hi = _ends(rows)
    few = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) < int(min(1.0, FIT_ROWS / n) * (1 << 20))
    sample = rows.where(few).select("vec_id", "v").limit(4 * FIT_ROWS).toPandas().sort_values("vec_id")  # only places borders
    shape, parts = Approximation(list(sample["v"]), lo, hi), -(-n // part_rows)
    file = written(approximated(rows, shape).repartition(parts, "vec_id"), "va-file")
    blocks = max(1, -(-asking * 8 * widest // block_bytes))
    floors_first, found = parts > share_from, []
    for b in range(blocks):  # of BLOCK_BYTES each
        own = file.where(F.col("asks") & (F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(blocks)) == b)).select("vec_id", "label", "v").toPandas()
        none, all_ = [float("-inf")], [float("inf")]
        asks = own.assign(keys=[[0]] * len(own), least=[none] * len(own), most=[all_] * len(own), floors=[none] * len(own))
        best = _best(file, shape, asks, True, positives, floors_first).toPandas().sort_values(["anchor_id", "rank"])  # positives for each anchor of the block
        best = best[best["score"] >= 0]
        pairs = best.groupby("anchor_id").agg(keys=("vec_id", list), scores=("score", list))
        asks = own.join(pairs, on="vec_id", how="inner")
        # bounds of the window as the least and largest score that pass the test on 100 times the score
        asks["least"] = [[np.ceil(low * s / 100) if float(s).is_integer() else low * s / 100 for s in ss] for ss in asks["scores"]]
        asks["most"] = [[np.floor(high * s / 100) if float(s).is_integer() else high * s / 100 for s in ss] for ss in asks["scores"]]
        asks["floors"] = [none * len(ss) for ss in asks["scores"]]
        if len(asks):
            got = _best(file, shape, asks.drop(columns="scores"), False, negatives, floors_first)
            scores = spark.createDataFrame(best[["anchor_id", "vec_id", "score"]].astype({"anchor_id": "int64", "vec_id": "int64"}), "anchor_id long, key long, positive_score double")
            out = got.join(scores, ["anchor_id", "key"]).select("anchor_id", F.col("key").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
            out.write.mode("append").parquet(path)
    drop_scratch(rows, file)
    return spark.read.schema(schema).parquet(path)
