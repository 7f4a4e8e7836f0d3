"""Searches of a stated query set against all vectors, shard by shard.

Vectors are dealt to spatial shards by median splits that a bounded sample
places; every row is dealt and searched. A shard of more than ``shard_rows``
(one vector may be very common) is split further by a hash of the id. A query
first searches the part of the shard it lies in. Its kth score there goes along
to those other shards only that may hold a score as good, which the tasks tell
from a table of the shards' boxes (MOST_SHARDS at most, so it is sent to all).
Vectors are copied only where more than ``block_rows`` queries reach their part:
what is shuffled grows with the vectors and with the (query, part) pairs that
bounds leave.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evidrel.llm.common import arrow_rows, drop_scratch, written

#: Vectors of a part of a shard, and queries that meet one copy of it.
SHARD_ROWS, BLOCK_ROWS = 16_384, 16_384
#: Vectors in the sample that places the splits, and shards at most.
FIT_ROWS, MOST_SHARDS = 8192, 4096


def usable(vectors: DataFrame, id_col: str, vec_col: str, zero: bool, keep: list[str] = ()) -> DataFrame:
    """(vec_id, v) and ``keep`` of rows whose vector has only finite components; with zero, also all-zero ones."""
    v = F.col(vec_col).cast("array<double>")
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    if not zero:
        ok = ok & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), *keep).where(F.col("vec_id").isNotNull() & ok)


def once(vectors: DataFrame) -> DataFrame:
    """(vec_id, v), each id once: of rows that repeat an id the one with the smallest vector, component by component."""
    again = written(vectors.groupBy("vec_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("vec_id"), "repeated")
    if again.isEmpty():
        return vectors.select("vec_id", "v")
    rows = vectors.select("vec_id", "v")
    return rows.join(again, "vec_id", "left_anti").unionByName(rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min("v").alias("v")))


def matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()) if len(column) else np.zeros((0, 1))


class Splits:
    """The upper levels of a KD-tree: which shard a vector lies in."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.nodes: list[tuple[int, float, int, int]] = []
        self.shards = 0
        if len(sample):
            self._split(sample, shards)

    def _split(self, x: np.ndarray, shards: int) -> int:
        side = int((x.max(axis=0) - x.min(axis=0)).argmax())
        cut = float(np.median(x[:, side]))
        left = x[:, side] <= cut
        if shards <= 1 or left.all():
            self.shards += 1
            return -self.shards
        me = len(self.nodes)
        self.nodes.append((side, cut, 0, 0))
        a = self._split(x[left], shards // 2)
        b = self._split(x[~left], shards - shards // 2)
        self.nodes[me] = (side, cut, a, b)
        return me

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64) if self.nodes else np.full(len(x), -1)
        while len(live := np.flatnonzero(at >= 0)):
            for node in np.unique(at[live]):
                side, cut, a, b = self.nodes[node]
                rows = live[at[live] == node]
                at[rows] = np.where(x[rows, side] <= cut, a, b)
        return -at - 1


#: work(query ids, queries, kth scores, vector ids, vectors): for each query the scores and ids it found.
Work = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]


def _boxes(placed: DataFrame, dim: int, coordinates: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shards of the usual dimension and the least and largest coordinates of their rows."""

    def part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                x, shard = coordinates(matrix(f["v"])), f["shard"].to_numpy()
                for s in np.unique(shard):
                    own = x[shard == s]
                    yield pd.DataFrame({"shard": [s], "lo": [own.min(axis=0)], "hi": [own.max(axis=0)]})

    def merged(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"shard": f["shard"][:1], "lo": [matrix(f["lo"]).min(axis=0)], "hi": [matrix(f["hi"]).max(axis=0)]})

    schema = "shard long, lo array<double>, hi array<double>"
    got = placed.where(F.col("dim") == dim).select("v", "shard").mapInPandas(part, schema)
    # many small boxes of one shard are merged in two steps, so no group is large
    got = got.withColumn("some", F.pmod(F.xxhash64("lo"), F.lit(64))).groupBy("shard", "some").applyInPandas(merged, schema)
    got = got.groupBy("shard").applyInPandas(merged, schema).toPandas().sort_values("shard")  # MOST_SHARDS rows
    return got["shard"].to_numpy(), matrix(got["lo"]), matrix(got["hi"])


def _found(work: Work) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        if not len(asked) or not len(shard):
            return none
        got = work(asked["vec_id"].to_numpy(), matrix(asked["v"]), asked["kth"].to_numpy(float), shard["vec_id"].to_numpy(), matrix(shard["v"]))
        own = np.repeat(asked["vec_id"].to_numpy(), [len(s) for s, _ in got])
        return pd.DataFrame({"query_id": own, "vec_id": np.concatenate([i for _, i in got]), "score": np.concatenate([s for s, _ in got])})

    return run


def search(vectors: DataFrame, queries: Column, k: int, work: Work, coordinates: Callable[[np.ndarray], np.ndarray], reaches: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k best rows that work finds for each query: query_id, rank, vec_id, score.

    vectors: (vec_id, v) with finite components. coordinates(v) gives the values
    of which a shard's box is made; reaches(q, kth, lo, hi) says for each query
    and box whether the shard may hold a score of at least kth. Vectors of
    another length than a query's are not its candidates. Of rows that repeat an
    id one takes part, as a query and as a candidate (see ``once``). Ties go to
    the smaller id.
    """
    spark = vectors.sparkSession
    arrow_rows(spark)
    sized = once(vectors).withColumn("dim", F.size("v")).withColumn("asks", queries)
    totals = sized.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    n, dim = (totals["count"], totals["dim"]) if totals else (0, 0)
    shards = min(MOST_SHARDS, max(1, -(-n // shard_rows)))
    share = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(1 << 20)) < int(min(1.0, FIT_ROWS / max(n, 1)) * (1 << 20))
    sample = sized.where(share & (F.col("dim") == dim)).select("vec_id", "v").limit(4 * FIT_ROWS).toPandas()
    splits = Splits(matrix(sample.sort_values("vec_id")["v"]) if len(sample) else np.zeros((0, 1)), shards)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            at = np.zeros(len(f), np.int64)
            usual = np.flatnonzero((f["dim"] == dim).to_numpy())
            if len(usual):
                at[usual] = splits(matrix(f["v"].iloc[usual]))
            yield f.assign(shard=at)

    placed = written(sized.mapInPandas(place, "vec_id long, v array<double>, dim int, asks boolean, shard long"), "placed")
    sizes = placed.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / shard_rows).cast("int").alias("subs"))
    sizes = written(sizes, "shards")
    # MOST_SHARDS rows, and one for each unusual dimension
    placed = written(placed.join(sizes, ["dim", "shard"]).withColumn("sub", F.pmod(F.xxhash64("vec_id"), F.col("subs")).cast("int")).drop("subs"), "parts")
    names, lo, hi = _boxes(placed, dim, coordinates)
    boxes = spark.sparkContext.broadcast((names, lo, hi))
    part, found = ["dim", "shard", "sub"], "query_id long, vec_id long, score double"
    own = lambda *more: placed.where("asks").select(*[F.col(c).alias(c) for c in ["vec_id", "v", *part]], *more)  # noqa: E731  attributes of its own, so that both sides of a cogroup differ

    home = own(F.lit(float("-inf")).alias("kth")).groupBy(*part).cogroup(placed.drop("asks").groupBy(*part)).applyInPandas(_found(work), found)
    home = written(home, "home")
    kth = home.groupBy(F.col("query_id").alias("vec_id")).agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("known"))
    asked = own().join(kth, "vec_id", "left").withColumn("kth", F.coalesce("known", F.lit(float("-inf")))).drop("known")

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, lo, hi = boxes.value
        for f in frames:
            usual = (f["dim"] == dim).to_numpy()
            rows, to = np.flatnonzero(~usual), f["shard"].to_numpy()[~usual]
            if usual.any():
                u = np.flatnonzero(usual)
                q, s = np.nonzero(reaches(matrix(f["v"].iloc[u]), f["kth"].to_numpy(float)[u], lo, hi))
                rows, to = np.concatenate([rows, u[q]]), np.concatenate([to, names[s]])
            g = f.iloc[rows]
            yield pd.DataFrame({"vec_id": g["vec_id"].to_numpy(), "kth": g["kth"].to_numpy(), "dim": g["dim"].to_numpy(), "shard": to, "own_shard": g["shard"].to_numpy(), "own_sub": g["sub"].to_numpy()})

    routes = asked.mapInPandas(route, "vec_id long, kth double, dim int, shard long, own_shard long, own_sub int")
    routes = routes.join(sizes, ["dim", "shard"]).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
    routes = written(routes.where("shard != own_shard or sub != own_sub").select("vec_id", "kth", *part), "routes")
    blocks = written(routes.groupBy(*part).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks")), "blocks")
    asked = routes.join(blocks, part).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int")).join(own().select("vec_id", "v"), "vec_id")
    copies = placed.drop("asks").join(blocks, part).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = [*part, "block"]
    away = asked.select("vec_id", "v", "kth", *keys).groupBy(*keys).cogroup(copies.select("vec_id", "v", *keys).groupBy(*keys)).applyInPandas(_found(work), found)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = home.unionByName(away).withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k)
    out = written(out.select("query_id", "rank", "vec_id", "score"), "nearest")
    drop_scratch(placed, sizes, home, routes, blocks)
    return out
