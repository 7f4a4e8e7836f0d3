"""Logistic models by distributed stochastic gradient descent.

Rows are dealt to shards by a hash of their key. In each epoch every shard goes
through its rows, in an order that a hash of key and epoch gives, from the
weights that all start with; afterwards the shards' weights are averaged by
their numbers of rows. Shards are streamed, so a task holds weights and one
batch; what is shuffled per epoch is a model for each shard. With one output per
class a model is one against the rest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidrel.learning.hashed import Featurize, Row
from evidrel.learning.vectors import MOST_TASKS, SCHEMA, chunks, stretches, summed
from evidrel.sources.batches import small_batches
from evidrel.sources.scratch import dropped, written

#: Penalty of squared weights, first step, passes over the rows.
ALPHA, ETA, EPOCHS = 1e-4, 10.0, 3
#: Rows of a shard, until there are as many shards as vectors may be summed of.
SHARD_ROWS = 5_000


class Weights:
    """Weights of several outputs while a shard is gone through; the scale makes the penalty cheap."""

    def __init__(self, w: np.ndarray, bias: np.ndarray):
        self.w, self.bias, self.scale = w.copy(), bias.copy(), 1.0

    def step(self, row: Row, y: np.ndarray, weight: np.ndarray, eta: float) -> None:
        at, x = row
        score = self.scale * (self.w[:, at] @ x) + self.bias
        slope = weight * (1 / (1 + np.exp(-np.clip(score, -500, 500))) - y)
        self.scale *= 1 - eta * ALPHA
        self.w[:, at] -= np.outer(eta * slope / self.scale, x)
        self.bias -= eta * slope
        if self.scale < 1e-9:
            self.w *= self.scale
            self.scale = 1.0


def eta(t: int, first: float = ETA) -> float:
    """The step after t rows: large at first, then as 1 / (penalty t)."""
    return first / (1 + ALPHA * first * t)


@dataclass
class Linear:
    """classes[k] has weights w[k] and bias[k]."""

    classes: list[str]
    w: np.ndarray
    bias: np.ndarray

    def scores(self, rows: list[Row]) -> np.ndarray:
        return np.array([self.w[:, at] @ x + self.bias for at, x in rows]).reshape(-1, len(self.classes))

    def probabilities(self, rows: list[Row], exclusive: bool) -> np.ndarray:
        """Of each row and class; exclusive ones sum to 1."""
        p = 1 / (1 + np.exp(-np.clip(self.scores(rows), -500, 500)))
        if exclusive and len(p):
            total = p.sum(axis=1, keepdims=True)
            p = np.where(total > 0, p / np.where(total > 0, total, 1), 1 / len(self.classes))
        return p


def _epoch(rows: DataFrame, shards: int, epoch: int, started: int, w: np.ndarray, bias: np.ndarray, featurize: Featurize, first: float) -> tuple[np.ndarray, np.ndarray]:
    shared = rows.sparkSession.sparkContext.broadcast((w, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = Weights(*shared.value), 0
        for b in batches:
            ys, ws = (np.array(b.column(c).to_pylist(), float) for c in ("y", "weight"))
            made = (row for part in stretches(b.column("value")) for row in featurize(part.to_pylist()))
            for row, y, weight in zip(made, ys, ws, strict=True):
                own.step(row, y, weight, eta(started + n, first))
                n += 1
        if n:
            full = np.hstack([own.scale * own.w, own.bias[:, None]]) * n
            for k in range(len(full)):
                yield from chunks(k, full[k], n)

    order = [F.xxhash64(F.col("key").cast("string"), F.lit(epoch)), "key"]
    dealt = rows.repartition(shards, F.xxhash64(F.col("key").cast("string"), F.lit(17))).sortWithinPartitions(*order)
    total, n = summed(dealt.select("value", "y", "weight").mapInArrow(run, SCHEMA))
    shared.unpersist()
    full = total / n
    return full[:, :-1], full[:, -1]


def fit(rows: DataFrame, key: str | Column, value: str | Column, targets: dict[str, Column], places: int, featurize: Featurize, weights: dict[str, Column] | None = None, epochs: int = EPOCHS, shard_rows: int = SHARD_ROWS, first: float = ETA) -> Linear | None:
    """A model of the targets (1 or 0) of rows with a value; None without rows.

    ``key`` deals rows to shards and orders them; rows that repeat one are used
    each. ``weights`` weigh a row's loss for a target (1 where none is given); a
    null target or weight takes no part for that target.
    """
    names = list(targets)
    y = F.array(*[F.coalesce(targets[c].cast("double"), F.lit(0.0)) for c in names])
    given = lambda c: F.when(targets[c].isNotNull(), F.coalesce((weights or {}).get(c, F.lit(1.0)).cast("double"), F.lit(0.0))).otherwise(0.0)
    key, value = (F.col(c) if isinstance(c, str) else c for c in (key, value))
    small_batches(rows.sparkSession)
    table = written(rows.select(key.alias("key"), value.alias("value"), y.alias("y"), F.array(*map(given, names)).alias("weight")), "linear-rows")
    n = table.count()
    if not n:
        dropped(table)
        return None
    shards = int(min(MOST_TASKS, -(-n // shard_rows)))
    w, bias = np.zeros((len(names), places)), np.zeros(len(names))
    for epoch in range(epochs):
        w, bias = _epoch(table, shards, epoch, epoch * (n // shards), w, bias, featurize, first)
    dropped(table)
    return Linear(names, w, bias)


def balanced(rows: DataFrame, label: str) -> dict[str, float]:
    """The weight of each class by which all classes count alike; classes are few."""
    counts = {r["c"]: r["n"] for r in rows.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    return {c: total / (len(counts) * n) for c, n in sorted(counts.items())}


def fit_classes(rows: DataFrame, key: str | Column, value: str | Column, label: str, places: int, featurize: Featurize, **more) -> Linear | None:
    """One of several classes: one output each, rows weighed so that classes count alike. None with fewer than two classes."""
    weight = balanced(rows, label)
    if len(weight) < 2:
        return None
    of = F.col(label).cast("string")
    known = rows.where(of.isNotNull())
    each = F.create_map(*[x for c, v in weight.items() for x in (F.lit(c), F.lit(v))])[of]
    return fit(known, key, value, {c: (of == c).cast("double") for c in weight}, places, featurize, weights=dict.fromkeys(weight, each), **more)


def predict(rows: DataFrame, model: Linear, value: str | Column, featurize: Featurize, exclusive: bool, out: str = "probabilities", columns: list[str] | None = None) -> DataFrame:
    """rows (of them ``columns``, where given) with an array of the classes' probabilities."""
    small_batches(rows.sparkSession)
    value = F.col(value) if isinstance(value, str) else value
    keep = [c for c in (rows.columns if columns is None else columns) if c != out]
    schema = rows.select(*keep).withColumn(out, F.array().cast("array<double>")).schema
    shared, names = rows.sparkSession.sparkContext.broadcast(model), [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [x for part in stretches(b.column(b.num_columns - 1)) for x in shared.value.probabilities(featurize(part.to_pylist()), exclusive).tolist()]
            yield pa.record_batch([*b.columns[:-1], pa.array(p, pa.list_(pa.float64()))], names=names)

    return rows.select(*keep, value.alias("__value")).mapInArrow(run, schema)


def best_class(classes: list[str], probabilities: Column) -> tuple[Column, Column]:
    """The most probable class, the first of equals, and its probability to two places."""
    top = F.array_max(probabilities)
    return F.element_at(F.array(*map(F.lit, classes)), F.array_position(probabilities, top).cast("int")), F.round(top, 2)


# Thresholds that are tried for a label, and the rule of selection.
THRESHOLDS = [0.12, 0.15, 0.18, 0.2, 0.22, 0.25, 0.3, 0.35, 0.4]
USUAL_THRESHOLD, SECOND_LEAST, SECOND_GAP, MOST_LABELS = 0.2, 0.12, 0.08, 4


def tuned_thresholds(scored: DataFrame, classes: list[str], truth: dict[str, Column], probabilities: str = "probabilities") -> dict[str, float]:
    """The threshold of the best F1 for each class on rows with known truth; of equal ones the least, USUAL_THRESHOLD without rows."""
    aggs = []
    for k, c in enumerate(classes):
        p, true = F.element_at(probabilities, k + 1), truth[c] == 1
        for j, t in enumerate(THRESHOLDS):
            hit, said = F.count_if((p >= t) & true), F.count_if(p >= t)
            total = said + F.count_if(true)
            aggs.append(F.when(total > 0, 2 * hit / total).otherwise(0.0).alias(f"f_{k}_{j}"))
    row, out = scored.agg(F.count(F.lit(1)).alias("n"), *aggs).first(), {}
    for k, c in enumerate(classes):
        f = [row[f"f_{k}_{j}"] for j in range(len(THRESHOLDS))]
        out[c] = THRESHOLDS[int(np.argmax(f))] if row["n"] else USUAL_THRESHOLD
    return out


def selected_labels(classes: list[str], thresholds: dict[str, float], probabilities: Column) -> Column:
    """Labels with their rounded scores: those at their threshold, else the best; a close second joins a single one; four at most."""
    at = lambda k: F.round(F.element_at(probabilities, k + 1), 2)
    items = F.array(*[F.struct((-at(k)).alias("minus"), F.lit(k).alias("k"), F.lit(c).alias("label"), at(k).alias("score"), F.lit(thresholds.get(c, USUAL_THRESHOLD)).alias("t")) for k, c in enumerate(classes)])
    ranked = F.array_sort(items)
    chosen = F.filter(ranked, lambda x: x["score"] >= x["t"])
    chosen = F.when(F.size(chosen) == 0, F.slice(ranked, 1, 1)).otherwise(chosen)
    if len(classes) > 1:
        close = F.element_at(ranked, 2)["score"] >= F.greatest(F.lit(SECOND_LEAST), F.element_at(chosen, 1)["score"] - SECOND_GAP)
        chosen = F.when((F.size(chosen) == 1) & close, F.slice(ranked, 1, 2)).otherwise(chosen)
    return F.transform(F.slice(chosen, 1, MOST_LABELS), lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score")))
