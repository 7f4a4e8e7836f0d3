"""Sums of long vectors over tasks, in chunks, so that no task and no row holds them all; stretches of columns, so that no task holds the features of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Numbers of a chunk; tasks that give a vector at most.
CHUNK, MOST_TASKS = 4096, 256
SCHEMA = "k long, c long, n double, w binary"
#: Rows, and bytes of text, that a task turns into features at a time.
STRETCH_ROWS, STRETCH_BYTES = 256, 1 << 20


def stretches(column: pa.Array) -> Iterator[pa.Array]:
    """A column of a batch in parts of at most STRETCH_ROWS rows and about STRETCH_BYTES bytes of text; a longer text is a part of its own."""
    size = np.zeros(len(column), np.int64)
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, lo = np.cumsum(size), 0
    while lo < len(column):
        fits = int(np.searchsorted(ends, ends[lo] - size[lo] + STRETCH_BYTES, "right"))
        hi = min(max(fits, lo + 1), lo + STRETCH_ROWS)
        yield column.slice(lo, hi - lo)
        lo = hi


def chunks(k: int, vector: np.ndarray, n: float) -> Iterator[pa.RecordBatch]:
    """Rows of vector k of a task; n is added up along with it."""
    for c, lo in enumerate(range(0, len(vector), CHUNK)):
        yield pa.record_batch([pa.array([k], pa.int64()), pa.array([c], pa.int64()), pa.array([n], pa.float64()), pa.array([vector[lo : lo + CHUNK].tobytes()], pa.binary())], names=["k", "c", "n", "w"])


def summed(rows: DataFrame) -> tuple[np.ndarray, float]:
    """The sums of all tasks' vectors, one row each k, and of n. At most MOST_TASKS tasks gave each chunk."""

    def total(f: pd.DataFrame) -> pd.DataFrame:
        w = np.sum([np.frombuffer(x) for x in f["w"]], axis=0)
        return pd.DataFrame({"k": f["k"][:1], "c": f["c"][:1], "n": [f["n"].sum()], "w": [w.tobytes()]})

    got = rows.groupBy("k", "c").applyInPandas(total, SCHEMA).toPandas().sort_values(["k", "c"])  # one vector each k
    return np.array([np.concatenate([np.frombuffer(x) for x in f["w"]]) for _, f in got.groupby("k")]), float(got["n"].iloc[0]) if len(got) else 0.0
