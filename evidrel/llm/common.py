"""What the operators of this subpackage share: scratch folders, splits, text buffers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch handed to Python; texts may be long.
ARROW_ROWS, ARROW_BYTES = 500, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, columns: list, made: list[str]) -> list[Column]:
    """The columns to pass through: those named, else all but such as an operator makes under the same name."""
    taken = {c.lower() for c in made}
    return [F.col(c) if isinstance(c, str) else c for c in columns] or [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]


def arrow_rows(spark: SparkSession) -> None:
    """Keeps the Arrow batches of Python stages small. All operators set the same, so the order of lazy plans is no matter."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``).

    Where the session names none (tests), one below the warehouse is set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, partition_by: list[str] | None = None) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage and outlives executors."""
    path = scratch(df.sparkSession, what)
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a table's folder once nothing reads it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop_scratch(*tables: DataFrame) -> None:
    """Deletes the files of tables made by ``written`` once nothing reads them."""
    for df in tables:
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            drop_path(df.sparkSession, name)


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % n


def byte_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array (null: empty) and the n + 1 offsets of its rows."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_utf8()), "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or not len(texts) or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


#: Bytes of text that an operator turns into numbers at a time.
BLOCK_BYTES = 2 << 20


def byte_blocks(offsets: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit values."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashed_sample(df: DataFrame, key: str, by: Column, rows: int) -> DataFrame:
    """At most ``rows`` rows of each value of ``by``, those with the smallest hash of ``key``.

    Every value takes part, however many there are. Of rows that repeat a key
    one takes part, that with the smallest hash of all its columns, so the bound
    holds for any data. Keys are chosen in narrow passes: by a share of each
    value's keys that leaves about four times as many as are wanted, then by
    rank. Only the fit of a classifier on a bounded sample uses it.
    """
    out = df.withColumns({"class_value": by.cast("string"), "__h": F.xxhash64(F.col(key), F.lit(7))}).where("class_value is not null")
    narrow = out.select("class_value", "__h")
    counts = narrow.groupBy("class_value").agg(F.approx_count_distinct("__h").alias("__k"))
    near = narrow.join(counts, "class_value").where(F.pmod("__h", F.lit(1 << 30)) < F.lit(float(4 * rows << 30)) / F.col("__k")).distinct()
    chosen = near.withColumn("__n", F.row_number().over(Window.partitionBy("class_value").orderBy(F.pmod("__h", F.lit(1 << 30)), "__h"))).where(F.col("__n") <= rows)
    some = out.join(F.broadcast(chosen.select("class_value", "__h")), ["class_value", "__h"], "left_semi")  # rows of 24 bytes for each value
    one = Window.partitionBy("class_value", "__h").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    return some.withColumn("__n", F.row_number().over(one)).where("__n = 1").drop("__n", "__h")
