"""Size of the batches that Spark hands to Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Rows and bytes of a batch; texts may be long. The operators of ``llm`` set the same.
ARROW_ROWS, ARROW_BYTES = 500, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Keeps the batches of Python stages small, whatever the size of a partition."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
