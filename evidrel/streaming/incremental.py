"""Documents that arrive as files, added to a mart exactly once by content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evidrel.functions.text import clean, content_key


def arriving(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines that are put into a folder, one batch of files after another."""
    return spark.readStream.schema(schema).json(path)


def keyed(docs: DataFrame) -> DataFrame:
    """Cleaned title and body and the key that equal documents share."""
    docs = docs.withColumns({"title": clean(F.col("title")), "body": clean(F.col("body"))})
    return docs.withColumn("content_key", content_key(F.col("source_type"), F.col("title"), F.col("body")))


def into_mart(docs: DataFrame, mart: str, checkpoint: str) -> StreamingQuery:
    """Appends documents whose content the mart does not hold; a batch that is run again adds nothing."""

    def add(batch: DataFrame, _: int) -> None:
        spark, new = batch.sparkSession, batch.dropDuplicates(["content_key"])
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(mart)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            new = new.join(spark.read.parquet(mart).select("content_key"), "content_key", "left_anti")
        new.write.mode("append").parquet(mart)

    return keyed(docs).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
