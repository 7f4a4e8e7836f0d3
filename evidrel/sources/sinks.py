"""Sinks: JSON lines, CSV, family folders, artifact bundles, replacement of a source."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str) -> None:
    """One object a line; nulls stay as fields, non-ASCII text as it is."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """A header and the fields in the order given."""
    df.select(*fields).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def by_family(df: DataFrame, path: str, column: str = "sample_family") -> None:
    """A folder for each family."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)


def artifact(df: DataFrame, path: str, manifest: dict) -> None:
    """Rows and a manifest in a folder that must not exist yet."""
    spark = df.sparkSession
    df.write.mode("errorifexists").json(f"{path}/rows")
    spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{path}/manifest")


def document_mart(df: DataFrame, path: str) -> DataFrame:
    """Documents as JSON lines with sorted keys; returns their counts by source type."""
    df.select(*sorted(df.columns)).write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return df.groupBy("source_type").agg(F.count(F.lit(1)).alias("n"))


def replace_partition(df: DataFrame, path: str, column: str = "source_id") -> None:
    """Overwrites only the partitions that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
