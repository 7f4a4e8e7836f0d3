"""Scans: CSV, JSON, JSON lines, text, BIO files, qrel folders, manifests, JDBC."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: File suffixes that a discovery takes up.
SUFFIXES = ("csv", "tsv", "json", "jsonl", "txt", "parquet", "xml", "html", "md", "gz")


def csv(spark: SparkSession, path: str, columns: list[str] | None = None, sep: str = ",") -> DataFrame:
    """A CSV file with a header, every column a string."""
    reader = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"')
    if columns:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


def json_array(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A file that holds one object or an array of them."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None, tolerant: bool = False) -> DataFrame:
    """JSON lines; blank lines are skipped. Malformed lines fail, or are left out if tolerant."""
    reader = spark.read.option("mode", "DROPMALFORMED" if tolerant else "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)


def by_suffix(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """.jsonl as lines, .csv and .tsv with a header, .parquet, anything else as a JSON array."""
    suffix = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == "jsonl":
        return jsonl(spark, path, schema)
    if suffix in ("csv", "tsv"):
        return csv(spark, path, sep="\t" if suffix == "tsv" else ",")
    return spark.read.parquet(path) if suffix == "parquet" else json_array(spark, path, schema)


def resolve(name: str, seed: str, runtime: str | None = None, variable: str | None = None) -> str:
    """A table's place: an environment variable, else the runtime folder if it has one, else the seed folder."""
    if variable and os.environ.get(variable):
        return os.environ[variable]
    if runtime and os.path.exists(os.path.join(runtime, name)):
        return os.path.join(runtime, name)
    return os.path.join(seed, name)


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(text): trimmed lines that are not blank."""
    return spark.read.text(path).select(F.trim("value").alias("text")).where("text != ''")


def discover(spark: SparkSession, root: str, skip: str = "records.jsonl") -> DataFrame:
    """(path, source_id, version) of the data files below root/<source_id>/<version>/, in order."""
    pattern = "*.{" + ",".join(SUFFIXES) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
    parts = F.split(F.regexp_replace("path", r"^.*?\Q" + root.rstrip("/") + r"\E/", ""), "/")
    files = files.where(~F.endswith("path", F.lit("/" + skip)))
    return files.select("path", F.get(parts, F.lit(0)).alias("source_id"), F.get(parts, F.lit(1)).alias("version")).orderBy("path")


def bio(spark: SparkSession, path: str) -> DataFrame:
    """(path, sentence, tokens, tags): blank lines part sentences; a token without a tag has O."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    parts = whole.select("path", F.posexplode(F.split("value", r"\r?\n\s*\n")).alias("sentence", "block"))
    lines = F.filter(F.transform(F.split("block", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    cut = F.transform(lines, lambda x: F.split(x, r"\s+"))
    out = parts.select("path", "sentence", F.transform(cut, lambda x: F.get(x, F.lit(0))).alias("tokens"), F.transform(cut, lambda x: F.when(F.size(x) > 1, F.element_at(x, -1)).otherwise("O")).alias("tags"))
    return out.where("size(tokens) > 0")


def qrels(spark: SparkSession, corpus: DataFrame, queries: DataFrame, judged: DataFrame, constant: int | None = None, referenced_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Judgements of known queries (query_id, query, doc_id, relevance), and the corpus.

    constant replaces every relevance; referenced_only keeps documents that are judged.
    """
    rel = F.lit(constant) if constant is not None else F.coalesce(F.col("relevance").try_cast("int"), F.lit(0))
    rows = judged.join(queries.select("query_id", "query"), "query_id").select("query_id", "query", "doc_id", rel.alias("relevance"))
    return rows, corpus.join(rows.select("doc_id").distinct(), "doc_id", "left_semi") if referenced_only else corpus


def training_rows(rows: DataFrame, limit: int = 256) -> DataFrame:
    """Training rows with the query cut to ``limit`` characters and label columns split at commas and bars."""
    from evidrel.functions.text import label_list

    out = rows.withColumn("query", F.substring("query", 1, limit))
    for c, kind in rows.dtypes:
        if c.endswith("_labels") and kind == "string":
            out = out.withColumn(c, label_list(F.col(c)))
    return out


def fresh_cache(spark: SparkSession, path: str, families: list[str]) -> bool:
    """Whether records at path can be used again: some are there, of every family asked for."""
    rows = spark.read.option("mode", "DROPMALFORMED").json(path)
    if "sample_family" not in rows.columns:
        return False
    have = {r[0] for r in rows.where(F.col("sample_family").isin(families)).select("sample_family").distinct().collect()}
    return have >= set(families) and bool(have)


def jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A database table, read in ``parts`` ranges of a numeric key."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    reader = reader.option("partitionColumn", key).option("lowerBound", low).option("upperBound", high).option("numPartitions", parts)
    return reader.options(**options).load()


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """An ascending ordinal (with gaps) for operators in which the first row wins."""
    return rows.orderBy(*order).withColumn("ord", F.monotonically_increasing_id())
