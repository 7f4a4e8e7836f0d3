"""The corpus pipeline: documents through five operators, each stage a table.

Every function takes (spark, docs, sf_dir), with docs the rows the stage before
kept, and returns a DataFrame with the columns of documents; the last adds the
piece ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidrel.llm import jaccard, langid, linededup, mixing, pieces
from evidrel.llm.common import table, written
from evidrel.llm.queries import DOMAIN_WEIGHTS, PIECE_MODEL, label_domains

#: Least probability of its language that keeps a document.
LEAST_SCORE = 0.4
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter or whose best language stays below LEAST_SCORE.

    Null and empty texts have no letter. Without any labelled row there is
    nothing to learn from, and no document is rejected but those without a
    letter. Equal best scores go to the language first in order; rows that
    repeat an id are judged one by one; an empty table stays empty; columns
    other than those of documents are left out.
    """
    model = langid.fit(docs)
    out = langid.identify(docs.select(*COLUMNS, F.col("text").rlike(r"\p{L}").alias("has_letter")), model)
    rejected = ~F.col("has_letter") if model is None else (F.col("lang_pred") == langid.UNDETERMINED) | (F.col("score") < LEAST_SCORE)
    return out.where(~F.coalesce(rejected, F.lit(True))).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated long lines stay in the largest id that holds them; a document that loses all its text goes.

    Null and empty texts have one empty line, which stays; a row without an id
    counts for nothing and keeps its lines; rows that repeat an id count once; an
    empty table stays empty.
    """
    out = linededup.drop_repeated_lines(docs.select(*COLUMNS))
    out = out.where((F.col("n_dropped") == 0) | F.col("kept_text").rlike(r"\S"))
    return out.withColumn("text", F.col("kept_text")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents whose five-word shingles are 80 % alike, the smallest id stays.

    Texts without words are alike to nothing and stay; so do rows without an id;
    rows that repeat an id are one document and stay or go together; an empty
    table stays empty.
    """
    classes = jaccard.join_classes(docs, n=5, percent=80)
    gone = classes.where("doc_id != component_id").select("doc_id")
    return docs.select(*COLUMNS).join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, stay or go as their fitted rates say.

    Rates are fitted so that the domains' expected tokens meet DOMAIN_WEIGHTS;
    rates of documents that are most probably clean are fitted among those of at
    least 1, so these stay, and the clean domain keeps its tokens. A text without
    words has the prior as posterior; rows that repeat an id, and ties, get equal
    decisions where their texts are equal, else each id that of its largest
    number of copies; without labels all rates are fitted to uniform posteriors;
    an empty table stays empty.
    """
    mixed = mixing.mix(docs, label_domains(spark, sf_dir), DOMAIN_WEIGHTS, keep="clean")
    copies = mixed.groupBy(F.col("doc_id").alias("id")).agg(F.max("copies").alias("copies")).where("copies > 0")
    out = docs.select(*COLUMNS).join(copies.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")))
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents and the piece ids of each text.

    Null and empty texts have no pieces; every row gives one row, repeated ids
    and texts alike; of segmentations with equal scores the codec's rule takes
    one; an empty table stays empty.
    """
    return pieces.encode(docs.select(*COLUMNS), pieces.read_model(PIECE_MODEL))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("encode", encode),
]

#: Trained models and an iterative fit decide, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
