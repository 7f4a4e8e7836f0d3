"""Quality metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    p, r = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0), F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    return F.when((p == 0) & (r == 0), 0.0).otherwise(F.round(2 * p * r / (p + r), 4))


def accuracy(df: DataFrame) -> DataFrame:
    """Share of equal labels among rows with an expected one."""
    return df.where("expected is not null and expected != ''").agg(F.coalesce(F.round(F.avg(F.coalesce(F.col("expected") == F.col("predicted"), F.lit(False)).cast("int")), 4), F.lit(0.0)).alias("accuracy"))


def micro_f1(df: DataFrame) -> DataFrame:
    """Over rows of two label arrays."""
    sums = df.agg(
        F.sum(F.size(F.array_intersect("expected", "predicted"))).alias("tp"),
        F.sum(F.size(F.array_except("predicted", "expected"))).alias("fp"),
        F.sum(F.size(F.array_except("expected", "predicted"))).alias("fn"),
    )
    return sums.select("tp", "fp", "fn", f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("micro_f1"))


def per_label_f1(df: DataFrame) -> DataFrame:
    each = df.withColumn("label", F.explode(F.array_union("expected", "predicted")))
    e, p = F.array_contains("expected", F.col("label")), F.array_contains("predicted", F.col("label"))
    counts = each.groupBy("label").agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"))
    return counts.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


def macro_f1(df: DataFrame) -> DataFrame:
    return per_label_f1(df).agg(F.coalesce(F.round(F.avg("f1"), 4), F.lit(0.0)).alias("macro_f1"))


def confusion(df: DataFrame) -> DataFrame:
    return df.where("expected is not null and expected != ''").groupBy("expected", "predicted").agg(F.count(F.lit(1)).alias("n"))


def ranked(df: DataFrame) -> DataFrame:
    """Rows (query_id, doc_id, score, relevance) with their rank."""
    return df.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")))


def mrr(df: DataFrame, k: int = 10) -> DataFrame:
    """Mean over queries of 1 / rank of the first relevant document among k."""
    first = ranked(df).groupBy("query_id").agg(F.min(F.when((F.col("relevance") > 0) & (F.col("rank") <= k), F.col("rank"))).alias("r"))
    return first.agg(F.round(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 4).alias("mrr"))


def ndcg(df: DataFrame, k: int = 10, graded: bool = True) -> DataFrame:
    """Per query; gains 2 ** relevance - 1, or 1 for any relevance, over log2(rank + 1)."""
    gain = F.pow(F.lit(2.0), F.col("relevance")) - 1 if graded else (F.col("relevance") > 0).cast("double")
    best = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("relevance")))
    rows = ranked(df).withColumn("ideal", best).withColumn("gain", gain)
    part = lambda r: F.sum(F.when(F.col(r) <= k, F.col("gain") / F.log2(F.col(r) + 1)).otherwise(0.0))
    return rows.groupBy("query_id").agg(part("rank").alias("dcg"), part("ideal").alias("idcg")).select("query_id", F.when(F.col("idcg") > 0, F.round(F.col("dcg") / F.col("idcg"), 4)).otherwise(0.0).alias("ndcg"))


def recall_at(df: DataFrame, k: int) -> DataFrame:
    """Part of queries with some relevant document that have one among k."""
    per = ranked(df).groupBy("query_id").agg(F.max("relevance").alias("any"), F.max(F.when(F.col("rank") <= k, F.col("relevance")).otherwise(0)).alias("hit"))
    return per.where("any > 0").agg(F.round(F.avg((F.col("hit") > 0).cast("int")), 4).alias("recall"))


def threshold_verdicts(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """(metric, value, threshold, passed) of one row of metric columns."""
    each = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value"), F.lit(v).alias("threshold")) for k, v in thresholds.items()])
    return metrics.select(F.inline(each)).withColumn("passed", F.col("value") >= F.col("threshold"))


def best_threshold(scored: DataFrame, thresholds: list[float]) -> DataFrame:
    """Of each label the threshold with the best F1, the first of equals."""
    each = scored.withColumn("t", F.explode(F.array(*map(F.lit, thresholds))))
    hit = F.col("score") >= F.col("t")
    counts = each.groupBy("label", "t").agg(F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") == 0)).alias("fp"), F.count_if(~hit & (F.col("y") == 1)).alias("fn"))
    counts = counts.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))
    return counts.groupBy("label").agg(F.max_by("t", F.struct("f1", -F.col("t"))).alias("threshold"), F.max("f1").alias("f1"))


def majority(df: DataFrame, key: str, label: str, pos: str) -> DataFrame:
    """(key, label) that most rows have; of equals the one seen first."""
    counts = df.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first"))
    return counts.groupBy(key).agg(F.max_by(label, F.struct("n", -F.col("first"))).alias(label))
