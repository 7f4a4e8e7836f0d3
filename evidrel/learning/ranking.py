"""A learned ranker over the features of (query, document) rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidrel.learning import hashed, linear

#: First step of the descent on standardised features.
FIRST_STEP = 0.5
#: Fixed value: the baseline's part of a hybrid score.
BASELINE_PART = 0.35


@dataclass
class Ranker:
    """P(relevant) of standardised features."""

    names: list[str]
    mean: list[float]
    std: list[float]
    w: list[float]
    bias: float

    def score(self) -> Column:
        """The probability to four places, from columns named as the features; null features count as 0."""
        z = F.lit(self.bias)
        for n, m, s, w in zip(self.names, self.mean, self.std, self.w, strict=True):
            z = z + (F.coalesce(F.col(n).cast("double"), F.lit(0.0)) - m) / s * w
        return F.round(1 / (1 + F.exp(-z)), 4)


def fit(rows: DataFrame, names: list[str], relevance: str, key: Column, **more) -> Ranker | None:
    """A ranker from rows with features and a relevance (1 and more: relevant); None where all are alike.

    Features are standardised by their mean and deviation over all rows (one of
    0 leaves them as they are); both kinds of rows weigh alike.
    """
    x = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names]
    good = (F.col(relevance) >= 1).cast("int")
    stats = rows.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(x)], *[F.stddev_pop(c).alias(f"s{k}") for k, c in enumerate(x)], F.count(F.lit(1)).alias("n"), F.sum(good).alias("good")).first()
    if not stats["n"] or stats["good"] in (0, stats["n"]):
        return None
    mean = [stats[f"m{k}"] for k in range(len(names))]
    std = [stats[f"s{k}"] or 1.0 for k in range(len(names))]
    value = F.array(*[(c - m) / s for c, m, s in zip(x, mean, std, strict=True)])
    weight = F.when(good == 1, stats["n"] / (2 * stats["good"])).otherwise(stats["n"] / (2 * (stats["n"] - stats["good"])))
    model = linear.fit(rows.select(key.alias("row_key"), value.alias("value"), good.alias("good"), weight.alias("weight")), "row_key", "value", {"good": F.col("good")}, len(names), hashed.dense, weights={"good": F.col("weight")}, first=FIRST_STEP, **more)
    return Ranker(names, mean, std, np.asarray(model.w[0]).tolist(), float(model.bias[0]))


def hybrid(baseline: Column, learned: Column) -> Column:
    """The weighted mean of both scores, between 0 and 1, to four places."""
    return F.round(F.least(F.greatest(baseline * BASELINE_PART + learned * (1 - BASELINE_PART), F.lit(0.0)), F.lit(1.0)), 4)


def with_defaults(queries: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """queries (key, ...) with what is known of them; lists, texts and labels that are not are given their defaults."""
    out = queries.join(known, key, "left")
    for f in known.schema:
        if f.name != key:
            kind = f.dataType.simpleString()
            default = F.array().cast(kind) if kind.startswith("array") else F.lit("unknown" if f.name in ("product_type", "wanted") else "unspecified" if f.name == "time_scope" else "") if kind == "string" else None
            if default is not None:
                out = out.withColumn(f.name, F.coalesce(F.col(f.name), default))
    return out
