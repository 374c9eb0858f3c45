"""A learned reranker: weights of hit features from pairs of a better and a worse hit of one query, applied as columns.

The weight of a feature is the least-squares step on the differences of all
such pairs, feature by feature: their sum over their sum of squares. Both follow
from sums over the better and the worse hits of each query, so no pair is made
and the fit is one aggregation over any number of labelled rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions import text as t

#: Characters that prose has few of.
SYMBOLS = "[#*$%&|<>!]"


def hit_features(content: Column, words: list[str]) -> dict[str, Column]:
    """What a hit's text is like: its length, how often its words repeat, its share of symbols, and what the query finds of it."""
    tokens = t.tokens(content)
    n = F.greatest(F.size(tokens), F.lit(1))
    return {
        "length": F.log1p(F.size(tokens).cast("double")),
        "distinct": F.size(F.array_distinct(tokens)) / n,
        "symbols": F.regexp_count(content, F.lit(SYMBOLS)) / F.greatest(F.length(content), F.lit(1)),
        "overlap": t.overlap(tokens, words),
    }


def fit(rows: DataFrame, query: str, better: Column, features: list[str]) -> dict[str, float]:
    """One weight for each feature. Rows with a null label or feature teach nothing; a query without both kinds has no pair; a feature that never differs weighs 0."""
    good = reduce(lambda a, b: a & b, (F.col(f).isNotNull() for f in features))
    own = rows.where(good).withColumn("_y", better.cast("int")).where("_y is not null")
    sums = [F.sum("_y").alias("p"), F.count("*").alias("n")]
    for f in features:
        x, y = F.col(f).cast("double"), F.col("_y")
        sums += [F.sum(x * y).alias(f"p_{f}"), F.sum(x * (1 - y)).alias(f"m_{f}"), F.sum(x * x * y).alias(f"pp_{f}"), F.sum(x * x * (1 - y)).alias(f"mm_{f}")]
    by = own.groupBy(query).agg(*sums).withColumn("m", F.col("n") - F.col("p"))
    out = []
    for f in features:
        diff = F.col("m") * F.col(f"p_{f}") - F.col("p") * F.col(f"m_{f}")
        square = F.col("m") * F.col(f"pp_{f}") + F.col("p") * F.col(f"mm_{f}") - 2 * F.col(f"p_{f}") * F.col(f"m_{f}")
        out.append(F.coalesce(F.sum(diff) / F.nullif(F.sum(square), F.lit(0.0)), F.lit(0.0)).alias(f))
    return by.agg(*out).first().asDict()


def scored(rows: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Rows with score, the weighted sum of their features; null features count as 0."""
    total: Column = F.lit(0.0)
    for f, w in weights.items():
        total = total + F.lit(float(w)) * F.coalesce(F.col(f).cast("double"), F.lit(0.0))
    return rows.withColumn("score", total)
