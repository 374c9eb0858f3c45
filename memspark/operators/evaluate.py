"""Measures of retrieval and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import text as t


def ir_metrics(ranking: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """For each query: recall, precision, reciprocal rank, average precision and nDCG at k. ranking: query_id, unit_id, rank from 1; relevant: query_id, unit_id."""
    rel = relevant.select("query_id", "unit_id").distinct()
    total = rel.groupBy("query_id").agg(F.count("*").alias("total"))
    hits = ranking.where(F.col("rank") <= k).join(rel.withColumn("hit", F.lit(1)), ["query_id", "unit_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    upto = hits.withColumn("found", F.sum("hit").over(w))
    by = upto.groupBy("query_id").agg(
        F.sum("hit").alias("hits"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"),
        F.sum(F.when(F.col("hit") == 1, F.col("found") / F.col("rank")).otherwise(0.0)).alias("ap"),
        F.sum(F.col("hit") / F.log2(F.col("rank") + 1.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("total"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return total.join(by, "query_id", "left").select(
        "query_id",
        zero(F.col("hits") / F.col("total")).alias("recall"),
        zero(F.col("hits") / k).alias("precision"),
        zero(1 / F.col("first")).alias("rr"),
        zero(F.col("ap") / F.least(F.col("total"), F.lit(k))).alias("ap"),
        zero(F.col("dcg") / ideal).alias("ndcg"),
    )


def evidence_recall(ranking: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """query_id, recall: the share of evidence sources of which any unit is in the first k. relevant: query_id, source, unit_id."""
    top = ranking.where(F.col("rank") <= k).select("query_id", "unit_id", F.lit(True).alias("hit"))
    each = relevant.join(top, ["query_id", "unit_id"], "left").groupBy("query_id", "source").agg(F.max(F.coalesce("hit", F.lit(False)).cast("int")).alias("got"))
    return each.groupBy("query_id").agg(F.avg("got").alias("recall"))


def percentiles(rows: DataFrame, by: list[str], value: str, points: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    return rows.groupBy(*by).agg(*(F.percentile(value, F.lit(p)).alias(f"p{round(p * 100)}") for p in points))


def accuracy(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(F.avg(F.col("correct").cast("int")).alias("accuracy"), F.count("*").alias("n"))


def substring_match(rows: DataFrame, answer: str, gold: str) -> DataFrame:
    return rows.withColumn("correct", F.contains(t.answer_key(F.col(answer)), t.answer_key(F.col(gold))))
