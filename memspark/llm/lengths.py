"""Token counts as an exact histogram of encoded lengths.

Each worker counts the lengths of its own documents; only (length, count) pairs
are shuffled. Sums from the long end then answer, for every context limit, how
many documents and ids there are, what remains if longer ones are cut, and any
quantile. Sums run in two steps, over stretches of STRETCH lengths and within
them, so no task sees more than one stretch.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.llm.shared import written
from memspark.llm.tokens import default_vocabulary, encoded

STRETCH = 4096


def histogram(docs: DataFrame, vocabulary: str | None = None, text: str = "text") -> DataFrame:
    """length, docs: how many rows have so many ids, the end id included.

    Null and empty texts have the end id alone; repeated rows count each; other
    columns are not read; an empty table gives no rows. Histograms merge by
    adding docs.
    """
    vocabulary = vocabulary or default_vocabulary()

    def run(batches: Iterable) -> Iterator:
        import pyarrow as pa

        counts: Counter[int] = Counter()
        for _, _, ids in encoded(batches, vocabulary):
            counts.update(len(x) // 4 + 1 for x in ids)
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([*counts], pa.int64()), pa.array([*counts.values()], pa.int64())], ["length", "docs"])

    counted = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "length long, docs long")
    return counted.groupBy("length").agg(F.sum("docs").alias("docs"))


def sums(hist: DataFrame) -> DataFrame:
    """For each length of the histogram, as a context limit:

    docs and tokens of that length; docs_at_least and tokens_at_least from it
    upwards; docs_up_to and tokens_up_to below and at it; truncated_tokens if
    every longer document is cut to it; lost_tokens by that cut; docs_total and
    tokens_total.
    """
    rows = hist.withColumn("tokens", F.col("length") * F.col("docs")).withColumn("stretch", F.floor(F.col("length") / STRETCH))
    by = rows.groupBy("stretch").agg(F.sum("docs").alias("d"), F.sum("tokens").alias("t"))
    after = Window.orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    by = by.select("stretch", F.coalesce(F.sum("d").over(after), zero).alias("d_after"), F.coalesce(F.sum("t").over(after), zero).alias("t_after"), F.sum("d").over(every).alias("docs_total"), F.sum("t").over(every).alias("tokens_total"))
    within = Window.partitionBy("stretch").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(by, "stretch").withColumn("docs_at_least", F.col("d_after") + F.sum("docs").over(within)).withColumn("tokens_at_least", F.col("t_after") + F.sum("tokens").over(within))
    over_docs, over_tokens = F.col("docs_at_least") - F.col("docs"), F.col("tokens_at_least") - F.col("tokens")
    return out.select(
        "length",
        "docs",
        "tokens",
        "docs_at_least",
        "tokens_at_least",
        (F.col("docs_total") - over_docs).alias("docs_up_to"),
        (F.col("tokens_total") - over_tokens).alias("tokens_up_to"),
        (F.col("tokens_total") - over_tokens + over_docs * F.col("length")).alias("truncated_tokens"),
        (over_tokens - over_docs * F.col("length")).alias("lost_tokens"),
        "docs_total",
        "tokens_total",
    )


def at_limits(summed: DataFrame, limits: list[int]) -> DataFrame:
    """For any limits: how many documents are longer, and the ids left if they are cut. Limits between lengths are answered by the next length above."""
    spark = summed.sparkSession
    asked = spark.createDataFrame([(x,) for x in limits], "context long")
    above = asked.join(summed.select("length", "docs_at_least", "tokens_at_least"), F.col("length") > F.col("context"), "left")  # limits are given by the caller: a few
    first = above.groupBy("context").agg(F.min_by(F.struct("docs_at_least", "tokens_at_least"), "length").alias("a"))
    totals = summed.agg(F.max("docs_total").alias("docs_total"), F.max("tokens_total").alias("tokens_total"))
    longer, ids = F.coalesce("a.docs_at_least", F.lit(0)), F.coalesce("a.tokens_at_least", F.lit(0))
    return first.join(F.broadcast(totals)).select(F.col("context"), longer.alias("docs_over"), (F.coalesce("tokens_total", F.lit(0)) - ids + longer * F.col("context")).alias("truncated_tokens"))


def quantiles(summed: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that at least such a share of documents does not exceed."""
    asked = F.array(*(F.lit(float(x)) for x in shares))
    each = summed.select("length", "docs_up_to", "docs_total", F.explode(asked).alias("share"))
    return each.where(F.col("docs_up_to") >= F.col("share") * F.col("docs_total")).groupBy("share").agg(F.min("length").alias("length"))


def op9_length_histogram(spark, sf_dir: str) -> DataFrame:
    # texts are encoded once; sums read the pairs twice
    return sums(written(histogram(spark.read.parquet(f"{sf_dir}/documents.parquet")), "lengths"))
