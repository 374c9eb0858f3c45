"""Tables of a folder, and memory units made from its documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Milliseconds of the first ingest, and between two documents.
EPOCH, STEP = 1_704_067_200_000, 60_000
#: Labels that go to every task at most, so that texts meet them where they lie.
FEW_LABELS = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; times without a zone are read as UTC (set the session's time zone to UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*(F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes))


def units(spark: SparkSession, sf_dir: str, parts: int | None = None, few: bool = False) -> DataFrame:
    """A flat view of memory units: documents, with what their labels say as lifecycle and importance. With ``parts`` the texts meet their labels in so many tasks, unsorted, by a hash of a task's labels; with ``few`` where they lie, if there are FEW_LABELS at most."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    if few and labels.count() <= FEW_LABELS:
        labels = F.broadcast(labels)
    elif parts:
        d, labels = d.repartition(parts, "doc_id"), labels.repartition(parts, "doc_id").hint("shuffle_hash")
    both = d.join(labels, "doc_id", "left")
    return both.select(
        F.concat(F.lit("d"), "doc_id").alias("unit_id"),
        F.coalesce("source", F.lit("")).alias("space"),
        F.coalesce("lang", F.lit("")).alias("user_id"),
        F.coalesce("text", F.lit("")).alias("content"),
        "n_chars",
        F.when(F.col("toxic") == 1, "archived").when(F.col("quality") == 0, "superseded").otherwise("active").alias("lifecycle"),
        F.when(F.col("n_chars") < 500, "working").when(F.col("n_chars") < 2000, "episodic").when(F.col("n_chars") < 5000, "semantic").otherwise("core").alias("tier"),
        F.col("quality").cast("double").alias("importance"),
        (F.lit(EPOCH) + F.col("doc_id") * STEP).alias("t_ingest"),
        F.when(F.col("quality").isNotNull(), F.lit(EPOCH) + F.col("n_chars") * STEP).alias("t_event"),
        F.array("lang", "source").alias("tags"),
    )


def engine_units(spark: SparkSession, sf_dir: str, parts: int | None = None, few: bool = False) -> DataFrame:
    """The same units with the columns that the engine's verbs need beyond these."""
    none = lambda kind: F.lit(None).cast(kind)
    return units(spark, sf_dir, parts, few).withColumns({"t_valid": F.col("t_ingest"), "t_invalid": none("long"), "t_message": F.col("t_ingest"), "provenance": F.array().cast("array<string>"), "supersedes": none("string")})


UNITS_SQL = f"""units AS (SELECT 'd' || d.doc_id AS unit_id, coalesce(source, '') AS space, coalesce(lang, '') AS user_id, coalesce(text, '') AS content, n_chars,
  CASE WHEN toxic = 1 THEN 'archived' WHEN quality = 0 THEN 'superseded' ELSE 'active' END AS lifecycle,
  CASE WHEN n_chars < 500 THEN 'working' WHEN n_chars < 2000 THEN 'episodic' WHEN n_chars < 5000 THEN 'semantic' ELSE 'core' END AS tier,
  quality::double AS importance, {EPOCH} + d.doc_id * {STEP} AS t_ingest, CASE WHEN quality IS NOT NULL THEN {EPOCH} + n_chars * {STEP} END AS t_event, [lang, source] AS tags
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
