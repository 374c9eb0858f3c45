"""From raw documents to packed training sequences, in five stages.

Each stage works on all that the one before kept, and what it decides takes
effect. Between stages the documents are written to the shared folder and read
again, so a lost executor costs one stage's tasks at most. No SQL can express
the result (fingerprints, boosted trees, a tokenizer): tests hold it against a
brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from memspark.llm import similar
from memspark.llm.decontam import decontaminate
from memspark.llm.packing import pack
from memspark.llm.pii import redact_stage
from memspark.llm.quality import quality_stage
from memspark.llm.shared import drop, made, written
from memspark.llm.simhash import dedup_stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or their group's cutoffs go."""
    return quality_stage(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8) stays."""
    return dedup_stage(docs, similar.rooted)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay, personal data in them is replaced."""
    return redact_stage(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents' ids in sequences."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, first = spark.read.parquet(f"{sf_dir}/documents.parquet"), made()
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
            # what the stage was made from, and its own tables, are not needed any more
            drop(spark, first, made() - 1)
    return docs
