"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes what its predecessor kept as ``docs`` (the columns of ``documents``), and its result is written as
Parquet and read again before the next one starts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandlake.session import materialize, scratch_path


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score from the nearest labelled examples stays below the threshold."""
    from strandlake.llm.knn_toxicity import reject_toxic

    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: that of the least doc_id."""
    from strandlake.llm.order_minhash import representatives

    return representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with a benchmark item."""
    from strandlake.llm.spaced_seeds import decontaminate

    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in their texts masked."""
    from strandlake.llm.secret_ledger import redact

    return redact(docs, scratch_path(spark, "pipeline-secret-ledger"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as sequences of at most 1024 ids, one row per piece."""
    from strandlake.llm.dp_packing import pack

    return pack(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("secrets", secrets), ("packing", packing)]

#: Alignment, nearest neighbours and dynamic programming have no SQL text; the tests state them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
