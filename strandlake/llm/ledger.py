"""Content-addressed results: each distinct text is worked on once per version, whatever number of rows has it.

A ledger is a Parquet folder of (digest, version, result columns). Rows are only ever appended, by one Spark write a
run, so a run that dies leaves no half of its rows; what two runs append twice is read once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def digest(text: Column) -> Column:
    """The 32 bytes of SHA-256 over the UTF-8 text; a null text counts as an empty one."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in whatever store the path names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def entries(spark: SparkSession, path: str, schema: str, version: str) -> DataFrame:
    """The ledger's rows of one version, one for each digest."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).filter(F.col("version") == version).dropDuplicates(["digest"])


def unseen(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(digest, text) of every distinct text without an entry. Copies are reduced before the shuffle."""
    return (docs.select(digest(docs["text"]).alias("digest"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
            .groupBy("digest").agg(F.first("text").alias("text")).join(known.select("digest"), "digest", "left_anti"))


def extend(docs: DataFrame, path: str, schema: str, version: str, work: Callable) -> DataFrame:
    """Run ``work`` (for mapInArrow, from (digest, text) to ``schema``) on all unseen texts of ``docs``, append its rows,
    and return the entries of this version."""
    spark = docs.sparkSession
    unseen(docs, entries(spark, path, schema, version)).mapInArrow(work, schema).write.mode("append").parquet(path)
    return entries(spark, path, schema, version)
