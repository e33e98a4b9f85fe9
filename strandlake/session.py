"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "strandlake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (AQE, UTC, Arrow).

    On a cluster the master, memory and shuffle width come from spark-submit;
    only what is passed here overrides them.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the cluster's shared folder (``spark.checkpoint.dir``), deleted when the application ends.

    Without that setting a local folder is made, but only for a local master: executors of a cluster
    would each write to a disk of their own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", base)
    own = f"{base.rstrip('/')}/strandlake/{spark.sparkContext.applicationId}"
    path, fs = _hadoop(spark, own)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store the path names."""
    p, fs = _hadoop(spark, path)
    return fs.exists(p)


def release(spark: SparkSession) -> None:
    """Delete all tables that ``materialize`` made in this application; DataFrames that read them can't be used any more."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        path, fs = _hadoop(spark, f"{base.rstrip('/')}/strandlake/{spark.sparkContext.applicationId}")
        fs.delete(path, True)


def materialize(df: DataFrame, name: str, *, group_rows: int | None = None) -> DataFrame:
    """Cut lineage by writing a Parquet table to the shared folder and reading it back.

    Parquet's writer looks at its memory once in a hundred rows and a reader takes a whole row group: tables with rows of megabytes
    have ``group_rows`` rows in each.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    few = {} if group_rows is None else {"parquet.block.row.count.limit": str(group_rows)}
    df.write.options(compression="zstd", **few).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
