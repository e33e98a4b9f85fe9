"""Variant and alignment readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandlake.functions.cigar import reference_span
from strandlake.operators.catalog import resolve_contigs, unmatched_contigs
from strandlake.sources.lines import file_heads, text_records
from strandlake.sources.splits import listing


def _basename(path):
    return F.regexp_extract(path, r"([^/]+)$", 1)


def vcf_sample_names(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, sample_names) from the column-name line. Only the header of a file is read."""
    head = file_heads(listing(spark, path), lambda line: line.startswith(b"#") or not line.strip(),
                      lambda line: line if line.startswith(b"#CHROM") else None)
    cols = F.split(F.regexp_replace("line", "[\r\n]", ""), "\t")
    return head.select("file", F.when(F.size(cols) > 9, F.slice(cols, 10, F.greatest(F.size(cols) - 9, F.lit(1)))).otherwise(
        F.array().cast("array<string>")).alias("sample_names"))


def read_vcf(spark: SparkSession, path: str | list[str], *, contigs: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """Variants with FORMAT keys and one (sample, value) per sample.

    With ``contigs`` names are resolved (B4) and, when strict, an unmatched name is an
    error. The end of a symbolic record is INFO END, of others start + REF length.
    """
    lines = text_records(spark, path).select("file", F.regexp_replace("value", "[\r\n]", "").alias("v"))
    c = lines.where("v <> ''").where(~F.col("v").startswith("#")).select("file", F.split("v", "\t").alias("c")).where(F.size("c") >= 8)
    part = lambda i: F.try_element_at("c", F.lit(i + 1))
    start = part(1).cast("int") - 1
    ref = part(3)
    info_end = F.regexp_extract(part(7), r"(?:^|;)END=([0-9]+)", 1).try_cast("int")
    symbolic = part(4).rlike(r"(^|,)<")
    rows = c.select(
        "file", _basename(F.col("file")).alias("source"), part(0).alias("chrom"), start.alias("start_bp"),
        F.when(symbolic & info_end.isNotNull(), info_end).otherwise(start + F.length(ref)).cast("int").alias("end_bp"),
        part(2).alias("id"), ref.alias("ref"), part(4).alias("alt"), part(5).try_cast("float").alias("qual"),
        part(6).alias("filter"), part(7).alias("info"),
        F.when(F.size("c") > 8, F.split(part(8), ":")).otherwise(F.array().cast("array<string>")).alias("format"),
        F.expr("case when size(c) > 9 then slice(c, 10, size(c) - 9) else cast(array() as array<string>) end").alias("__vals"))
    # Spark's text source and the listing write a local file's address differently.
    names = vcf_sample_names(spark, path).withColumn("__k", F.regexp_replace("file", "^file:/+", "/")).drop("file")
    out = rows.withColumn("__k", F.regexp_replace("file", "^file:/+", "/")).join(names, "__k", "left").drop("__k").withColumn(
        "samples", F.transform("__vals", lambda v, i: F.struct(
            F.coalesce(F.try_element_at("sample_names", i + 1), F.lit("")).alias("sample"), v.alias("value")))
    ).drop("__vals", "sample_names")
    if contigs is None:
        return out
    seen = out.select(F.col("chrom").alias("name")).distinct()
    if strict:
        missing = [r["name"] for r in unmatched_contigs(seen, contigs).limit(10).collect()]
        if missing:
            raise ValueError(f"variant contigs do not match the genome: {missing}")
    found = resolve_contigs(seen, contigs).select(F.col("chrom").alias("__chrom"), F.col("name").alias("chrom"))
    return out.join(found, "chrom").withColumn("chrom", F.col("__chrom")).drop("__chrom")


def _in_genome(rows: DataFrame, contigs: DataFrame, *columns: str) -> DataFrame:
    """Rows under the genome's own contig names; a name that no contig has is an error, no name stays none."""
    for c in columns:
        names = rows.where(F.col(c).isNotNull()).select(F.col(c).alias("name")).distinct()
        missing = [r["name"] for r in unmatched_contigs(names, contigs).limit(5).collect()]
        if missing:
            raise ValueError(f"alignment contigs do not match the genome: {missing}")
        found = resolve_contigs(names, contigs).select(F.col("name").alias(c), F.col("chrom").alias("__chrom"))
        rows = rows.join(found, c, "left").withColumn(c, F.col("__chrom")).select(*rows.columns)
    return rows


def read_alignments(spark: SparkSession, path: str | list[str], *, parquet: bool = False, contigs: DataFrame | None = None) -> DataFrame:
    """Alignments from SAM text, or from Parquet with the canonical columns; with ``contigs`` under their names."""
    if parquet:
        rows = spark.read.parquet(path)
        return rows if contigs is None else _in_genome(rows, contigs, "chrom", "mate_chrom")
    lines = text_records(spark, path).select("file", F.regexp_replace("value", "[\r\n]", "").alias("v"))
    c = lines.where(~F.col("v").rlike("^@[A-Z][A-Z](\t|$)")).select("file", "v", F.split("v", "\t").alias("c")).where(F.size("c") >= 11)
    part = lambda i: F.element_at("c", i + 1)
    name = lambda x: F.when(x != "*", x)
    mate = F.when(part(6) == "=", name(part(2))).otherwise(name(part(6)))
    rows = c.select(
        _basename(F.col("file")).alias("source"), part(0).alias("name"), part(1).cast("int").alias("flags"),
        name(part(2)).alias("chrom"), (part(3).cast("int") - 1).alias("start_bp"), part(4).cast("int").alias("mapq"),
        F.when(part(5) == "*", "").otherwise(part(5)).alias("cigar"), mate.alias("mate_chrom"),
        (part(7).cast("int") - 1).alias("mate_pos"), part(8).cast("int").alias("tlen"),
        F.when(part(9) == "*", "").otherwise(part(9)).alias("read_seq"),
        F.nullif(F.regexp_extract("v", "\tMD:Z:([^\t]*)", 1), F.lit("")).alias("md"))
    rows = rows.withColumn("end_bp", F.col("start_bp") + reference_span("cigar", F.length("read_seq")))
    return rows if contigs is None else _in_genome(rows, contigs, "chrom", "mate_chrom")
