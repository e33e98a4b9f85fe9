"""Input kinds and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandlake.sources.chunked import fasta_marks
from strandlake.sources.lines import first_lines
from strandlake.sources.splits import listing, splits

# Extensions by kind and the compression suffixes dropped before them.
EXTENSIONS = {
    "fasta": "fa fasta fna ffn frn faa",
    "gff3": "gff gff3",
    "flatfile": "embl gb gbk genbank",
    "vcf": "vcf",
}
COMPRESSED = "gz bgz bz2 xz zst zstd"


def kind_by_content(line: Column) -> Column:
    """Kind told by the first non-blank line, NULL when it tells nothing."""
    tabs = F.length(line) - F.length(F.translate(line, "\t", ""))
    return (
        F.when(line.startswith(">"), "fasta")
        .when(line.startswith("##gff-version") | (~line.startswith("#") & (tabs >= 8)), "gff3")
        .when(line.startswith("##fileformat=VCF") | line.startswith("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO"), "vcf")
        .when(line.startswith("LOCUS ") | line.startswith("ID   "), "flatfile"))


def kind_by_name(path: Column) -> Column:
    """Kind told by the extension."""
    base = F.regexp_replace(F.lower(path), rf"\.({'|'.join(COMPRESSED.split())})$", "")
    ext = F.regexp_extract(base, r"\.([^./]*)$", 1)
    return F.coalesce(*[F.when(ext.isin(*e.split()), k) for k, e in EXTENSIONS.items()], F.lit("unknown"))


def detect_input_kinds(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, kind), by content first, by extension where content says nothing. Of a file only its first lines are read."""
    files = listing(spark, path)
    heads = first_lines(files).select("file", kind_by_content(F.col("line")).alias("__kind"))
    return files.join(heads, "file", "left").select("file", F.coalesce("__kind", kind_by_name(F.col("file"))).alias("kind"))


def gather_inputs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Known files under a path, recursively, in name order."""
    return detect_input_kinds(spark, path).where("kind <> 'unknown'").orderBy("file")


def inspect_inputs(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A10: (file, kind, has_sequence, has_annotation, has_embedded_sequence, has_variants).

    Only GFF3 files are read beyond their first lines, in splits, for the line that begins embedded sequence.
    """
    kinds = detect_input_kinds(spark, path)
    marks = fasta_marks(splits(kinds.where("kind = 'gff3'").join(listing(spark, path), "file"))).select("file", F.lit(True).alias("__m"))
    embedded = (F.col("kind") == "gff3") & F.coalesce("__m", F.lit(False))
    return kinds.join(marks, "file", "left").select(
        "file", "kind", (F.col("kind").isin("fasta", "flatfile") | embedded).alias("has_sequence"),
        (F.col("kind") == "gff3").alias("has_annotation"), embedded.alias("has_embedded_sequence"),
        (F.col("kind") == "vcf").alias("has_variants"))
