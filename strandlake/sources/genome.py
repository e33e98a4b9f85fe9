"""Sequence and annotation readers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandlake.functions.annotation import parse_location, parse_qualifier
from strandlake.operators.catalog import resolve_contigs, same_sequence_set, unmatched_contigs
from strandlake.sources.chunked import EMBL, GENBANK, SEQ_CHUNK, flat_chunks, named_chunks, read_fasta_chunks, read_gff3_chunks, whole
from strandlake.sources.detect import inspect_inputs
from strandlake.sources.lines import text_records
from strandlake.sources.splits import listing, splits

FEATURE_COLUMNS = ("chrom", "source", "type", "start_bp", "end_bp", "strand", "phase", "attributes")


def read_fasta(spark: SparkSession, path: str | list[str], *, strict: bool = True) -> DataFrame:
    """A1: (file, chrom, length, seq), for contigs that fit into a row; ``read_fasta_chunks`` takes any.

    Sequence before the first header is an error when strict; of equal names in a file the last stays; no sequence at all is an
    error when strict.
    """
    return whole(read_fasta_chunks(spark, path, strict=strict), "file", "chrom")


def read_gff3(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """A2: (file, features). Comments and rows without nine columns or whole-number ends are dropped."""
    lines = text_records(spark, path).select("file", F.trim(F.regexp_replace("value", "[\r\n]", "")).alias("v"))
    c = lines.where(~F.col("v").startswith("#")).select("file", F.split("v", "\t").alias("c")).where(F.size("c") >= 9)
    part = lambda i: F.element_at("c", i + 1)
    phase = part(7).try_cast("int")
    out = c.select(
        "file", part(0).alias("chrom"), part(1).alias("source"), part(2).alias("type"),
        (part(3).try_cast("int") - 1).alias("start_bp"), part(4).try_cast("int").alias("end_bp"),
        F.when(part(6) == "", ".").otherwise(F.substring(part(6), 1, 1)).alias("strand"),
        F.when(phase.between(0, 2), phase).otherwise(-1).cast("tinyint").alias("phase"), part(8).alias("attributes"))
    return out.where("start_bp is not null and end_bp is not null")


def read_gff3_sequences(spark: SparkSession, path: str | list[str], *, strict: bool = True) -> DataFrame:
    """A3: contigs after ``##FASTA`` in GFF3 files: (file, chrom, length, seq), put together from ``read_gff3_chunks``.

    A header without sequence is an error when strict.
    """
    return whole(read_gff3_chunks(spark, path, strict=strict), "file", "chrom")


def _flat(spark: SparkSession, path: str | list[str], form: dict, chunk: int, split: int | None) -> tuple[DataFrame, DataFrame]:
    contigs, chunks, found = flat_chunks(splits(listing(spark, path), *([split] if split else [])), form, chunk=chunk)
    lo, hi = parse_location("loc")
    attributes = F.array_join(F.filter(F.transform("quals", parse_qualifier), lambda q: q.isNotNull()), ";")
    features = found.where(F.col("loc").rlike("^[A-Za-z(<>0-9]")).select(
        "file", "chrom", F.lit("flatfile").alias("source"), "type", lo.alias("start_bp"), hi.alias("end_bp"),
        F.when(F.contains("loc", F.lit("complement")), "-").otherwise("+").alias("strand"),
        F.lit(0).cast("tinyint").alias("phase"), attributes.alias("attributes"))
    return named_chunks(contigs.where("length > 0"), chunks), features.where("end_bp > start_bp")


def read_genbank_chunks(spark: SparkSession, path: str | list[str], *, chunk: int = SEQ_CHUNK, split: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A4 for records of any length: (chunks, features) of GenBank files, read line by line in every split."""
    return _flat(spark, path, GENBANK, chunk, split)


def read_embl_chunks(spark: SparkSession, path: str | list[str], *, chunk: int = SEQ_CHUNK, split: int | None = None) -> tuple[DataFrame, DataFrame]:
    """A5 for records of any length: (chunks, features) of EMBL files."""
    return _flat(spark, path, EMBL, chunk, split)


def read_genbank(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """A4: (contigs, features) of GenBank files, for records whose sequence fits into a row. Records without sequence have
    features only; of equal names in a file the last with sequence stays."""
    chunks, features = read_genbank_chunks(spark, path)
    return whole(chunks, "file", "chrom"), features


def read_embl(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """A5: (contigs, features) of EMBL files, as ``read_genbank``."""
    chunks, features = read_embl_chunks(spark, path)
    return whole(chunks, "file", "chrom"), features


def _known_names(features: DataFrame, contigs: DataFrame) -> DataFrame:
    """Features under the genome's own contig names (B4); a name that no contig has (B5) is an error."""
    names = features.select(F.col("chrom").alias("name")).distinct()
    missing = [r["name"] for r in unmatched_contigs(names, contigs).limit(5).collect()]
    if missing:
        raise ValueError(f"annotation contigs do not match the genome: {missing}")
    found = resolve_contigs(names, contigs).select(F.col("name").alias("chrom"), F.col("chrom").alias("__chrom"))
    return features.join(found, "chrom").withColumn("chrom", F.col("__chrom")).select(*features.columns)


def load_genome(sequences: list[DataFrame], features: list[DataFrame], *, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(contigs, features) over many inputs: later inputs replace equal contig names.

    length is that of the sequence, or the largest feature end beyond it. When strict, feature contigs are resolved by
    name or alias and one without sequence is an error; otherwise it becomes a contig of its own.
    """
    feats = reduce(DataFrame.unionByName, [f.select(*FEATURE_COLUMNS) for f in features]) if features else None
    known = None
    if sequences:
        ranked = [s.select(F.lit(i).alias("__i"), "chrom", "seq") for i, s in enumerate(sequences)]
        both = reduce(DataFrame.unionByName, ranked)
        if len(sequences) > 1:
            last = both.groupBy("chrom").agg(F.max("__i").alias("__i"))
            both = both.join(last, ["chrom", "__i"], "left_semi")
        known = both.select("chrom", F.length("seq").cast("int").alias("length"), "seq")
    if known is None and (strict or feats is None):
        raise ValueError("no sequence among the inputs")
    if feats is None:
        return known, None
    if strict:
        feats = _known_names(feats, known)
    ends = feats.groupBy("chrom").agg(F.max("end_bp").cast("int").alias("__end"))
    if known is None:
        return ends.select("chrom", F.col("__end").alias("length"), F.lit(None).cast("string").alias("seq")), feats
    contigs = known.join(ends, "chrom", "left" if strict else "full_outer")
    return contigs.select("chrom", F.greatest("length", "__end").alias("length"), "seq"), feats


def load_genome_files(spark: SparkSession, path: str | list[str], *, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """``load_genome`` of all files under a path, each read by its detected kind.

    The sequence embedded in GFF3 files is the genome's if there is no other; else it has to be the same (B6).
    """
    found = inspect_inputs(spark, path).select("file", "kind", "has_embedded_sequence").collect()  # one row a file
    of = lambda *kinds: [r.file for r in found if r.kind in kinds]
    sequences, features = [], []
    if of("fasta"):
        sequences.append(read_fasta(spark, of("fasta"), strict=strict))
    if of("flatfile"):
        for reader in (read_genbank, read_embl):  # a file has records of one of the two
            contigs, feats = reader(spark, of("flatfile"))
            sequences.append(contigs)
            features.append(feats)
    if of("gff3"):
        features.append(read_gff3(spark, of("gff3")))
    embedded = [r.file for r in found if r.has_embedded_sequence]
    if embedded:
        own = read_gff3_sequences(spark, embedded, strict=strict)
        if sequences:
            main = reduce(DataFrame.unionByName, [q.select("chrom", "seq") for q in sequences])
            if strict and not same_sequence_set(own, main).first().same:
                raise ValueError("embedded GFF3 sequence does not match the reference")
        else:
            sequences.append(own)
    return load_genome(sequences, features, strict=strict)
