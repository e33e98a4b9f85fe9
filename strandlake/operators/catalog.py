"""Catalogue, naming and integrity operators (B1-B11). Rows are contigs or genomes, not reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandlake.functions.dna import col
from strandlake.operators.prefix import STEP, global_rank, prefix_sums, previous_row

COMPARE_GAP = 50


def list_contigs(contigs: DataFrame, *, reversed_contigs: DataFrame | None = None) -> DataFrame:
    """B1: (contig_id, chrom, length, reversed), dense 0-based ids in name order."""
    ids = global_rank(contigs.select("chrom", "length"), ["chrom"], "contig_id")
    if reversed_contigs is None:
        return ids.withColumn("reversed", F.lit(False))
    marks = reversed_contigs.select("chrom", F.lit(True).alias("reversed")).distinct()
    return ids.join(marks, "chrom", "left").withColumn("reversed", F.coalesce("reversed", F.lit(False)))


def annotation_counts(contigs: DataFrame, features: DataFrame) -> DataFrame:
    """B2: features per contig, zero included."""
    counts = features.groupBy("chrom").agg(F.count("*").alias("n"))
    return contigs.select("chrom").join(counts, "chrom", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def normalize_chrom_alias(name: Column | str) -> Column:
    """Drop a trailing ``.digits`` version."""
    return F.regexp_replace(col(name), r"^(.+)\.[0-9]+$", "$1")


def resolve_contigs(names: DataFrame, contigs: DataFrame, *, require_length: bool = False) -> DataFrame:
    """(name[, length]) -> chrom. Exact name decides alone; else a unique alias match; else NULL."""
    keys = ["name", *(["length"] if require_length else [])]
    n = names.select(*keys).distinct()
    cat = contigs.select("chrom", F.col("length").alias("c_len"))
    exact = n.join(cat, F.col("name") == F.col("chrom"), "left").withColumnsRenamed(
        {"chrom": "x_chrom", "c_len": "x_len"})
    alias = cat.withColumn("alias", normalize_chrom_alias("chrom"))
    if require_length:
        by_alias = alias.groupBy("alias", F.col("c_len").alias("length")).agg(
            F.count("*").alias("hits"), F.min("chrom").alias("a_chrom"))
        on = ["alias", "length"]
        exact_pick = F.when(F.col("x_len") == F.col("length"), F.col("x_chrom"))
    else:
        by_alias = alias.groupBy("alias").agg(F.count("*").alias("hits"), F.min("chrom").alias("a_chrom"))
        on, exact_pick = ["alias"], F.col("x_chrom")
    both = exact.withColumn("alias", normalize_chrom_alias("name")).join(by_alias, on, "left")
    picked = F.when(F.col("x_chrom").isNotNull(), exact_pick).when(F.col("hits") == 1, F.col("a_chrom"))
    return both.select(*keys, picked.alias("chrom"))


def unmatched_contigs(names: DataFrame, contigs: DataFrame) -> DataFrame:
    """Names (column ``name``) that no contig resolves."""
    return resolve_contigs(names, contigs).where("chrom is null").select("name")


def same_sequence_set(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row, ``same`` true when names and sequences agree on both sides."""
    l = left.select("chrom", F.sha2("seq", 256).alias("l_hash"))
    r = right.select("chrom", F.sha2("seq", 256).alias("r_hash"))
    differ = ~F.col("l_hash").eqNullSafe(F.col("r_hash"))
    return l.join(r, "chrom", "full_outer").agg(
        (F.coalesce(F.sum(differ.cast("bigint")), F.lit(0)) == 0).alias("same"))


def check_coordinate_sorted(alignments: DataFrame, order: str, *, step: int = STEP) -> DataFrame:
    """Mapped rows whose (ref_id, start_bp) is below that of the mapped row before in ``order``."""
    mapped = alignments.where((F.col("flags").bitwiseAND(4) == 0) & F.col("ref_id").isNotNull() & (F.col("start_bp") >= 0))
    one = mapped.withColumn("__all", F.lit(0))
    back = previous_row(one, ["__all"], order,
                        {"prev_ref": F.col("ref_id"), "prev_start": F.col("start_bp")}, step=step)
    worse = (F.col("ref_id") < F.col("prev_ref")) | (
        (F.col("ref_id") == F.col("prev_ref")) & (F.col("start_bp") < F.col("prev_start")))
    return back.where(worse).drop("__all")


def genome_info(segments: DataFrame) -> DataFrame:
    """Length with gaps, segment and feature counts per genome."""
    return segments.groupBy("genome").agg(
        F.max("end_bp").alias("length"), F.count("*").alias("n_segments"), F.sum("feature_count").alias("n_features"))


def concat_layout(contigs: DataFrame, order: str, *, gap: int = COMPARE_GAP, keys: tuple[str, ...] = ("genome",)) -> DataFrame:
    """Adds seg_idx, start_bp, end_bp of each contig laid end to end in numeric ``order``, ``gap`` between."""
    size = F.col("length").cast("bigint") + gap
    laid = prefix_sums(contigs, keys, order, {"__n": F.lit(1).cast("bigint"), "__end": size})
    return laid.withColumns({
        "seg_idx": F.col("__n") - 1, "start_bp": F.col("__end") - size, "end_bp": F.col("__end") - gap,
    }).drop("__n", "__end")


def reorder_contigs(listing: DataFrame, chrom: str, move: str) -> DataFrame:
    """Move one contig left, right, to the start or the end; ``rank`` changes, ids do not."""
    if move not in ("left", "right", "start", "end"):
        raise ValueError(f"unknown move {move}")
    here = listing.where(F.col("chrom") == chrom).agg(F.max("rank")).scalar()
    last = listing.agg(F.max("rank")).scalar()
    to = {
        "left": F.greatest(F.col("__from") - 1, F.lit(0)),
        "right": F.least(F.col("__from") + 1, F.col("__last")),
        "start": F.lit(0),
        "end": F.col("__last"),
    }[move]
    d = listing.withColumns({"__from": here, "__last": last}).withColumn("__to", to)
    r = F.col("rank")
    moved = (
        F.when(F.col("__from").isNull(), r)
        .when(F.col("chrom") == chrom, F.col("__to"))
        .when((r > F.col("__from")) & (r <= F.col("__to")), r - 1)
        .when((r < F.col("__from")) & (r >= F.col("__to")), r + 1)
        .otherwise(r)
    )
    return d.withColumn("rank", moved).drop("__from", "__last", "__to")


def adjacent_pairs(genomes: DataFrame, order: str) -> DataFrame:
    """Neighbouring genomes of a list with a numeric order."""
    one = genomes.select("genome", F.col(order).alias("__ord"), F.lit(0).alias("__all"))
    back = previous_row(one, ["__all"], "__ord", {"q_genome": F.col("genome"), "__o": F.col("__ord")})
    ranked = prefix_sums(back, ["__all"], "__ord", {"pair_id": F.lit(1).cast("bigint")})
    return ranked.where("q_genome is not null").select(
        "q_genome", F.col("genome").alias("t_genome"), (F.col("pair_id") - 2).alias("pair_id"))
