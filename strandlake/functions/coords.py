"""Coordinate, tile and label expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from strandlake.functions.dna import col

TILE_BASE = 1024
PLOT_BINS = 256
STOP_BINS = 512
MAX_ZOOM = 16


def div(a: Column | str, b: Column | int) -> Column:
    """Integer division towards minus infinity."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", col(a) - F.pmod(col(a), b), b)


def tile_width(zoom: int) -> int:
    return TILE_BASE << zoom


def tile_of(pos: Column | str, zoom: int) -> Column:
    """Tile index of a position at a zoom."""
    return div(pos, tile_width(zoom))


def tile_bounds(tile: Column | str, zoom: int) -> tuple[Column, Column]:
    """Start and end of a tile."""
    w = tile_width(zoom)
    return col(tile) * w, (col(tile) + 1) * w


def zoom_for(bp_per_px: Column | str) -> Column:
    """clamp(round(log2(bp per pixel)), 0, 16)."""
    z = F.round(F.log2(F.greatest(col(bp_per_px), F.lit(0.001)))).cast("int")
    return F.least(F.greatest(z, F.lit(0)), F.lit(MAX_ZOOM))


def mean_depth_bin(total: Column | str, width: Column | str, most: int | None = None) -> Column:
    """C17: half-up mean depth, at least 1 where anything covers; ``most`` clamps it to a narrower format."""
    s, w = col(total), F.greatest(col(width), F.lit(1))
    mean = F.round(s / w).cast("int")
    depth = F.greatest(mean, F.when(s > 0, 1).otherwise(0))
    return depth if most is None else F.least(depth, F.lit(most))


def coverage_bin_count(tile_start: Column, tile_end: Column, length: Column) -> Column:
    """256 bins for a full tile, in proportion at the contig tail."""
    actual = F.least(tile_end, length) - F.greatest(tile_start, F.lit(0))
    nominal = tile_end - tile_start
    return (
        F.when((nominal <= 0) | (actual <= 0), 0)
        .when(actual >= nominal, PLOT_BINS)
        .otherwise(F.greatest(F.lit(1), F.round(F.lit(float(PLOT_BINS)) * actual / nominal).cast("int")))
    )


def flip_interval(start: Column | str, end: Column | str, length: Column | str) -> tuple[Column, Column]:
    """C20: the interval seen from the other end of the contig."""
    return col(length) - col(end), col(length) - col(start)


def flip_point(pos: Column | str, length: Column | str) -> Column:
    """C20."""
    return col(length) - 1 - col(pos)


def flip_strand(strand: Column | str) -> Column:
    """C20."""
    return F.translate(col(strand), "+-", "-+")


def clamp_window(start: Column | str, end: Column | str, length: Column | str) -> tuple[Column, Column]:
    """Both ends inside [0, length], end not before start."""
    s = F.least(F.greatest(col(start), F.lit(0)), col(length))
    e = F.least(F.greatest(col(end), F.lit(0)), col(length))
    return s, F.greatest(s, e)


def feature_frame(
    type_: Column | str, strand: Column | str, start: Column | str, end: Column | str, phase: Column | str
) -> Column:
    """Reading frame 0..5 of CDS and gene rows, -1 for others."""
    ph = F.when(col(phase).between(0, 2), col(phase)).otherwise(0)
    return (
        F.when(~F.lower(col(type_)).isin("cds", "gene"), -1)
        .when(col(strand) == "-", F.pmod(col(end) - ph - 3, F.lit(3)) + 3)
        .otherwise(F.pmod(col(start) + ph, F.lit(3)))
        .cast("int")
    )


def location_label(chrom: Column | str, start: Column | str, end: Column | str) -> Column:
    """1-based closed label."""
    return F.concat(col(chrom), F.lit(":"), (col(start) + 1).cast("string"), F.lit("-"), col(end).cast("string"))


def entity_key(*parts: Column | str) -> Column:
    """Identity key of a feature, read, pair or block."""
    return F.concat_ws("|", *[col(p).cast("string") for p in parts])


def feature_key(name: Column | str) -> Column:
    """Contig, span, name and type of a feature row."""
    return entity_key("chrom", "start_bp", "end_bp", name, "type")


def read_key() -> Column:
    """Name, span, strand and flags of a read row."""
    reverse = F.col("flags").bitwiseAND(16) != 0
    return entity_key("name", "start_bp", "end_bp", reverse.cast("int"), "flags")


def block_key() -> Column:
    """Pair, both intervals and strand of a block row."""
    return entity_key("q_genome", "t_genome", "q_start", "q_end", "t_start", "t_end", F.col("same_strand").cast("int"))
