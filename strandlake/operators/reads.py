"""Alignment operators (F1-F31) on the ``alignments`` table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strandlake.functions import cigar as cg, coords as co
from strandlake.functions.coords import div
from strandlake.functions.dna import normalize_base, revcomp_iupac
from strandlake.operators.interval import covered_runs
from strandlake.operators.sequence import CHUNK, PILE, contig_tiles, salted_join, seq_chunks, text
from strandlake.session import materialize

HIDDEN_FLAGS = 256 | 512 | 1024 | 2048
UNMAPPED, REVERSE, MATE_REVERSE = 4, 16, 32
EXACT_KEY = ("name", "chrom", "start_bp", "end_bp", "flags", "mapq", "cigar", "mate_pos")


def has_flag(bits: int, flags: Column | str = "flags") -> Column:
    return (F.col(flags) if isinstance(flags, str) else flags).bitwiseAND(bits) != 0


def _best_of(df: DataFrame, keys: Sequence[str], first: Sequence[str], largest: bool) -> DataFrame:
    """One row per key by struct order; partial aggregation shrinks piles of copies before the shuffle."""
    rest = [*first, *[c for c in df.columns if c not in keys and c not in first]]
    if not rest:
        return df.dropDuplicates(list(keys))
    pick = (F.max if largest else F.min)(F.struct(*rest)).alias("__r")
    return df.groupBy(*keys).agg(pick).select(*[F.col(c) if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns])


def dedupe_exact(alignments: DataFrame, *, keep_first: Sequence[str] = ()) -> DataFrame:
    """one row per name, contig, span, flags, mapq, CIGAR and mate position."""
    return _best_of(alignments, EXACT_KEY, keep_first, largest=False)


BEST_KEY = ("name", "start_bp", "end_bp", "mate_start", "mate_end", "reverse", "flags")


def dedupe_best(reads: DataFrame, *, keys: Sequence[str] = BEST_KEY) -> DataFrame:
    """the read with the most mismatches, then mapping quality (column n_snps), per display key."""
    keyed = reads.where(~((F.col("name") == "") & (F.col("start_bp") == 0) & (F.col("end_bp") == 0)))
    scored = keyed.withColumn("__score", F.col("n_snps") * 1000 + F.col("mapq"))
    filled = scored.withColumns({c: F.coalesce(F.col(c), F.lit(-1)) for c in ("mate_start", "mate_end")})
    return _best_of(filled, keys, ["__score"], largest=True).drop("__score")


def filter_reads(
    reads: DataFrame, *, min_mapq: int = 0, hidden_flags: int = HIDDEN_FLAGS, proper_pair_only: bool = False,
    reverse_only: bool = False, mate_reverse_only: bool = False,
) -> DataFrame:
    """quality and flag filters."""
    keep = (F.col("mapq") >= min_mapq) & ~has_flag(hidden_flags)
    for wanted, bit in ((proper_pair_only, 2), (reverse_only, REVERSE), (mate_reverse_only, MATE_REVERSE)):
        if wanted:
            keep = keep & has_flag(bit)
    return reads.where(keep)


def fragment_len(*, concat_view: bool = False) -> Column:
    """|TLEN|; in the concatenated fragment view a paired read without mate span counts its own."""
    own = F.abs("tlen")
    if not concat_view:
        return own
    no_mate = F.col("mate_start").isNull() | (F.col("mate_end") <= F.col("mate_start"))
    return F.when(has_flag(1) & no_mate, F.greatest(F.lit(1), F.col("end_bp") - F.col("start_bp"))).otherwise(own)


def mate_fields(alignments: DataFrame) -> DataFrame:
    """mate_start, mate_end (own span), mate_ref (only when another contig), same_ref_mate."""
    present = ~has_flag(8) & (F.col("mate_pos") >= 0)
    span = cg.reference_span("cigar", F.length("read_seq"))
    other = F.col("mate_chrom").isNotNull() & ~F.col("mate_chrom").eqNullSafe(F.col("chrom"))
    return alignments.withColumns({
        "mate_start": F.when(present, F.col("mate_pos")),
        "mate_end": F.when(present, F.col("mate_pos") + span),
        "mate_ref": F.when(present & other, F.col("mate_chrom")),
        "same_ref_mate": has_flag(1) & present & ~other,
    })


def mismatches_md(alignments: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """one row per mismatch position named by the MD tag."""
    return alignments.where("md is not null and md <> ''").select(
        *id_cols, "chrom", F.explode(cg.md_mismatches("md", "start_bp")).alias("pos"))


def mismatches_cigar(alignments: DataFrame, contigs: DataFrame, id_cols: Sequence[str], *, step: int = CHUNK,
                     pile: int = PILE) -> DataFrame:
    """mismatches without MD: X ops, and M ops compared with the reference.

    M ops are cut at chunk borders and meet reference chunks by equality; a chunk with more than ``pile`` of
    them is repeated over salts, because one amplicon's chunk may hold a third of all reads.
    Symbols other than ACGTUN on either side do not count.
    """
    ops = alignments.select(*id_cols, "chrom", "read_seq", F.explode(cg.placed_ops("cigar", "start_bp")).alias("o"))
    ops = ops.select(*id_cols, "chrom", "read_seq", "o.*").where("op in ('M', 'X') and len > 0")
    crossed = ops.where("op = 'X'").withColumn("pos", F.explode(F.expr("sequence(r0, r0 + len - 1)"))).select(
        *id_cols, "chrom", "pos", normalize_base(F.expr("substring(read_seq, q0 + (pos - r0) + 1, 1)")).alias("base"))
    m = ops.where("op = 'M'").withColumns({
        "chunk": F.explode(F.expr(f"sequence(greatest(r0, 0) div {step}, greatest(r0 + len - 1, 0) div {step})"))})
    m = m.withColumn("chunk", F.col("chunk").cast("int"))
    ref = seq_chunks(contigs, step=step).select("chrom", "chunk", F.col("start_bp").alias("c0"), "bases")
    met = salted_join(m, ref, ["chrom", "chunk"], list(id_cols), pile=pile).withColumns({
        "lo": F.expr("greatest(r0, c0)"), "hi": F.expr("least(r0 + len, c0 + length(bases))")}).where("hi > lo")
    clean = lambda s: F.translate(F.upper(s), "U", "T")
    pieces = met.select(
        *id_cols, "chrom", "lo",
        clean(text(F.expr("substring(bases, cast(lo - c0 + 1 as int), cast(hi - lo as int))"))).alias("rb"),
        clean(F.expr("substring(read_seq, cast(q0 + lo - r0 + 1 as int), cast(hi - lo as int))")).alias("qb"))
    # Equal pieces, the bulk, are dropped before anything is expanded.
    unequal = pieces.where("length(qb) > 0 and substring(rb, 1, length(qb)) <> qb")
    each = unequal.withColumn("i", F.explode(F.expr("sequence(1, least(length(rb), length(qb)))")))
    diff = each.select(*id_cols, "chrom", (F.col("lo") + F.col("i") - 1).alias("pos"),
                       F.expr("substring(rb, i, 1)").alias("r"), F.expr("substring(qb, i, 1)").alias("base"))
    bases = ("A", "C", "G", "T", "N")
    found = diff.where(F.col("r").isin(*bases) & F.col("base").isin(*bases) & (F.col("r") != F.col("base")))
    return found.select(*id_cols, "chrom", "pos", "base").unionByName(crossed)


def read_snps(alignments: DataFrame, contigs: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """Mismatch positions with the read's base; MD where it names any, else the CIGAR path."""
    marked = alignments.withColumn(
        "__md", F.coalesce(cg.md_mismatches(F.coalesce("md", F.lit("")), "start_bp"), F.array().cast("array<int>")))
    named = marked.where(F.size("__md") > 0).withColumn("__ops", cg.placed_ops("cigar", "start_bp"))
    base = F.coalesce(cg.read_base_at("__ops", "read_seq", "pos"), F.lit("N"))
    by_md = named.withColumn("pos", F.explode("__md")).select(*id_cols, "chrom", "pos", base.alias("base"))
    rest = mismatches_cigar(marked.where(F.size("__md") == 0).drop("__md"), contigs, id_cols)
    return by_md.unionByName(rest.withColumn("base", F.coalesce("base", F.lit("N"))))


def soft_clips(alignments: DataFrame) -> DataFrame:
    """F9."""
    left, right = cg.soft_clips("cigar", "read_seq")
    return alignments.withColumns({"clip_left": left, "clip_right": right})


def indel_markers(alignments: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """rows (kind del/ins, start_bp, end_bp)."""
    marks = alignments.select(*id_cols, "chrom", F.explode(cg.indel_markers("cigar", "start_bp")).alias("m"))
    return marks.select(*id_cols, "chrom", "m.kind", "m.start_bp", "m.end_bp")


def pair_key_columns() -> list[Column]:
    """Canonical (name, lower span, upper span) of a read and its mate."""
    s, e, ms, me = (F.col(c) for c in ("start_bp", "end_bp", "mate_start", "mate_end"))
    swap = (ms < s) | ((ms == s) & (me < e))
    return [F.when(swap, ms).otherwise(s).alias("a0"), F.when(swap, me).otherwise(e).alias("a1"),
            F.when(swap, s).otherwise(ms).alias("b0"), F.when(swap, e).otherwise(me).alias("b1")]


def mate_lookup(reads: DataFrame, id_col: str, *, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """for each read with a mate span the id of the mate row, NULL when absent or itself.

    Rows move once, to those of the same two spans; equal copies never pair up with each other.
    """
    paired = reads.where("mate_start is not null and mate_end > mate_start")
    full = paired.select(*keys, "name", id_col, *pair_key_columns(), (
        (F.col("mate_start") < F.col("start_bp")) | ((F.col("mate_start") == F.col("start_bp")) & (F.col("mate_end") < F.col("end_bp")))).alias("second"))
    # Rows of one pair of spans are on either of them; a row's mate is the last one on the other, or on the same span if they are equal.
    both = W.partitionBy(*keys, "name", "a0", "a1", "b0", "b1")
    alike = (F.col("a0") == F.col("b0")) & (F.col("a1") == F.col("b1"))
    last = lambda on: F.max(F.when(on, F.col(id_col))).over(both)
    mate = F.when(alike, last(F.lit(True))).when(F.col("second"), last(~F.col("second"))).otherwise(last(F.col("second")))
    named = F.lit(True)
    for c in (*keys, "name"):
        named = named & F.col(c).isNotNull()
    found = full.withColumn("mate_id", mate)
    return found.select(id_col, F.when(named & (F.col("mate_id") != F.col(id_col)), F.col("mate_id")).alias("mate_id"))


def infer_mate_contig(reads: DataFrame, order: Sequence[str]) -> DataFrame:
    """the first other contig on which the read's name occurs, in ``order``; adds inferred_mate.

    Per name only the first rows of the two earliest contigs matter; no read pairs are formed.
    """
    seen = reads.where("name <> ''").groupBy("name", "chrom").agg(F.min(F.struct(*order)).alias("o"))
    rn = F.row_number().over(W.partitionBy("name").orderBy("o", "chrom"))
    two = seen.withColumn("rn", rn).where("rn <= 2").groupBy("name").agg(
        F.max(F.when(F.col("rn") == 1, F.col("chrom"))).alias("__c1"),
        F.max(F.when(F.col("rn") == 2, F.col("chrom"))).alias("__c2"))
    pick = F.when(F.col("__c1") != F.col("chrom"), F.col("__c1")).otherwise(F.col("__c2"))
    # Only names on several contigs have an answer; the others, unnamed reads above all, meet nothing in the join.
    several = two.where("__c2 is not null")
    return reads.join(several, "name", "left").withColumn("inferred_mate", pick).drop("__c1", "__c2")


def top_mate_contigs(reads: DataFrame, *, mate: str = "mate_ref", top: int = 5) -> DataFrame:
    """per origin contig the ``top`` mate contigs by count (ties by name), the rest as 'other'."""
    counts = reads.where(F.col(mate).isNotNull()).groupBy("chrom", F.col(mate).alias("mate")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(W.partitionBy("chrom").orderBy(F.desc("n"), "mate"))
    r = counts.withColumn("slot", F.least(rank, F.lit(top + 1)))
    label = F.when(F.col("slot") <= top, F.col("mate")).otherwise("other")
    return r.groupBy("chrom", "slot", label.alias("mate")).agg(F.sum("n").alias("n"))


# --- coverage -----------------------------------------------------------------------


def bin_of(offset: Column, n_bins: Column, span: Column) -> Column:
    """Index of the bin (edges at b*span div n) that holds an offset."""
    return div((offset + 1) * n_bins - 1, span)


def bin_grid(lengths: DataFrame, zoom: int) -> DataFrame:
    """Every (chrom, tile, bin) with its edges; F20 gives the bins of a tile."""
    w = co.tile_width(zoom)
    t = contig_tiles(lengths, zoom).withColumn(
        "n_bins", co.coverage_bin_count(F.col("tile_start"), F.col("tile_start") + w, F.col("length")))
    g = t.withColumn("bin", F.explode(F.expr("sequence(0, n_bins - 1)")))
    span = F.col("tile_end") - F.col("tile_start")
    edge = lambda b: F.col("tile_start") + div(b * span, F.col("n_bins"))
    return g.withColumns({"bin_start": edge(F.col("bin")), "bin_end": edge(F.col("bin") + 1)})


def binned_depth(spans: DataFrame, lengths: DataFrame, zoom: int, *, weight: str | None = None,
                 by: Sequence[str] = ()) -> DataFrame:
    """Sum of (weighted) overlap per (chrom, tile, bin); the explode is combined map-side."""
    w = co.tile_width(zoom)
    d = spans.join(lengths.select("chrom", "length"), "chrom").select(
        "chrom", *by, "length", F.greatest("start_bp", F.lit(0)).cast("bigint").alias("s"),
        F.least("end_bp", "length").cast("bigint").alias("e"),
        (F.col(weight) if weight else F.lit(1)).cast("bigint").alias("wt")).where("e > s")
    d = d.withColumn("tile", F.explode(F.sequence(div("s", w), div(F.col("e") - 1, w))))
    t0 = F.col("tile") * w
    t1 = F.least(t0 + w, F.col("length").cast("bigint"))
    d = d.withColumns({"t0": t0, "span": t1 - t0, "lo": F.greatest("s", t0), "hi": F.least("e", t1)})
    d = d.withColumn("nb", co.coverage_bin_count(F.col("t0"), F.col("t0") + w, F.col("length")).cast("bigint"))
    first = bin_of(F.col("lo") - F.col("t0"), F.col("nb"), F.col("span"))
    last = bin_of(F.col("hi") - 1 - F.col("t0"), F.col("nb"), F.col("span"))
    d = d.withColumn("bin", F.explode(F.sequence(first, last)))
    edge = lambda b: F.col("t0") + div(b * F.col("span"), F.col("nb"))
    part = F.least("hi", edge(F.col("bin") + 1)) - F.greatest("lo", edge(F.col("bin")))
    return d.groupBy("chrom", *by, "tile", "bin").agg(F.sum(part * F.col("wt")).alias("total"))


def usable_for_coverage(alignments: DataFrame) -> DataFrame:
    return dedupe_exact(alignments.where(~has_flag(UNMAPPED)))


def _densify(sums: DataFrame, lengths: DataFrame, zoom: int, names: dict[str, str]) -> DataFrame:
    grid = bin_grid(lengths, zoom).select("chrom", "tile", "bin", (F.col("bin_end") - F.col("bin_start")).alias("__w"))
    out = grid.join(sums, ["chrom", "tile", "bin"], "left")
    return out.select("chrom", "tile", "bin", *[
        co.mean_depth_bin(F.coalesce(F.col(c), F.lit(0)), "__w").alias(o) for o, c in names.items()])


def coverage_bins(alignments: DataFrame, lengths: DataFrame, *, zoom: int = 0) -> DataFrame:
    """F16: mean depth of every bin of every tile, exact copies and unmapped reads left out."""
    sums = binned_depth(usable_for_coverage(alignments).select("chrom", "start_bp", "end_bp"), lengths, zoom)
    return _densify(sums, lengths, zoom, {"depth": "total"})


def strand_coverage_bins(alignments: DataFrame, lengths: DataFrame, *, zoom: int = 0) -> DataFrame:
    """F16 split by the reverse flag: columns forward, reverse."""
    rows = usable_for_coverage(alignments).select("chrom", "start_bp", "end_bp", has_flag(REVERSE).alias("rev"))
    sums = binned_depth(rows, lengths, zoom, by=["rev"]).groupBy("chrom", "tile", "bin").agg(
        F.sum(F.when(~F.col("rev"), F.col("total"))).alias("f"), F.sum(F.when(F.col("rev"), F.col("total"))).alias("r"))
    return _densify(sums, lengths, zoom, {"forward": "f", "reverse": "r"})


def coverage_runs(alignments: DataFrame) -> DataFrame:
    """run-length depth per contig and strand: (chrom, reverse, start_bp, end_bp, depth)."""
    rows = usable_for_coverage(alignments).select("chrom", "start_bp", "end_bp", has_flag(REVERSE).alias("reverse"))
    return covered_runs(rows, keys=["chrom", "reverse"])


def coverage_from_runs(runs: DataFrame, lengths: DataFrame, *, zoom: int = 0) -> DataFrame:
    """F17's bins from F18's runs; also gives the total depth."""
    sums = binned_depth(runs, lengths, zoom, weight="depth", by=["reverse"]).groupBy("chrom", "tile", "bin").agg(
        F.sum(F.when(~F.col("reverse"), F.col("total"))).alias("f"),
        F.sum(F.when(F.col("reverse"), F.col("total"))).alias("r"), F.sum("total").alias("t"))
    return _densify(sums, lengths, zoom, {"forward": "f", "reverse": "r", "depth": "t"})


READ_ORDER = ("start_bp", "end_bp", "name", "flags", "mapq", "cigar")


def read_tiles(alignments: DataFrame, *, zoom: int, limit: int | None = None, order: Sequence[str] = READ_ORDER) -> DataFrame:
    """reads of every tile with their rank in a midpoint bin; ``limit`` thins a tile to a quota per bin."""
    w, bins = co.tile_width(zoom), 256 if limit is None else max(1, min(256, limit))
    d = usable_for_coverage(alignments).where("end_bp > start_bp and end_bp > 0")
    d = d.withColumn("tile", F.explode(F.sequence(div(F.greatest("start_bp", F.lit(0)), w), div(F.col("end_bp") - 1, w))))
    t0 = F.col("tile") * w
    s, e = F.greatest("start_bp", t0), F.least("end_bp", t0 + w)
    mid = s + div(e - s - 1, 2) - t0
    d = d.withColumn("bin", F.least(div(mid * bins, w), F.lit(bins - 1)))
    rank = F.row_number().over(W.partitionBy("chrom", "tile", "bin").orderBy(*order))
    if limit is None:
        return d.withColumn("rank", rank)
    base, extra = divmod(limit, bins)
    top = d.withColumn("rank", rank).where(F.col("rank") <= base + (1 if extra else 0))
    quota = F.lit(base) + F.when(F.col("bin") < extra, 1).otherwise(0)
    return top.where(F.col("rank") <= quota)


def viewport_read_limit(view_bp: int, bp_per_px: float) -> int:
    px = max(1, round(view_bp / max(bp_per_px, 0.001)))
    return min(max(16 * px, 12000), 24000)


def sample_reads(reads: DataFrame, *, view_start: int, view_end: int, bp_per_px: float, limit: int | None = None,
                 key: Column) -> DataFrame:
    """all reads, or per contig at most ``limit``, lowest stable hash first within midpoint bins.

    The hash is MD5 of the display key, so runs and engines agree. Contigs within the
    limit keep everything. ``viewport_read_limit`` gives the limit of a view.
    """
    if limit is None:
        return reads
    span = max(1, view_end - view_start)
    px = max(1, round(span / max(bp_per_px, 0.001)))
    bins = max(1, min(max(round(px / 2.0), 128), min(1024, limit)))
    base, extra = divmod(limit, bins)
    mid = F.floor((F.col("start_bp") + F.col("end_bp")) * 0.5).cast("bigint")
    idx = F.least(F.greatest(div((mid - view_start) * bins, span), F.lit(0)), F.lit(bins - 1))
    few = reads.groupBy("chrom").agg((F.count("*") <= limit).alias("__few"))
    cols = reads.columns
    d = reads.withColumns({"__hash": F.md5(key), "__bin": idx})
    rank = F.row_number().over(W.partitionBy("chrom", "__bin").orderBy("__hash"))
    quota = F.lit(base) + F.when(F.col("__bin") < extra, 1).otherwise(0)
    ranked = d.withColumn("__rn", rank).where(F.col("__rn") <= limit).join(few, "chrom")
    return ranked.where(F.col("__few") | (F.col("__rn") <= quota)).select(*cols)


def strand_summary(strand_bins: DataFrame, lengths: DataFrame, *, zoom: int, view_start: int, view_end: int,
                   bins: int = 256) -> DataFrame:
    """strand tile bins rebinned over a view: mean of the source bins by midpoint, 0 where there are none.

    Every contig of ``lengths`` has all bins.
    """
    bins, span, w = min(max(bins, 32), 512), max(1, view_end - view_start), co.tile_width(zoom)
    d = strand_bins.join(lengths, "chrom").withColumns({
        "__t0": F.col("tile") * w, "__t1": F.least((F.col("tile") + 1) * w, F.col("length"))})
    d = d.where((F.col("__t1") > view_start) & (F.col("__t0") < view_end))
    nb = co.coverage_bin_count(F.col("__t0"), F.col("__t0") + w, F.col("length"))
    mid = F.col("__t0") + (F.col("bin") + 0.5) * F.greatest(F.lit(1.0), (F.col("__t1") - F.col("__t0")) / nb)
    idx = F.least(F.greatest(F.floor((mid - view_start) * bins / span), F.lit(0)), F.lit(bins - 1)).cast("int")
    means = d.groupBy("chrom", idx.alias("bin")).agg(F.avg("forward").alias("forward"), F.avg("reverse").alias("reverse"))
    return _every_bin(lengths, bins).join(means, ["chrom", "bin"], "left").select(
        "chrom", "bin", F.coalesce("forward", F.lit(0.0)).alias("forward"), F.coalesce("reverse", F.lit(0.0)).alias("reverse"))


def _every_bin(contigs: DataFrame, bins: int) -> DataFrame:
    return contigs.select("chrom").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))


def fragment_summary(reads: DataFrame, *, view_start: int, view_end: int, bins: int = 256) -> DataFrame:
    """p25, p50, p75 of fragment_len per midpoint bin; the element at floor((n-1)q), -1 in an empty bin.

    Every contig with reads has all bins. Lengths are counted first, so a bin's window holds its distinct lengths, not its reads.
    """
    bins, span = min(max(bins, 32), 512), max(1, view_end - view_start)
    mid = F.floor((F.col("start_bp") + F.col("end_bp")) * 0.5).cast("bigint")
    idx = F.least(F.greatest(div((mid - view_start) * bins, span), F.lit(0)), F.lit(bins - 1))
    counts = reads.where("fragment_len > 0").groupBy("chrom", idx.alias("bin"), "fragment_len").agg(F.count("*").alias("n"))
    w = W.partitionBy("chrom", "bin")
    upto = F.sum("n").over(w.orderBy("fragment_len").rowsBetween(W.unboundedPreceding, 0))
    c = counts.withColumns({"upto": upto, "total": F.sum("n").over(w)})
    at = lambda q: F.min(F.when(
        F.col("upto") > F.floor((F.col("total") - 1) * q), F.col("fragment_len")))
    found = c.groupBy("chrom", F.col("bin").cast("int").alias("bin")).agg(at(0.25).alias("p25"), at(0.5).alias("p50"), at(0.75).alias("p75"))
    return _every_bin(reads, bins).join(found, ["chrom", "bin"], "left").select(
        "chrom", "bin", *[F.coalesce(p, F.lit(-1)).alias(p) for p in ("p25", "p50", "p75")])


def fragment_scale(reads: DataFrame, *, log: bool = False, out: str = "frag_norm") -> DataFrame:
    """fragment length over the largest one, plain or on a log scale, in 0..1."""
    f = F.greatest(F.lit(1), "fragment_len").cast("double")
    top = reads.agg(F.greatest(F.lit(1.0), F.max(f)).alias("m")).scalar()
    norm = F.log(f + 1.0) / F.log(top + 1.0) if log else f / top
    return reads.withColumn(out, F.least(F.greatest(norm, F.lit(0.0)), F.lit(1.0)))


def pileup_counts(alignments: DataFrame, contigs: DataFrame, id_cols: Sequence[str], *, by_strand: bool = False,
                  step: int = CHUNK) -> DataFrame:
    """per position the count and share of A, C, G, T and D; ``ord`` ranks by count, then letter.

    Reads are never spread over their bases: depth comes from runs, and only mismatches
    and deleted bases are expanded. The reference base gets what is left.
    """
    strand = ["reverse"] if by_strand else []
    rows = alignments.withColumn("reverse", has_flag(REVERSE))
    own = [*id_cols, *strand]
    snps = read_snps(rows, contigs, own)
    gone = indel_markers(rows, own).where("kind = 'del'").withColumn(
        "pos", F.explode(F.expr("sequence(start_bp, end_bp - 1)"))).select(*own, "chrom", "pos", F.lit("D").alias("base"))
    # A deletion hides a mismatch named at the same place.
    special = gone.unionByName(snps.join(gone.select(*own, "pos"), [*own, "pos"], "left_anti"))
    where = ["chrom", *strand, "pos"]
    letters = ["A", "C", "D", "G", "T"]
    alt = special.groupBy(*where).agg(
        F.count("*").alias("n_alt"), *[F.sum((F.col("base") == b).cast("bigint")).alias(f"n{b}") for b in letters])
    # Read twice below and far smaller than the reads it took to find.
    alt = materialize(alt, "pileup_alt")
    # Places with a mismatch or deletion become runs of one base, so the counts join runs, not bases.
    runs = covered_runs(rows, keys=["chrom", *strand], cuts=alt.select(*where))
    runs = runs.withColumn("pos", F.col("start_bp").cast("int")).join(alt, where, "left").drop("pos")
    runs = runs.withColumn("chunk", F.explode(F.expr(f"sequence(start_bp div {step}, (end_bp - 1) div {step})")))
    ref = seq_chunks(contigs, step=step).select("chrom", "chunk", F.col("start_bp").alias("c0"), "bases")
    lo, hi = F.expr("greatest(start_bp, c0)"), F.expr("least(end_bp, c0 + length(bases))")
    # Each run keeps its own bases only. Stored, because plain and mixed runs are read apart below.
    met = runs.withColumn("chunk", F.col("chunk").cast("int")).join(ref, ["chrom", "chunk"]).where(hi > lo).select(
        "chrom", *strand, lo.cast("int").alias("at"), "depth", "n_alt", *[f"n{b}" for b in letters],
        F.expr("substring(bases, cast(greatest(start_bp, c0) - c0 + 1 as int), cast(least(end_bp, c0 + length(bases)) - greatest(start_bp, c0) as int))").alias("bases"))
    met = materialize(met, "pileup_runs")
    each = lambda df: df.withColumn("i", F.explode(F.expr("sequence(0, length(bases) - 1)"))).select(
        *df.columns, (F.col("at") + F.col("i")).alias("pos"), F.upper(text(F.expr("substring(bases, i + 1, 1)"))).alias("ref_base"))
    # Nearly all places have one letter; they need no arrays.
    plain = each(met.where("n_alt is null")).where(F.col("ref_base").isin(*letters)).select(
        *where, "ref_base", F.lit(0).alias("ord"), F.col("ref_base").alias("base"), F.col("depth").alias("n"), F.lit(1.0).alias("frac"))
    d = each(met.where("n_alt is not null"))
    rest = F.col("depth") - F.col("n_alt")
    cell = lambda b: F.struct(
        (F.coalesce(F.col(f"n{b}"), F.lit(0)) + F.when(F.col("ref_base") == b, rest).otherwise(0)).alias("n"),
        F.lit(b).alias("base"))
    cells = F.array_sort(F.filter(F.array(*[cell(b) for b in letters]), lambda c: c["n"] > 0))
    total = F.aggregate("cells", F.lit(0).cast("bigint"), lambda acc, c: acc + c["n"])
    mixed = d.withColumn("cells", cells).withColumn("total", total).where("total > 0")
    mixed = mixed.select(*where, "ref_base", "total", F.posexplode("cells").alias("ord", "c")).select(
        *where, "ref_base", "ord", "c.base", "c.n", (F.col("c.n") / F.col("total")).alias("frac"))
    return plain.unionByName(mixed)


def stack_depth(reads: DataFrame, *, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """rows needed to stack reads, their soft clips included: the deepest overlap of closed spans."""
    s = F.col("start_bp") - F.length("clip_left")
    e = F.col("end_bp") + F.length("clip_right") + 1
    runs = covered_runs(reads.select(*keys, s.alias("start_bp"), e.alias("end_bp")), keys=keys)
    return runs.groupBy(*keys).agg(F.max("depth").alias("rows_needed"))


def pair_groups(reads: DataFrame, *, view_bp: int, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """mates within twice the view as one span: (keys, group key, start_bp, end_bp, n_reads)."""
    centre = lambda a, b: F.expr(f"cast(({a} + {b}) / 2.0 as bigint)")
    near = (F.col("mate_start").isNotNull() & (F.col("mate_end") > F.col("mate_start")) & (
        F.abs(centre("mate_start", "mate_end") - centre("start_bp", "end_bp")) <= 2 * max(1, view_bp)))
    near = F.coalesce(near, F.lit(False))
    s = F.col("start_bp") - F.length("clip_left")
    e = F.col("end_bp") + F.length("clip_right")
    solo = F.concat_ws("|", "name", "start_bp", "end_bp", has_flag(REVERSE).cast("int"), "flags")
    pair = F.concat_ws("|", "name", *pair_key_columns())
    d = reads.select(
        *keys, F.when(near, pair).otherwise(solo).alias("group_key"),
        F.when(near, F.least(s, F.col("mate_start"))).otherwise(s).alias("s"),
        F.when(near, F.greatest(e, F.col("mate_end"))).otherwise(e).alias("e"))
    return d.groupBy(*keys, "group_key").agg(
        F.min("s").alias("start_bp"), F.max("e").alias("end_bp"), F.count("*").alias("n_reads"))


# --- orientation --------------------------------------------------------------------


def apply_orientation_reads(reads: DataFrame, orientation: DataFrame) -> DataFrame:
    """reads on reversed contigs flipped: span, CIGAR, clips, flags, mate span.

    Needs clip_left/clip_right (F9) and mate_start/mate_end/mate_ref (F11). Mate columns
    are flipped in the mate's own contig when it is another one.
    """
    own = orientation.select("chrom", F.col("length").alias("__l"), F.coalesce("reversed", F.lit(False)).alias("__r"))
    mate = orientation.select(F.col("chrom").alias("__mc"), F.col("length").alias("__ml"),
                              F.coalesce("reversed", F.lit(False)).alias("__mr"))
    d = reads.withColumn("__mc", F.coalesce("mate_ref", "chrom")).join(own, "chrom", "left").join(mate, "__mc", "left")
    rev = F.coalesce("__r", F.lit(False))
    m_rev = F.coalesce("__mr", F.lit(False)) & F.col("mate_start").isNotNull()
    s, e = co.flip_interval("start_bp", "end_bp", "__l")
    flags = F.col("flags").bitwiseXOR(F.lit(16)).bitwiseXOR(F.when(m_rev, 32).otherwise(0))
    ms, me = co.flip_interval("mate_start", "mate_end", "__ml")
    new = {
        "start_bp": s, "end_bp": e, "cigar": cg.reverse_cigar("cigar"), "flags": flags,
        "clip_left": revcomp_iupac("clip_right"), "clip_right": revcomp_iupac("clip_left"),
        "mate_start": F.when(m_rev, ms).otherwise(F.col("mate_start")),
        "mate_end": F.when(m_rev, me).otherwise(F.col("mate_end")),
    }
    return d.select(*[
        F.when(rev, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in reads.columns])


def apply_orientation_snps(snps: DataFrame, orientation: DataFrame) -> DataFrame:
    """SNP rows (chrom, pos, base) on reversed contigs flipped and complemented."""
    o = orientation.where("reversed").select("chrom", F.col("length").alias("__l"))
    turned = F.when(F.col("base").rlike("^[A-Za-z]$"), revcomp_iupac("base")).otherwise("N")
    on = F.col("__l").isNotNull()
    return snps.join(o, "chrom", "left").select(*[
        {"pos": F.when(on, co.flip_point("pos", "__l")).otherwise(F.col("pos")).alias("pos"),
         "base": F.when(on, turned).otherwise(F.col("base")).alias("base")}.get(c, F.col(c)) for c in snps.columns])


def apply_orientation_coverage(strand_bins: DataFrame, n_bins: Column | str) -> DataFrame:
    """bins of a flipped tile in reverse order, strands swapped."""
    n = F.col(n_bins) if isinstance(n_bins, str) else n_bins
    return strand_bins.withColumns({"bin": n - 1 - F.col("bin"), "forward": F.col("reverse"), "reverse": F.col("forward")})


def depth_series(alignments: DataFrame, lengths: DataFrame, *, zoom: int = 0) -> DataFrame:
    """one depth series per read source, labelled, over the contigs the source has reads on."""
    sums = binned_depth(usable_for_coverage_by_source(alignments), lengths, zoom, by=["source"])
    lens = alignments.select("source", "chrom").distinct().join(lengths, "chrom")
    w = co.tile_width(zoom)
    t = contig_tiles(lens, zoom, keys=("source", "chrom")).withColumn(
        "n_bins", co.coverage_bin_count(F.col("tile_start"), F.col("tile_start") + w, F.col("length")))
    grid = t.withColumn("bin", F.explode(F.expr("sequence(0, n_bins - 1)")))
    span = F.col("tile_end") - F.col("tile_start")
    width = div((F.col("bin") + 1) * span, F.col("n_bins")) - div(F.col("bin") * span, F.col("n_bins"))
    return grid.withColumn("__w", width).join(sums, ["source", "chrom", "tile", "bin"], "left").select(
        "source", "chrom", "tile", "bin", co.mean_depth_bin(F.coalesce("total", F.lit(0)), "__w").alias("depth"))


def usable_for_coverage_by_source(alignments: DataFrame) -> DataFrame:
    mapped = alignments.where(~has_flag(UNMAPPED))
    return _best_of(mapped, ["source", *EXACT_KEY], [], largest=False).select("source", "chrom", "start_bp", "end_bp")
