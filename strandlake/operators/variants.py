"""Variant operators (G1-G13) on the ``variants`` table.

ALT is the comma-joined summary; samples are ARRAY<STRUCT<sample, value>> beside the
FORMAT keys. Sample and allele arrays are as long as one record.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strandlake.functions import coords as co
from strandlake.functions.coords import div
from strandlake.functions.dna import col, revcomp_alts, revcomp_genotype_text, revcomp_iupac
from strandlake.operators.interval import overlap_join

# Record kinds and genotype classes.
KINDS = ("unknown", "snp", "mnp", "insertion", "deletion", "complex", "symbolic")
GT_CLASSES = ("missing", "ref", "het", "hom_alt")
LABELS = {"snp": "SNP", "mnp": "MNP", "insertion": "Insertion", "deletion": "Deletion", "complex": "Complex",
          "symbolic": "Symbolic", "unknown": "Variant"}


def classify_variant(ref: Column | str, alt: Column | str) -> Column:
    """G1: kind of a record from REF and its comma-joined ALT."""
    r, a = col(ref), col(alt)
    lr, la = F.length(r), F.length(a)
    return (
        F.when((lr == 0) | (la == 0), "unknown")
        .when(a.rlike(r"(^|,)<|[\[\]]"), "symbolic")
        .when(F.contains(a, F.lit(",")), "complex")
        .when((lr == 1) & (la == 1), "snp")
        .when(lr == la, "mnp")
        .when((lr < la) & F.startswith(a, r), "insertion")
        .when((lr > la) & F.startswith(r, a), "deletion")
        .otherwise("complex")
    )


def display_kind(kind: Column | str, ref: Column | str, alt: Column | str) -> Column:
    """Complex records whose ALTs are all SNPs, all insertions or all deletions get that kind."""
    k, r = col(kind), col(ref)
    alts = F.filter(F.split(col(alt), ","), lambda x: x != "")
    snp = F.forall(alts, lambda x: (F.length(r) == 1) & (F.length(x) == 1))
    ins = F.forall(alts, lambda x: (F.length(x) > F.length(r)) & F.startswith(x, r))
    dele = F.forall(alts, lambda x: (F.length(x) == 1) & (F.length(r) > 1) & F.startswith(r, x))
    refine = (k == "complex") & (r != "") & (F.size(alts) > 0)
    return F.when(~refine, k).when(snp, "snp").when(ins, "insertion").when(dele, "deletion").otherwise(k)


def variant_label(kind: Column | str, ref: Column | str, alt: Column | str) -> Column:
    """``Deletion (3bp)`` and the like, from the display kind."""
    shown = display_kind(kind, ref, alt)
    word = F.coalesce(*[F.when(shown == k, v) for k, v in LABELS.items()])
    change = F.length(col(alt)) - F.length(col(ref))
    n = F.when(shown == "insertion", change).when(shown == "deletion", -change)
    sized = F.concat(word, F.lit(" ("), n.cast("string"), F.lit("bp)"))
    return F.when(~F.contains(col(alt), F.lit(",")) & (n > 0), sized).otherwise(word)


def deletion_span(ref: Column | str, alt: Column | str, start: Column | str, end: Column | str) -> tuple[Column, Column]:
    """Deleted span of a single-ALT deletion anchored at its front or back, else NULL."""
    r, a, s, e = col(ref), col(alt), col(start), col(end)
    fits = (F.length(r) > F.length(a)) & (a != "") & ~F.contains(a, F.lit(","))
    front, back = F.startswith(r, a), F.endswith(r, a)
    lo = F.when(fits & front, s + F.length(a)).when(fits & back, s)
    hi = F.when(fits & front, e).when(fits & back, e - F.length(a))
    return lo, F.when(lo.isNotNull(), F.greatest(lo + 1, hi))


def insertion_point(ref: Column | str, alt: Column | str, start: Column | str) -> Column:
    """Point of a single-ALT insertion anchored at its front or back, else NULL."""
    r, a, s = col(ref), col(alt), col(start)
    fits = (r != "") & (F.length(a) > F.length(r)) & ~F.contains(a, F.lit(","))
    return F.when(fits & F.startswith(a, r), s + F.length(r)).when(fits & F.endswith(a, r), s)


def parse_gt(gt: Column | str) -> Column:
    """Allele numbers of a GT value; NULL when any is missing or not a number."""
    g = F.trim(col(gt))
    parts = F.transform(F.split(g, r"[/|]"), lambda p: F.trim(p))
    good = F.forall(parts, lambda p: p.rlike("^[0-9]+$"))
    return F.when((g != "") & good, F.transform(parts, lambda p: p.try_cast("int")))


def genotype_class(gt: Column | str, ref: Column | str, alt: Column | str) -> tuple[Column, Column]:
    """(class, allele text); an allele number without an ALT makes the call missing."""
    alleles = parse_gt(gt)
    names = F.concat(F.array(col(ref)), F.split(col(alt), ","))
    known = F.forall(alleles, lambda i: i < F.size(names))
    ok = alleles.isNotNull() & known
    same = F.size(F.array_distinct(alleles)) == 1
    first = F.try_element_at(alleles, F.lit(1))
    cls = (
        F.when(~F.coalesce(ok, F.lit(False)), "missing").when(same & (first == 0), "ref")
        .when(same, "hom_alt").otherwise("het"))
    texts = F.transform(alleles, lambda i: F.try_element_at(names, i + 1))
    text = F.when(~F.coalesce(ok, F.lit(False)), "").when(same, F.try_element_at(texts, F.lit(1))).otherwise(
        F.array_join(texts, "/"))
    return cls, text


def sample_has_alt(gt: Column | str) -> Column:
    """G7."""
    return F.coalesce(F.exists(parse_gt(gt), lambda i: i > 0), F.lit(False))


def sample_field(format_: Column | str, value: Column | str, key: str) -> Column:
    """One FORMAT field of a sample's colon-separated value, NULL when absent."""
    at = F.array_position(col(format_), F.lit(key)).cast("int")
    return F.when(at > 0, F.try_element_at(F.split(col(value), ":"), at))


def genotypes_long(variants: DataFrame) -> DataFrame:
    """One row per record and sample: sample_idx, sample, gt, gt_class, gt_text, has_alt."""
    rows = variants.select("*", F.posexplode("samples").alias("sample_idx", "__s")).withColumns({
        "sample": F.col("__s.sample"), "gt": F.coalesce(sample_field("format", "__s.value", "GT"), F.lit(""))})
    cls, text = genotype_class("gt", "ref", "alt")
    return rows.withColumns({"gt_class": cls, "gt_text": text, "has_alt": sample_has_alt("gt")}).drop("__s", "samples")


def sample_rows(sources: DataFrame) -> DataFrame:
    """Display rows (row_index, source_id, source, sample_idx, sample) over all sources.

    ``sources`` is G11's small list; rows of a source follow its predecessors'.
    """
    from strandlake.operators.prefix import prefix_sums

    one = sources.withColumn("__all", F.lit(0))
    laid = prefix_sums(one, ["__all"], "source_id", {"__end": F.size("sample_names").cast("bigint")})
    rows = laid.select("source_id", "source", (F.col("__end") - F.size("sample_names")).alias("__from"),
                       F.posexplode("sample_names").alias("sample_idx", "sample"))
    return rows.select((F.col("__from") + F.col("sample_idx")).alias("row_index"), "source_id", "source",
                       "sample_idx", "sample")


def variant_tiles(variants: DataFrame, *, zoom: int) -> DataFrame:
    """Records of every tile they overlap; tiles follow from the interval, nothing is joined."""
    w = co.tile_width(zoom)
    return variants.where("end_bp > start_bp").withColumn(
        "tile", F.explode(F.sequence(div(F.greatest("start_bp", F.lit(0)), w), div(F.col("end_bp") - 1, w))))


def variants_in_windows(variants: DataFrame, windows: DataFrame, *, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """G9 for arbitrary windows (win_id, r_start, r_end)."""
    return overlap_join(variants, windows, keys=keys)


def variant_detail(variants: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each wanted (source, chrom, start_bp, ref, alt): INFO, the sample's ``KEY=value`` text, has_alt."""
    hit = variants.join(wanted.select("source", "chrom", "start_bp", "ref", "alt").distinct(),
                        ["source", "chrom", "start_bp", "ref", "alt"], "left_semi")
    rows = hit.select("*", F.posexplode("samples").alias("sample_idx", "__s"))
    values = F.split("__s.value", ":")
    pairs = F.transform("format", lambda k, i: F.concat(k, F.lit("="), F.coalesce(F.try_element_at(values, i + 1), F.lit(""))))
    text = F.when(F.size("format") == 0, ".").otherwise(F.array_join(pairs, "  "))
    gt = F.coalesce(sample_field("format", "__s.value", "GT"), F.lit(""))
    return rows.select("source", "chrom", "start_bp", "end_bp", "id", "ref", "alt", "qual", "filter",
                       F.coalesce("info", F.lit(".")).alias("info"), classify_variant("ref", "alt").alias("kind"),
                       "sample_idx", F.col("__s.sample").alias("sample"), text.alias("sample_text"),
                       sample_has_alt(gt).alias("has_alt"))


def list_variant_sources(variants: DataFrame) -> DataFrame:
    """(source_id, source, sample_names) with ids in name order."""
    from strandlake.operators.prefix import global_rank

    names = variants.groupBy("source").agg(F.max(F.transform("samples", lambda s: s["sample"])).alias("sample_names"))
    return global_rank(names, ["source"], "source_id")


def genotype_class_counts(genotypes: DataFrame, *, by: Sequence[str]) -> DataFrame:
    """One column per genotype class, counted per ``by``."""
    return genotypes.groupBy(*by).agg(*[
        F.sum((F.col("gt_class") == c).cast("bigint")).alias(f"n_{c}") for c in GT_CLASSES])


def apply_orientation_variants(genotypes: DataFrame, orientation: DataFrame) -> DataFrame:
    """Rows on reversed contigs flipped; REF, ALTs and genotype text complemented, kind kept."""
    o = orientation.where("reversed").select("chrom", F.col("length").alias("__l"))
    on = F.col("__l").isNotNull()
    s, e = co.flip_interval("start_bp", "end_bp", "__l")
    new = {"start_bp": s, "end_bp": e, "ref": revcomp_iupac("ref"), "alt": revcomp_alts("alt"),
           "gt_text": revcomp_genotype_text("gt_text")}
    return genotypes.join(o, "chrom", "left").select(*[
        F.when(on, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in genotypes.columns])
