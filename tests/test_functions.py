"""Exact-value cases of the scalar functions."""

from pyspark.sql import functions as F

from strandlake.functions import annotation as an, cigar as cg, coords as co, dna
from strandlake.operators.catalog import normalize_chrom_alias


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first().asDict()


def lit(x):
    return F.lit(x)


def test_bases_and_complements(spark):
    got = one(
        spark, u=dna.normalize_base(lit("u")), bad=dna.normalize_base(lit("R")), nd=dna.normalize_dna(lit("acuR-t")),
        strict=dna.revcomp_strict(lit("AACG")), strict_n=dna.revcomp_strict(lit("AACN")), rc=dna.revcomp(lit("AaCRG")),
        iupac=dna.revcomp_iupac(lit("ACRN")), lower=dna.revcomp_iupac(lit("ac")), sym=dna.revcomp_iupac(lit("<DEL>")),
        alts=dna.revcomp_alts(lit("AC,<DEL>,G")), gt=dna.revcomp_genotype_text(lit("C/T")), dot=dna.revcomp_genotype_text(lit(".")))
    assert got == {"u": "T", "bad": None, "nd": "ACTNNT", "strict": "CGTT", "strict_n": None, "rc": "CNGNT", "iupac": "NYGT",
                   "lower": "GT", "sym": "<DEL>", "alts": "GT,<DEL>,C", "gt": "G/A", "dot": "."}


def test_codons_and_kmers(spark):
    got = one(spark, m=dna.translate_codon(lit("ATG")), stop=dna.translate_codon(lit("TGA")), x=dna.translate_codon(lit("ANG")),
              short=dna.translate_codon(lit("AT")), is_stop=dna.is_stop_codon(lit("TAG")), key=dna.kmer_key(lit("ACGT")),
              none=dna.kmer_key(lit("ACNT")))
    assert got == {"m": "M", "stop": "*", "x": "X", "short": "", "is_stop": True, "key": 0b00011011, "none": None}


def test_cigar(spark):
    got = one(spark, rev=cg.reverse_cigar(lit("70M1I38M1D41M")), bad=cg.reverse_cigar(lit("70M1")), nul=cg.parse_cigar(lit("M5")),
              empty=F.size(cg.parse_cigar(lit(""))), span=cg.reference_span(lit("70M1I38M1D41M")), none=cg.reference_span(lit(""), lit(9)),
              md=cg.md_mismatches(lit("5A3^AC2T0G1"), lit(100)), marks=cg.indel_markers(lit("5S10M2I3M4D2M"), lit(50)))
    assert got["rev"] == "41M1D38M1I70M" and got["bad"] == "70M1" and got["nul"] is None and got["empty"] == 0
    assert got["span"] == 150 and got["none"] == 9
    assert got["md"] == [105, 113, 114]
    assert [tuple(m) for m in got["marks"]] == [("ins", 60, 60), ("del", 63, 67)]


def test_read_bases_and_clips(spark):
    ops = cg.placed_ops(lit("2S3M1D2M1I1M"), lit(10))
    left, right = cg.soft_clips(lit("3S4M2S"), lit("xuGACGTaR"))
    got = one(spark, a=cg.read_base_at(ops, lit("GGACTTGCA"), lit(10)), gone=cg.read_base_at(ops, lit("GGACTTGCA"), lit(13)),
              b=cg.read_base_at(ops, lit("GGACTTGCA"), lit(16)), left=left, right=right)
    assert got == {"a": "A", "gone": None, "b": "A", "left": "NTG", "right": "AN"}


def test_attributes_and_locations(spark):
    lo, hi = an.parse_location(lit("join(complement(<5..10),20..>30)"))
    lo2, hi2 = an.parse_location(lit("J00194.1:100..202"))
    z0, z1 = an.parse_location(lit("unknown"))
    got = one(spark, name=an.feature_name(lit('ID=x;gene="abc"'), lit("CDS")), inner=an.gff_attribute(lit("subgene=1;gene=2"), "gene"),
              typ=an.feature_name(lit("note=1"), lit("CDS")), q=an.parse_qualifier(lit('   /gene="abc"')), bare=an.parse_qualifier(lit("FT   /pseudo")),
              no=an.parse_qualifier(lit("text")), lo=lo, hi=hi, lo2=lo2, hi2=hi2, z0=z0, z1=z1)
    assert got == {"name": "abc", "inner": "2", "typ": "CDS", "q": "gene=abc", "bare": "pseudo", "no": None, "lo": 4, "hi": 30,
                   "lo2": 99, "hi2": 202, "z0": 0, "z1": 0}


def test_coordinates(spark):
    s, e = co.flip_interval(lit(0), lit(2), lit(8))
    got = one(spark, s=s, e=e, p=co.flip_point(lit(2), lit(10)), small=co.mean_depth_bin(lit(1), lit(10)), half=co.mean_depth_bin(lit(5), lit(2)),
              top=co.mean_depth_bin(lit(10 ** 9), lit(1)), bins=co.coverage_bin_count(lit(1024), lit(2048), lit(1536)), full=co.coverage_bin_count(lit(0), lit(1024), lit(4000)),
              z=co.zoom_for(lit(6.0)), z0=co.zoom_for(lit(0.0)), z16=co.zoom_for(lit(1e9)), neg=co.div(lit(-1), 512),
              alias=normalize_chrom_alias(lit("chr1.12")), keep=normalize_chrom_alias(lit("chr.v1")),
              frame=co.feature_frame(lit("CDS"), lit("-"), lit(0), lit(10), lit(1)), other=co.feature_frame(lit("exon"), lit("+"), lit(0), lit(9), lit(0)),
              label=co.location_label(lit("c"), lit(4), lit(9)))
    assert got == {"s": 6, "e": 8, "p": 7, "small": 1, "half": 3, "top": 1000000000, "bins": 128, "full": 256, "z": 3, "z0": 0, "z16": 16,
                   "neg": -1, "alias": "chr1", "keep": "chr.v1", "frame": 3, "other": -1, "label": "c:5-9"}
