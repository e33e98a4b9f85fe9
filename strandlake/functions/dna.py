"""Base and k-mer expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# IUPAC symbols and their complements (U pairs like T).
IUPAC = "ACGTURYSWKMBDHVN"
IUPAC_COMPLEMENT = "TGCAAYRSWMKVHDBN"

# The standard genetic code, amino acid -> codons.
STANDARD_CODE = {
    "A": "GCT GCC GCA GCG",
    "C": "TGT TGC",
    "D": "GAT GAC",
    "E": "GAA GAG",
    "F": "TTT TTC",
    "G": "GGT GGC GGA GGG",
    "H": "CAT CAC",
    "I": "ATT ATC ATA",
    "K": "AAA AAG",
    "L": "TTA TTG CTT CTC CTA CTG",
    "M": "ATG",
    "N": "AAT AAC",
    "P": "CCT CCC CCA CCG",
    "Q": "CAA CAG",
    "R": "CGT CGC CGA CGG AGA AGG",
    "S": "TCT TCC TCA TCG AGT AGC",
    "T": "ACT ACC ACA ACG",
    "V": "GTT GTC GTA GTG",
    "W": "TGG",
    "Y": "TAT TAC",
    "*": "TAA TAG TGA",
}
STOP_CODONS = ("TAA", "TAG", "TGA")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_base(base: Column | str) -> Column:
    """A/C/G/T/N in upper case, U as T, anything else NULL."""
    up = F.translate(F.upper(col(base)), "U", "T")
    return F.when(up.isin("A", "C", "G", "T", "N"), up)


def normalize_dna(seq: Column | str) -> Column:
    """Upper case, U as T, every other symbol N."""
    return F.regexp_replace(F.translate(F.upper(col(seq)), "U", "T"), "[^ACGT]", "N")


def revcomp_strict(seq: Column | str) -> Column:
    """Reverse complement, NULL when a symbol is not A, C, G or T."""
    s = col(seq)
    return F.when(s.rlike("^[ACGT]*$"), F.reverse(F.translate(s, "ACGT", "TGCA")))


def revcomp(seq: Column | str) -> Column:
    """C4: reverse complement in which every symbol but upper-case ACGT becomes N."""
    return F.reverse(F.translate(F.regexp_replace(col(seq), "[^ACGT]", "N"), "ACGT", "TGCA"))


def revcomp_iupac(seq: Column | str) -> Column:
    """IUPAC reverse complement; text with a foreign symbol stays as it is."""
    s = col(seq)
    turned = F.reverse(F.translate(F.upper(s), IUPAC, IUPAC_COMPLEMENT))
    return F.when(F.upper(s).rlike(f"^[{IUPAC}]*$"), turned).otherwise(s)


def revcomp_alts(alts: Column | str) -> Column:
    """C5 on each comma-separated ALT, order kept."""
    return F.array_join(F.transform(F.split(col(alts), ","), revcomp_iupac), ",")


def revcomp_genotype_text(text: Column | str) -> Column:
    """C5 on each slash-separated allele; empty and '.' stay."""
    t = col(text)
    turned = F.array_join(F.transform(F.split(t, "/"), lambda a: revcomp_iupac(F.trim(a))), "/")
    return F.when(t.isin("", "."), t).otherwise(turned)


def translate_codon(codon: Column | str) -> Column:
    """Amino acid of the standard code, '*' stop, 'X' unknown, '' unless three long."""
    c = F.translate(F.upper(col(codon)), "U", "T")
    pairs = [(F.lit(cod), F.lit(aa)) for aa, cods in STANDARD_CODE.items() for cod in cods.split()]
    table = F.create_map(*[x for pair in pairs for x in pair])
    return F.when(F.length(c) != 3, F.lit("")).otherwise(F.coalesce(F.try_element_at(table, c), F.lit("X")))


def is_stop_codon(codon: Column | str) -> Column:
    """C9."""
    return col(codon).isin(*STOP_CODONS)


def kmer_key(kmer: Column | str) -> Column:
    """2-bit packed k-mer (A0 C1 G2 T3) as BIGINT; NULL when a symbol is not ACGTU."""
    k = F.translate(F.upper(col(kmer)), "U", "T")
    return F.when(
        k.rlike("^[ACGT]+$"), F.conv(F.translate(k, "ACGT", "0123"), 4, 10).cast("bigint")
    )
