"""Readers and writers.

Files may be plain or compressed by gzip, bgzip, bzip2, xz or zstd; sequence files and BGZF files are read in byte splits.
"""

from strandlake.sources.chunked import read_fasta_chunks, read_gff3_chunks
from strandlake.sources.detect import detect_input_kinds, gather_inputs, inspect_inputs
from strandlake.sources.genome import (
    load_genome, load_genome_files, read_embl, read_embl_chunks, read_fasta, read_genbank, read_genbank_chunks, read_gff3, read_gff3_sequences)
from strandlake.sources.records import read_alignments, read_vcf, vcf_sample_names
from strandlake.sources.workspace import load_block_details, load_workspace, save_block_details, save_workspace

__all__ = [
    "detect_input_kinds", "gather_inputs", "inspect_inputs", "load_block_details", "load_genome", "load_genome_files", "load_workspace",
    "read_alignments", "read_embl", "read_embl_chunks", "read_fasta", "read_fasta_chunks", "read_genbank", "read_genbank_chunks",
    "read_gff3", "read_gff3_chunks", "read_gff3_sequences", "read_vcf",
    "save_block_details", "save_workspace", "vcf_sample_names",
]
