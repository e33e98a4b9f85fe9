"""Registered queries: contract, and a spread of them against DuckDB at the smallest scale."""

import os
import sys

import pytest

import __spark_entry__ as entry
from strandlake.plans import all_oracles, all_queries

SF = "/root/testdata/sf0.001"
SOME = (
    "list_contigs resolve_contigs overlap_join features_in_window spread_sample collapse_gene_cds dedupe_best "
    "mismatches_cigar coverage_bins coverage_runs fragment_summary infer_mate_contig genotype_class variant_detail "
    "gc_plot stop_codon_bins minimizers chain_anchors display_blocks filter_blocks read_fasta read_vcf"
).split()


def test_every_oracle_has_a_query():
    q, o = all_queries(), all_oracles()
    assert set(q) <= set(entry.queries()) and set(o) <= set(entry.oracle_sql())
    assert set(o) <= set(q) and len(q) >= 132
    assert set(q) - set(o) <= {"split_chains", "merge_chains", "align_gaps", "refine_blocks", "compare_genomes",
                               "found_block_variants", "block_details_store", "block_detail", "select_monotonic"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables absent")
@pytest.mark.parametrize("name", SOME)
def test_against_oracle(spark, name):
    try:
        import duckdb
    except ImportError:
        sys.path.append("/opt/oracle")
        duckdb = pytest.importorskip("duckdb")
    from strandlake.plans.fixtures import DRIVER_TABLES
    from tools.check import rows_of

    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(entry.oracle_sql()[name])
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall()) and got[0]
