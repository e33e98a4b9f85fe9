"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from strandlake import get_spark  # noqa: E402
from strandlake.plans import all_queries  # noqa: E402

HEADLINE = (
    "coverage_bins strand_coverage_bins coverage_runs coverage_from_runs depth_series read_tiles overlap_join "
    "features_in_window annotation_tiles collapse_gene_cds dedupe_exact mismatches_cigar read_snps mate_lookup "
    "fragment_summary pileup_counts genotypes_long genotype_class_counts variant_tiles gc_plot stop_codon_bins "
    "reference_slices dna_search minimizers seed_join chain_anchors compare_genomes"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=str(2 * int(cpus)) if cpus.isdigit() else "16",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "16g"), spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__sql__files__maxPartitionBytes="32m")
    spark.sparkContext.setLogLevel("ERROR")
    every = all_queries()
    # Stored tables (contigs, features, alignments) stand for data at rest: built before timing.
    t0 = time.time()
    from strandlake.plans.fixtures import STORED, Fixtures

    fx = Fixtures(spark, sf_dir)
    for name in STORED:
        getattr(fx, name)
    setup = time.time() - t0
    took = {}
    for name in names:
        t0 = time.time()
        try:
            every[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - t0, 3)
        except Exception as e:  # noqa: BLE001
            took[name] = None
            print(f"{name}: {type(e).__name__}: {str(e)[:300]}", file=sys.stderr)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, took[name], file=sys.stderr, flush=True)
    done = [t for t in took.values() if t is not None]
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(done), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""), "setup_sec": round(setup, 3),
        "failed": sum(t is None for t in took.values())}))
    spark.stop()


if __name__ == "__main__":
    main()
