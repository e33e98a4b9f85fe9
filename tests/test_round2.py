"""Limits that default to none, complete bins, load integrity, scratch folders and hot keys."""

import os
import random

import pytest
from pyspark.sql import functions as F

from strandlake import session
from strandlake import sources as src
from strandlake.operators import interval as iv, reads as rd, sequence as sq
from strandlake.operators.align import select_monotonic

FEATURES = "chrom string, source string, type string, start_bp int, end_bp int, strand string, phase tinyint, attributes string"


def feature(chrom, start, end):
    return (chrom, "s", "gene", start, end, "+", -1, "ID=x")


def test_load_remaps_names_lengthens_and_refuses(spark):
    seqs = spark.createDataFrame([("chr1.2", "ACGT"), ("chr2", "AC")], "chrom string, seq string")
    feats = spark.createDataFrame([feature("chr1", 0, 9), feature("chr2", 0, 1)], FEATURES)
    contigs, placed = src.load_genome([seqs], [feats])
    assert {(r.chrom, r.length) for r in contigs.collect()} == {("chr1.2", 9), ("chr2", 2)}
    assert {r.chrom for r in placed.collect()} == {"chr1.2", "chr2"}
    foreign = spark.createDataFrame([feature("zz", 0, 500)], FEATURES)
    with pytest.raises(ValueError, match="zz"):
        src.load_genome([seqs], [foreign])
    loose, _ = src.load_genome([seqs], [foreign], strict=False)
    assert {(r.chrom, r.length) for r in loose.collect()} == {("chr1.2", 4), ("chr2", 2), ("zz", 500)}
    with pytest.raises(ValueError):
        src.load_genome([], [foreign])


def test_load_from_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1\nACGT\n>c2\nGG\n")
    (tmp_path / "b.gff3").write_text("##gff-version 3\nc1\ts\tgene\t1\t3\t.\t+\t.\tID=g\n")
    contigs, feats = src.load_genome_files(spark, str(tmp_path))
    assert {r.chrom for r in contigs.collect()} == {"c1", "c2"} and feats.count() == 1
    (tmp_path / "c.gff3").write_text("##gff-version 3\nc1\ts\tgene\t1\t3\t.\t+\t.\tID=h\n##FASTA\n>c1\nACGA\n>c2\nGG\n")
    with pytest.raises(ValueError, match="does not match"):
        src.load_genome_files(spark, str(tmp_path))


def test_alignment_contigs_must_be_known(spark, tmp_path):
    (tmp_path / "a.sam").write_text("r1\t0\tc1\t1\t9\t4M\t=\t1\t0\tACGT\t*\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\t*\n")
    known = spark.createDataFrame([("c1.1", 10)], "chrom string, length int")
    rows = {r.name: r for r in src.read_alignments(spark, str(tmp_path), contigs=known).collect()}
    assert rows["r1"].chrom == rows["r1"].mate_chrom == "c1.1" and rows["r2"].chrom is None
    with pytest.raises(ValueError, match="c1"):
        src.read_alignments(spark, str(tmp_path), contigs=spark.createDataFrame([("x", 1)], "chrom string, length int"))


def test_sequence_before_a_header_is_found_however_far_in(spark, tmp_path):
    (tmp_path / "a.fa").write_text(" " * 70 + "ACGTACGT\n>x\nAC\n")
    with pytest.raises(ValueError, match="before header"):
        src.read_fasta(spark, str(tmp_path))


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_path(Cluster(), "x")
    path = session.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert session.path_exists(spark, path)
    assert spark.sparkContext.applicationId in path and os.path.basename(path).startswith("gone-")


def test_every_bin_of_a_view(spark):
    reads = spark.createDataFrame([("c", 10, 20, 100)], "chrom string, start_bp int, end_bp int, fragment_len int")
    got = rd.fragment_summary(reads, view_start=0, view_end=64, bins=32).collect()
    assert len(got) == 32 and sorted(r.p50 for r in got) == [-1] * 31 + [100]
    bins = spark.createDataFrame([("c", 0, 0, 3, 5)], "chrom string, tile int, bin int, forward int, reverse int")
    lengths = spark.createDataFrame([("c", 1024), ("d", 9)], "chrom string, length int")
    out = rd.strand_summary(bins, lengths, zoom=0, view_start=0, view_end=1024, bins=32).collect()
    assert len(out) == 64 and sum(r.forward for r in out) == 3.0


def test_points_and_touching_intervals_have_a_contig(spark):
    layout = spark.createDataFrame([("g", "a", 0, 10), ("g", "b", 20, 30)], "genome string, chrom string, start_bp bigint, end_bp bigint")
    w = spark.createDataFrame([("g", 1, 5, 5), ("g", 2, 10, 20), ("g", 3, 12, 18), ("g", 4, 29, 21), ("g", 5, 30, 30)],
                              "genome string, win_id int, w_start bigint, w_end bigint")
    got = {r.win_id: (r.contig, r.local_start, r.local_end) for r in iv.to_contig_coords(w, layout).collect()}
    assert got == {1: ("a", 5, 5), 2: ("a", 10, 10), 3: (None, None, None), 4: ("b", 1, 9), 5: ("b", 10, 10)}


def test_no_limit_by_default(spark):
    feats = spark.createDataFrame([feature("c", i, i + 5) for i in range(3000)], FEATURES)
    win = spark.createDataFrame([("c", 1, 0, 4000)], "chrom string, win_id int, r_start int, r_end int")
    assert iv.features_in_window(feats, win).count() == 3000
    assert iv.search_annotations(feats, "gene").count() == 3000
    contigs = spark.createDataFrame([("c", "ACGT" * 3000)], "chrom string, seq string")
    words = spark.createDataFrame([("CGTA",), ("AC",)], "pattern string")
    assert sq.dna_search(contigs, words, include_revcomp=False).groupBy("pattern").count().rdd.collectAsMap() == {"CGTA": 2999, "AC": 3000}


def test_salted_join_keeps_all_rows_of_a_hot_key(spark):
    asked = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), F.col("id"))
    table = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = sq.salted_join(asked, table, ["k"], ["id"], pile=50)
    assert sorted((r.id, r.v) for r in got.collect()) == sorted((i, 2 * (1 if i % 3 == 0 else i)) for i in range(1000))


@pytest.mark.parametrize("seed", range(20))
def test_monotonic_selection_equals_the_quadratic_statement(seed):
    rng = random.Random(seed)
    rows = sorted((q, q + rng.randrange(0, 9), t, t + rng.randrange(0, 9)) for q, t in ((rng.randrange(60), rng.randrange(60)) for _ in range(40)))
    weight = []
    for i, (q0, q1, t0, t1) in enumerate(rows):
        before = [weight[j] for j in range(i) if rows[j][1] <= q0 and rows[j][3] <= t0]
        weight.append(max(before, default=0) + max(q1 - q0, t1 - t0))
    picked = select_monotonic(*zip(*rows))
    assert all(rows[a][1] <= rows[b][0] and rows[a][3] <= rows[b][2] for a, b in zip(picked, picked[1:]))
    assert sum(max(rows[i][1] - rows[i][0], rows[i][3] - rows[i][2]) for i in picked) == max(weight)
