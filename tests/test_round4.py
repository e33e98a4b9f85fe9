"""Cases of the fourth round: steps whose work must not grow faster than their input."""

import re

from strandlake.operators import reads as rd, sequence as sq
from strandlake.plans.fixtures import Fixtures
from strandlake.sources import splits as sp

SMALL = "/root/testdata/sf0.001"


def _plan(df) -> list[str]:
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_line_items_meet_thousands_by_equal_keys(spark):
    fx = Fixtures(spark, SMALL)
    for name in ("placed", "cut_reads"):
        loops = [x for x in _plan(getattr(fx, name)) if "NestedLoopJoin" in x or "CartesianProduct" in x]
        # Only the one row with the number of thousands meets all.
        assert all(", Cross" in x and not re.search(r"\bno#\d+", x) for x in loops), loops


def test_mates_are_those_of_the_pairs(spark):
    """Rows dealt line by line find the other contig, all others their own; the same as a window over each pair's name."""
    fx = Fixtures(spark, SMALL)
    a = fx.alignments
    b = a.selectExpr("name", "rn as m_rn", "chrom as m_chrom", "start_bp as m_start", "end_bp as m_end", "flags as m_flags")
    both = a.join(b, "name", "left").where("m_rn <> rn")
    wrong = both.where("""mate_chrom is distinct from m_chrom or mate_pos <> m_start or (flags & 8) <> 0
      or (flags & 32) <> 2 * (m_flags & 16) or ((flags & 2) <> 0) <> (m_chrom = chrom)""")
    assert wrong.count() == 0 and both.count() == 2 * a.where("flags & 8 = 0 and rn % 2 = 1").count()
    alone = a.where("flags & 8 <> 0")
    assert alone.where("mate_chrom is not null or mate_pos <> -1 or tlen <> 0").count() == 0
    assert both.where("m_chrom <> chrom").count() > 0 and alone.count() > 0


def test_small_splits_share_tasks(spark, tmp_path):
    lines = [f"line {i} {'x' * (i % 50)}" for i in range(2000)]
    (tmp_path / "some.txt").write_text("\n".join(lines))
    got = sp.split_lines(spark, sp.listing(spark, str(tmp_path)), split=128)
    assert got.rdd.getNumPartitions() <= sp.TASKS_A_CORE * spark.sparkContext.defaultParallelism
    assert [r.value for r in got.orderBy("id").collect()] == lines


def test_tasks_follow_the_bytes_of_splits(spark):
    at = spark.range(3000).selectExpr("id * 67108864 as start", "(id + 1) * 67108864 as stop")
    assert sp.tasks_for(at) == 3000
    assert sp.tasks_for(spark.range(100).selectExpr("0L as start", "cast(null as bigint) as stop")) == 100
    assert sp.tasks_for(at.limit(0)) == 1


def test_plain_and_mixed_places_of_a_pileup(spark):
    """Two reads on a contig of which one names a mismatch and lacks two bases; a lower-case base counts, N and gaps in cover do not."""
    contigs = spark.createDataFrame([("c", "ACGTaNCCGGTT")], "chrom string, seq string")
    reads_ = spark.createDataFrame([(1, "c", 0, 8, 0, "8M", "TCGTAACC", "0A7"), (2, "c", 2, 8, 16, "2M2D2M", "GTCC", "2^AN2")],
                                   "rid int, chrom string, start_bp int, end_bp int, flags int, cigar string, read_seq string, md string")
    got = {(r.pos, r.ord): (r.ref_base, r.base, r.n, r.frac) for r in rd.pileup_counts(reads_, contigs, ["rid"], step=4).collect()}
    assert got == {(0, 0): ("A", "T", 1, 1.0), (1, 0): ("C", "C", 1, 1.0), (2, 0): ("G", "G", 2, 1.0), (3, 0): ("T", "T", 2, 1.0),
                   (4, 0): ("A", "A", 1, 0.5), (4, 1): ("A", "D", 1, 0.5), (5, 0): ("N", "D", 1, 1.0), (6, 0): ("C", "C", 2, 1.0),
                   (7, 0): ("C", "C", 2, 1.0)}
    # The places of one letter are read from stored runs, apart from those with several.
    assert any("pileup_runs" in f for f in rd.pileup_counts(reads_, contigs, ["rid"]).inputFiles())


def test_gc_of_narrow_tiles_sends_no_rows(spark):
    seqs = {"a": "ACGT" * 700 + "N" * 300 + "gcuat" * 90, "n": "N" * 50, "g": "G", "none": ""}
    contigs = spark.createDataFrame(list(seqs.items()), "chrom string, seq string")
    got = sq.gc_plot(contigs, window=75, bins=16)
    assert "Exchange" not in "\n".join(_plan(got))
    want = {}
    for c, s in seqs.items():
        for t in range(0, len(s), 1024):
            end = min(t + 1024, len(s))
            for b in range(16):
                w0 = t + int((b + 0.5) * (end - t) / 16) - 37
                cut = s[max(w0, 0):min(w0 + 75, len(s))].upper()
                n = sum(x in "ACGTU" for x in cut)
                want[c, t // 1024, b] = sum(x in "GC" for x in cut) / n if n else -1.0
    assert {(r.chrom, r.tile, r.bin): r.gc for r in got.collect()} == want
    chunked = sq.seq_chunks(contigs, step=512)
    assert {(r.chrom, r.tile, r.bin): r.gc for r in sq.gc_plot(chunked, window=75, bins=16).collect()} == want
