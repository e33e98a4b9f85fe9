"""Exact-value cases of the table operators, and skewed inputs against plain Python."""

import random

from pyspark.sql import functions as F

from strandlake.operators import catalog as ct, interval as iv, reads as rd, sequence as sq, variants as va
from strandlake.operators.prefix import prefix_sums, previous_row

FEATURE = "chrom string, source string, type string, start_bp int, end_bp int, strand string, phase int, attributes string"
READ = ("name string, flags int, chrom string, start_bp int, end_bp int, mapq int, cigar string, read_seq string, md string, "
        "mate_chrom string, mate_pos int, tlen int")


def feats(spark, rows):
    return spark.createDataFrame([("c", "s", *r) for r in rows], FEATURE)


def test_search_slices_and_flips(spark):
    c = spark.createDataFrame([("c", "ACGTACGT")], "chrom string, seq string")
    p = spark.createDataFrame([("acg",)], "pattern string")
    hits = sorted(((r.strand, r.start_bp, r.end_bp) for r in sq.dna_search(c, p).collect()))
    assert hits == [("+", 0, 3), ("+", 4, 7), ("-", 1, 4), ("-", 5, 8)]
    capped = sq.dna_search(c, p, max_hits=3).collect()
    assert len(capped) == 3 and all(r.truncated for r in capped)
    r = spark.createDataFrame([(1, "c", 2, 6), (2, "c", 6, 99), (3, "c", 50, 60)], "id int, chrom string, start_bp int, end_bp int")
    for step in (3, 4096):
        got = {x.id: x.seq for x in sq.reference_slices(c, r, id_cols=("id",), step=step).collect()}
        assert got == {1: "GTAC", 2: "GT", 3: ""}
    o = spark.createDataFrame([("c", 8, True)], "chrom string, length int, reversed boolean")
    flipped = sq.apply_orientation_sequence(spark.createDataFrame([("c", "ACGTTGCA")], "chrom string, seq string"), o)
    assert flipped.first().seq[:4] == "TGCA"
    f = iv.apply_orientation_features(feats(spark, [("gene", 0, 2, "+", -1, "ID=a")]), o)
    assert (f.first().start_bp, f.first().end_bp, f.first().strand) == (6, 8, "-")
    assert iv.apply_orientation_features(f, o).first().start_bp == 0


def test_window_query_and_layout(spark):
    f = feats(spark, [("gene", 0, 4, "+", -1, "early"), ("gene", 2, 9, "+", -1, "mid"), ("gene", 8, 11, "+", -1, "tiny"),
                      ("gene", 10, 20, "+", -1, "late"), ("gene", 12, 30, "+", -1, "later")])
    w = spark.createDataFrame([(1, "c", 3, 13)], "win_id int, chrom string, r_start int, r_end int")
    got = iv.features_in_window(f, w, min_length=5, limit=2).orderBy("rank").collect()
    assert [r.attributes for r in got] == ["mid", "late"]
    lay = ct.concat_layout(spark.createDataFrame([("g", 0, "chrA", 4), ("g", 1, "chrB", 6)],
                                                 "genome string, ord int, chrom string, length int"), "ord")
    assert {r.chrom: (r.start_bp, r.end_bp) for r in lay.collect()} == {"chrA": (0, 4), "chrB": (54, 60)}


def test_overlap_join_with_long_intervals_and_a_hot_spot(spark):
    rng = random.Random(1)
    spans = lambda n: [(rng.choice("ab"), s, s + rng.choice([1, 30, 5000, 400000]))
                       for s in (rng.choice([777, rng.randint(0, 500000)]) for _ in range(n))]
    ls, rs = spans(300), spans(200)
    l = spark.createDataFrame([(i, *x) for i, x in enumerate(ls)], "lid int, chrom string, start_bp int, end_bp int")
    r = spark.createDataFrame([(i, *x) for i, x in enumerate(rs)], "rid int, chrom string, r_start int, r_end int")
    want = sorted((i, j) for i, a in enumerate(ls) for j, b in enumerate(rs) if a[0] == b[0] and a[1] < b[2] and a[2] > b[1])
    for size in (64, 1024):
        got = sorted((x.lid, x.rid) for x in iv.overlap_join(l, r, bin_size=size).collect())
        assert got == want


def test_two_level_windows_equal_plain_ones(spark):
    rng = random.Random(2)
    rows = [(rng.choice("aab"), rng.choice([5, rng.randint(-300, 3000)]), i, rng.randint(-5, 5)) for i in range(800)]
    d = spark.createDataFrame(rows, "k string, p int, t int, v int")
    got = {r.t: (r.s, r.prev) for r in previous_row(
        prefix_sums(d, ["k"], "p", {"s": F.col("v")}, ties=["t"], step=50), ["k"], "p", {"prev": F.col("t")}, ties=["t"], step=50).collect()}
    for k in "ab":
        total, prev = 0, None
        for _, p, t, v in sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2])):
            total += v
            assert got[t] == (total, prev)
            prev = t


def five_reads(spark):
    seq = "A" * 150
    rows = [("pair1", 99, "chrTest", 200, 325, 60, "125M", seq[:125], None, "chrTest", 420, 345),
            ("pair1", 147, "chrTest", 420, 545, 60, "125M", seq[:125], None, "chrTest", 200, -345),
            ("single_fwd", 0, "chrTest", 900, 1040, 60, "140M", seq[:140], None, None, -1, 0),
            ("single_rev", 16, "chrTest", 1500, 1635, 60, "135M", seq[:135], None, None, -1, 0),
            ("indel_like", 0, "chrTest", 2200, 2350, 60, "70M1I38M1D41M", seq, None, None, -1, 0)]
    return spark.createDataFrame(rows, READ)


def test_coverage_edges_mates_and_flips(spark):
    a = five_reads(spark)
    lens = spark.createDataFrame([("chrTest", 4000)], "chrom string, length int")
    runs = {(r.start_bp, r.end_bp): (r.depth, r.reverse) for r in rd.coverage_runs(a.unionByName(a)).collect()}
    assert runs[(200, 325)] == (1, False) and runs[(420, 545)] == (1, True) and runs[(2200, 2350)] == (1, False)
    bins = rd.coverage_bins(a, lens, zoom=0).where("tile = 0").orderBy("bin").collect()
    assert [b.depth for b in bins][48:83] == [0, 0] + [1] * 32 + [0] and len(bins) == 256
    assert rd.coverage_bins(a, lens, zoom=0).where("tile = 3").count() == 232
    m = {(r.name, r.start_bp): r for r in rd.mate_fields(a).collect()}
    assert (m["pair1", 200].mate_start, m["pair1", 200].mate_end, m["pair1", 200].same_ref_mate) == (420, 545, True)
    assert m["single_fwd", 900].mate_start is None and not m["single_fwd", 900].same_ref_mate
    o = spark.createDataFrame([("chrTest", 4000, True)], "chrom string, length int, reversed boolean")
    full = rd.soft_clips(rd.mate_fields(a))
    once = rd.apply_orientation_reads(full, o)
    flip = {(r.name, r.start_bp): r for r in once.collect()}
    assert flip["indel_like", 1650].cigar == "41M1D38M1I70M" and flip["pair1", 3675].flags == 99 ^ 16 ^ 32
    twice = rd.apply_orientation_reads(once, o)
    assert sorted(map(str, twice.collect())) == sorted(map(str, full.collect()))
    g = rd.pair_groups(full, view_bp=1000).where("n_reads = 2").first()
    assert (g.start_bp, g.end_bp) == (200, 545)


def test_pileup_against_plain_python(spark):
    rng = random.Random(6)
    ref = "".join(rng.choice("ACGTN") for _ in range(300))
    rows, want = [], {}
    for i in range(120):
        s = rng.choice([40, rng.randint(0, 200)])
        shape = rng.choice(["30M", "10M2D20M", "5S12M3I15M", "8M1X21M"])
        import re
        q, p, seq = 0, s, ""
        for n, op in re.findall(r"(\d+)([A-Z])", shape):
            for _ in range(int(n)):
                if op in "MX":
                    b = rng.choice("ACGT") if op == "X" or rng.random() < 0.1 else ref[p]
                    seq += b
                    shown = b if op == "X" or ("N" not in (b + ref[p]) and b != ref[p]) or b != ref[p] else ref[p]
                    want.setdefault(p, {}).setdefault(shown, 0)
                    want[p][shown] += 1
                    p += 1
                elif op == "D":
                    want.setdefault(p, {}).setdefault("D", 0)
                    want[p]["D"] += 1
                    p += 1
                else:
                    seq += rng.choice("ACGT")
        rows.append((f"r{i}", 0, "c", s, p, 60, shape, seq, None, None, -1, 0))
    a = spark.createDataFrame(rows, READ)
    c = spark.createDataFrame([("c", ref)], "chrom string, seq string")
    got = {}
    for r in rd.pileup_counts(a, c, ["name"], step=64).collect():
        got.setdefault(r.pos, {})[r.base] = r.n
    assert got == {p: {b: n for b, n in d.items() if b in "ACGTD"} for p, d in want.items() if set(d) & set("ACGTD")}


def test_gene_cds_and_annotations(spark):
    f = feats(spark, [("gene", 0, 90, "+", -1, "ID=g1"), ("mRNA", 0, 90, "+", -1, "ID=m1;Parent=g1"), ("CDS", 50, 60, "+", 0, "ID=c2;Parent=m1"),
                      ("CDS", 0, 10, "+", 0, "ID=c1;Parent=m1"), ("exon", 0, 10, "+", -1, "ID=e1;Parent=m1"), ("gene", 100, 130, "-", -1, "ID=g2"),
                      ("CDS", 100, 130, "-", 0, "ID=c3;Parent=zz"), ("exon", 100, 130, "-", -1, "ID=e2;Parent=g2"), ("CDS", 7, 9, "+", 0, "ID=lost;Parent=q")])
    got = {r.attributes: r.n_parts for r in iv.collapse_gene_cds(f).collect()}
    assert got == {"ID=g1": 2, "ID=g2": 1, "ID=e2;Parent=g2": 0, "ID=lost;Parent=q": 0}
    parts = iv.gene_cds_parts(f).where("gene = 'g1'").orderBy("part_no").collect()
    assert [p.start_bp for p in parts] == [0, 50]


def test_variants(spark):
    v = spark.createDataFrame([("v", "c", 2, 3, "x", "C", "T", 1.0, "PASS", "i", ["GT"], [("a", "0/1"), ("b", "1|1"), ("d", "0/0"), ("e", "1/2"), ("f", "./.")])],
                              "source string, chrom string, start_bp int, end_bp int, id string, ref string, alt string, qual double, filter string, "
                              "info string, format array<string>, samples array<struct<sample:string,value:string>>")
    g = va.genotypes_long(v)
    assert [(r.gt_class, r.gt_text, r.has_alt) for r in g.orderBy("sample_idx").collect()] == [
        ("het", "C/T", True), ("hom_alt", "T", True), ("ref", "C", False), ("missing", "", True), ("missing", "", False)]
    o = spark.createDataFrame([("c", 10, True)], "chrom string, length int, reversed boolean")
    r = va.apply_orientation_variants(g, o).orderBy("sample_idx").first()
    assert (r.start_bp, r.end_bp, r.ref, r.alt, r.gt_text) == (7, 8, "G", "A", "G/A")


def test_stop_codons_gc_and_translation(spark):
    seq = "ATAAGTCATTAGNN" * 200
    c = spark.createDataFrame([("c", seq)], "chrom string, seq string")
    want = set()
    for t0 in range(0, len(seq), 1024):
        t1 = min(t0 + 1024, len(seq))
        for p in range(t0, t1 - 2):
            for words, up in (({"TAA", "TAG", "TGA"}, 0), ({"TTA", "CTA", "TCA"}, 3)):
                if seq[p:p + 3] in words:
                    want.add((t0 // 1024, p % 3 + up, min((p + 1 - t0) * 512 // (t1 - t0), 511)))
    assert {(r.tile, r.frame, r.bin) for r in sq.stop_codon_bins(c, step=100).collect()} == want
    for r in sq.gc_plot(c, window=50).where("tile = 1").collect():
        t1 = 2048
        mid = 1024 + int((r.bin + 0.5) * (t1 - 1024) / 256)
        win = seq[max(mid - 25, 0):mid + 25].replace("N", "")
        assert abs(r.gc - sum(b in "GC" for b in win) / len(win)) < 1e-12
    aa = sq.six_frame_translation(c, piece=50).where("frame = 1").orderBy("piece").collect()
    assert len("".join(r.aa for r in aa)) == (len(seq) - 1) // 3 and aa[0].aa[:3] == "*VI"


def test_one_hot_name_or_place_stays_whole(spark):
    """A third of all reads are copies of one; nothing is dropped and nothing pairs up."""
    one = five_reads(spark)
    pile = one.where("name = 'pair1'").withColumn("id", F.explode(F.sequence(F.lit(1), F.lit(3000)))).drop("id")
    many = one.unionByName(pile)
    assert rd.dedupe_exact(many).count() == 5
    m = rd.mate_fields(pile).withColumn("rid", F.monotonically_increasing_id())
    assert rd.mate_lookup(m, "rid").where("mate_id is not null").count() == 6000
    assert rd.stack_depth(rd.soft_clips(many)).first().rows_needed == 3001
