"""Findings of the third report: steps of the comparison, gene parts, slices, workspace, windows."""

import random

import duckdb

from strandlake.operators import compare as cp, interval as iv, sequence as sq
from strandlake.plans.intervals import COLLAPSE
from strandlake.sources import load_workspace, save_workspace


def rows(df, cols):
    return sorted(map(repr, df.select(*cols).collect()))


def made_anchors(spark):
    rnd, out = random.Random(5), []
    for pair in range(6):
        for _ in range(25):  # runs of anchors along a diagonal that shifts now and then, with copies
            q, t = rnd.randrange(30000), rnd.randrange(30000)
            for _ in range(rnd.randrange(1, 40)):
                out.append((f"a{pair}", f"b{pair}", f"c{pair % 2}", "d", pair % 3 > 0, q, 70000 - t, t))
                if rnd.random() < 0.1:
                    out.append(out[-1])
                step = rnd.choice([3, 8, 15, 40, 200, 9000 if rnd.random() < 0.05 else 20])
                q, t = q + step, t + step + rnd.choice([0, 0, 0, 0, 2, -2, 90])
    names = "q_genome string, t_genome string, q_chrom string, t_chrom string, same_strand boolean, q_pos int, t_pos int, t_trans int"
    return cp.bucket_anchors(spark.createDataFrame(out, names)).localCheckpoint()


def test_short_chains_equal_those_by_windows(spark):
    anchors = made_anchors(spark)
    cols = [*cp.CHAIN, "q_pos", "t_pos", "t_trans", "prev_q", "prev_t"]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # buckets that go over batches
    try:
        chained = cp._short_chains(anchors, 15).localCheckpoint()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows(chained, cols) == rows(cp._long_chains(anchors, 15), cols)
    parted = cp.split_chains(chained).localCheckpoint()
    cols = [*cols, "part"]
    assert rows(parted, cols) == rows(cp._split_long_chains(chained, 15), cols)
    merged = cp.merge_chains(cp.chain_summary(parted, cp.PART))
    together = cp.merged_anchors(parted, merged).localCheckpoint()
    cols = [*cp.MERGED, *cp.PIECE]
    pieces = cp.chain_pieces(together)
    assert {r[0] for r in pieces.select("kind").distinct().collect()} == {"M", "G", "E"}
    assert rows(pieces, cols) == rows(cp._long_chain_pieces(together, 15), cols)


def test_short_chains_are_cut_and_walked_after_one_shuffle(spark):
    chained = cp._short_chains(made_anchors(spark), 15).localCheckpoint()
    parted = cp.split_chains(chained)
    assert parted._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    together = cp.merged_anchors(parted, cp.merge_chains(cp.chain_summary(parted, cp.PART))).localCheckpoint()
    assert cp.chain_pieces(together)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_rows_without_grandparent_count_as_blank(spark):
    """As in the SQL: a gene without an id that has several parts takes the rows whose grandparent is unknown."""
    row = lambda kind, start, end, attributes: ("c", "ref", kind, start, end, "+", 0, attributes)
    f = spark.createDataFrame([
        row("gene", 10, 90, "Name=x"), row("CDS", 10, 90, "ID=f1;Parent=zz"), row("CDS", 10, 90, "ID=f2;Parent=zz"),
        row("exon", 5, 9, "ID=e1;Parent=qq"), row("gene", 200, 300, "ID=g1"), row("mRNA", 200, 300, "ID=m1;Parent=g1"),
        row("CDS", 210, 220, "ID=c1;Parent=m1"), row("exon", 210, 220, "ID=e2;Parent=m1"), row("region", 0, 900, "ID=r")],
        "chrom string, source string, type string, start_bp int, end_bp int, strand string, phase int, attributes string")
    got = {r.attributes: r.n_parts for r in iv.collapse_gene_cds(f).collect()}
    features = f.toPandas()  # noqa: F841
    multi = duckdb.sql(COLLAPSE + " select gene from m").fetchall()
    gone = duckdb.sql(COLLAPSE + " select attributes from k where kind not in ('gene', 'cds') and coalesce(gp, '') in (select gene from m)").fetchall()
    assert multi == [("",)] and sorted(gone) == [("ID=e1;Parent=qq",), ("ID=m1;Parent=g1",)]
    assert got == {"Name=x": 2, "ID=g1": 1, "ID=r": 0, "ID=e2;Parent=m1": 0}
    parts = iv.gene_cds_parts(f)
    assert sorted((r.gene, r.attributes, r.part_no) for r in parts.collect()) == [
        ("", "ID=f1;Parent=zz", 1), ("", "ID=f2;Parent=zz", 2), ("g1", "ID=c1;Parent=m1", 1)]


def test_windows_are_ranked_where_features_meet_them(spark):
    rnd = random.Random(3)
    place = lambda most: (lambda s: (s, s + rnd.randrange(1, most)))(rnd.randrange(60000))
    spans = [place(900) for _ in range(400)] + [place(30000) for _ in range(20)] + [(0, 900000), (5, 5), (12000, 700000)]
    f = spark.createDataFrame([("c", s, e, "gene", "+", f"ID={i}") for i, (s, e) in enumerate(spans)],
                              "chrom string, start_bp int, end_bp int, type string, strand string, attributes string")
    asked = [place(700) for _ in range(60)] + [(0, 1024), (4095, 4096), (4095, 5119), (7, 7)]
    table = lambda spans: spark.createDataFrame([("c", i, s, e) for i, (s, e) in enumerate(spans)], "chrom string, win_id int, r_start int, r_end int")

    def brute(asked, limit=None):
        out = []
        for i, (r0, r1) in enumerate(asked):
            hit = sorted((s, e, f"ID={k}") for k, (s, e) in enumerate(spans) if s < e and r0 < r1 and s < r1 and e > r0)
            by_place = sorted(hit, key=lambda x: (x[0], x[1], x[2]))
            out += [(i, a, n + 1) for n, (_, _, a) in enumerate(by_place[:limit])]
        return sorted(out)

    got = lambda df: sorted((r.win_id, r.attributes, r["rank"]) for r in df.collect())
    short = iv.features_in_window(f, table(asked))
    assert got(short) == brute(asked)
    moved = [x for x in short._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in x]
    assert moved and not any("win_id" in x.split("REPARTITION")[0] for x in moved)
    wide = asked + [(3000, 40000), (0, 900000), (50000, 51025)]
    assert got(iv.features_in_window(f, table(wide))) == brute(wide)
    assert got(iv.features_in_window(f, table(wide), limit=3)) == brute(wide, 3)


def test_workspace_files_do_not_grow_with_genomes(spark, tmp_path):
    rows = spark.range(600).selectExpr("concat('00', id % 300) as genome", "cast(id as int) as start_bp", "id % 2 = 0 as reversed")
    save_workspace(str(tmp_path / "w"), segments=rows)
    assert len(list((tmp_path / "w").rglob("*.parquet"))) <= 20
    back = load_workspace(spark, str(tmp_path / "w"), "segments")["segments"]
    assert back.schema["genome"].dataType.simpleString() == "string"
    assert sorted(back.select(*rows.columns).collect()) == sorted(rows.collect())
    rows.write.partitionBy("genome").parquet(str(tmp_path / "old" / "segments"))
    old = load_workspace(spark, str(tmp_path / "old"), "segments")["segments"]
    assert sorted(old.select(*rows.columns).collect()) == sorted(rows.collect())


def test_short_slices_are_cut_from_one_chunk(spark):
    rnd = random.Random(9)
    seqs = {"a": "".join(rnd.choice("ACGT") for _ in range(300)), "b": "ACGTN", "e": ""}
    contigs = spark.createDataFrame(list(seqs.items()), "chrom string, seq string")
    asked = [(rnd.choice("abex"), s := rnd.randrange(-20, 320), s + rnd.randrange(0, 17)) for _ in range(200)] + [("a", 16, 32), ("a", 284, 300)]
    long = [("a", -5, 400), ("a", 10, 100), ("b", 0, 90), ("x", 0, 50)]
    for spans in (asked, asked + long):
        regions = spark.createDataFrame([(i, *x) for i, x in enumerate(spans)], "id int, chrom string, start_bp int, end_bp int")
        for pile in (20000, 5):  # with hot chunks as well
            got = sq.reference_slices(contigs, regions, id_cols=("id",), step=16, pile=pile)
            want = {i: seqs.get(c, "")[max(s, 0):max(e, 0)] for i, (c, s, e) in enumerate(spans)}
            assert {r.id: r.seq for r in got.collect()} == want and got.count() == len(spans)
    short = sq.reference_slices(contigs, regions.where(f"id < {len(asked)}"), id_cols=("id",), step=16)
    plan = short._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and plan.count("Join") == 1
