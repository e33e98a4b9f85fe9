"""Seeds that meet where they lie together, and steps whose memory, disk or time was above the limits."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.operators import compare as cp
from strandlake.operators import pairing
from strandlake.operators.sequence import minimizer_lists, minimizers


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


@pytest.fixture(scope="module")
def contigs(spark):
    rng = random.Random(11)
    core, unit = dna(rng, 3000), dna(rng, 23)
    rows = []
    for g in range(3):
        rows += [(f"g{g}", "one", core[: 900 * (g + 1)] + unit * (20 + 9 * g) + dna(rng, 200)), (f"g{g}", "two", core[1000:][::-1]),
                 (f"g{g}", "same", "A" * 300 + core[500:900] + "N" * 30 + core[1500:1900]), (f"g{g}", "tiny", "ACGT"), (f"g{g}", "none", "")]
    rows.append(("g1", "turned", core[:2000][::-1].translate(str.maketrans("ACGT", "TGCA"))))
    return spark.createDataFrame(rows, "genome string, chrom string, seq string").localCheckpoint()


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([("g0", "g1"), ("g1", "g2"), ("g2", "g2"), ("g0", "g1"), ("g0", "gone")], "q_genome string, t_genome string")


def rows(df):
    return Counter(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def test_minimizer_lists_hold_the_minimizers(contigs):
    keys = ("genome", "chrom")
    for step in (64, 1 << 16):
        lists = minimizer_lists(contigs, keys=keys, step=step)
        each = lists.select(*keys, "length", "reverse", F.explode(F.arrays_zip("pos", "key")).alias("x")).select(*keys, "length", "x.pos", "x.key", "reverse")
        for reverse in (False, True):
            assert rows(each.where(F.col("reverse") == reverse).drop("reverse")) == rows(minimizers(contigs, keys=keys, reverse=reverse))


@pytest.mark.parametrize("both", [True, False])
def test_chains_without_a_row_for_each_anchor(spark, contigs, pairs, both, monkeypatch):
    anchors = cp.anchors_for(contigs, pairs, both_strands=both)
    chains, buckets = rows(cp.chain_anchors(anchors)), rows(anchors.groupBy(*cp.PAIR, "bucket").agg(F.count("*").alias("n")))
    assert len(chains) > 1000
    assert rows(cp.chains_for(contigs, pairs, both_strands=both)) == chains
    assert rows(cp.bucket_sizes(contigs, pairs, both_strands=both)) == buckets
    plan = cp.chains_for(contigs, pairs, both_strands=both)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 0 and "MapInArrow" in plan
    # A genome above the limit, slots of few seeds: the same rows.
    monkeypatch.setattr(cp, "SLOT_SEEDS", 200)
    assert rows(cp.chains_for(contigs, pairs, both_strands=both)) == chains
    monkeypatch.setattr(cp, "FOLD_SEEDS", 900)
    assert rows(cp.chains_for(contigs, pairs, both_strands=both)) == chains
    assert rows(cp.bucket_sizes(contigs, pairs, both_strands=both)) == buckets


@pytest.mark.parametrize("most", [7, 100, 5000, 10**7])
def test_anchor_sets_are_bounded_and_whole(most):
    rng = np.random.default_rng(3)
    n = 1200
    contig = np.sort(rng.integers(0, 4, n))
    contig[n // 2 :] += 4
    query, key = np.arange(n) < n // 2, rng.integers(0, 12, n)
    pos = rng.permutation(4000)[:n]
    group = (contig % 4) // 2
    along = np.where(query, pos, rng.integers(0, 4000, n))
    q, t = pairing.sides(group, contig, query, key, pos, along)
    want = Counter()
    for i in np.flatnonzero(query):
        for j in np.flatnonzero(~query & (key == key[i]) & (group == group[i])):
            want[contig[i], contig[j], (along[j] - pos[i]) // 512, pos[i], along[j], pos[j]] = 1
    got, sizes, last = Counter(), [], None
    for a, goes_on in pairing.anchor_sets(q, t, 512, most):
        each = list(zip(*(a[c].tolist() for c in ("q", "t", "bucket", "q_pos", "t_trans", "t_pos"))))
        assert each == sorted(each)
        got.update(each)
        sizes.append(len(each))
        if goes_on or last:
            assert len({x[:3] for x in each} | ({last} if last else set())) <= 1
        last = each[0][:3] if goes_on and each else last if goes_on else None
    assert got == want
    assert max(sizes) <= max(most, 1200)
    counts = Counter()
    for c in pairing.bucket_counts(pairing.anchor_sets(q, t, 512, most)):
        for x in zip(*(c[k].tolist() for k in ("q", "t", "bucket", "n"))):
            assert x[:3] not in counts
            counts[x[:3]] = x[3]
    assert counts == Counter(x[:3] for x in want)
    linked = lambda dq, dt: (dq > 0) & (dt > 0) & (dq < 60) & (dt < 400)
    usable = lambda k, q0, q1, t0, t1: (k >= 3) & (q1 - q0 > 5)
    all_chains = [Counter() for _ in range(2)]
    for out, limit in zip(all_chains, (most, 10**7)):
        for c in pairing.chains(pairing.anchor_sets(q, t, 512, limit), linked, usable):
            out.update(zip(*(c[k].tolist() for k in ("q", "t", "bucket", "q_pos", "t_trans", "t_pos", "chain_no", "prev_q", "prev_t"))))
    assert all_chains[0].keys() and len(all_chains[0]) == len(all_chains[1])
    # Of a chain's first anchor nothing is told of what is before it.
    assert {x[:7] for x in all_chains[0]} == {x[:7] for x in all_chains[1]}


def test_six_frames_are_looked_up_in_one_pass(spark):
    from strandlake.functions.dna import STANDARD_CODE
    from strandlake.operators.sequence import six_frame_translation

    code = {c: aa for aa, cs in STANDARD_CODE.items() for c in cs.split()}
    rng = random.Random(4)
    texts = {"a": "".join(rng.choice("ACGTacgtuUNRx") for _ in range(1000)), "b": "ACGT", "c": "AC", "d": "", "e": dna(rng, 64)}
    df = spark.createDataFrame(list(texts.items()), "chrom string, seq string")
    made = six_frame_translation(df, piece=20)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan
    got = {(r.chrom, r.frame, r.piece): r.aa for r in made.collect()}
    want = {}
    for name, s in texts.items():
        s = "".join(x if x in "ACGT" else "N" for x in s.upper().replace("U", "T"))
        for f in range(3):
            codons = [s[i : i + 3] for i in range(f, len(s) - 2, 3)]
            for up, each in ((0, codons), (3, [c[::-1].translate(str.maketrans("ACGT", "TGCA")) for c in codons])):
                aa = "".join(code.get(c, "X") for c in each)
                want |= {(name, f + up, i // 20): aa[i : i + 20] for i in range(0, len(aa), 20)}
    assert got == want


def test_mixed_inputs_are_compressed(spark):
    from pathlib import Path

    import __spark_entry__ as entry
    from strandlake.plans import files
    from strandlake.plans.fixtures import Fixtures

    fx = Fixtures(spark, "/root/testdata/sf0.001")
    folder = Path(files._mixed(fx))
    names = [p.name for p in folder.rglob("part-*")]
    assert names and all(n.endswith(".gz") for n in names)
    kinds = {(r.folder, r.kind) for r in entry.queries()["detect_input_kinds"](spark, fx.sf_dir).collect()}
    assert kinds == {("reference.fasta", "fasta"), ("notes.txt", "unknown"), ("annotation.gff3", "gff3"), ("embedded.gff3", "gff3"),
                     ("calls.vcf", "vcf"), ("records.gb", "flatfile")}


def test_tasks_that_sort_lines_into_files_grow_with_the_rows(spark, monkeypatch):
    from pathlib import Path

    from strandlake.plans import files
    from strandlake.plans.fixtures import Fixtures

    fx = Fixtures(spark, "/root/testdata/sf0.001")
    monkeypatch.setattr(files, "DOCS_A_TASK", 5)
    df = spark.range(200).selectExpr("id div 5 as slice", "cast(id as string) as value")
    made = [p for p in Path(files.write_text(fx, "grown", {"a": df})).rglob("part-*")]
    assert len({p.name.split("-")[1] for p in made}) > spark.sparkContext.defaultParallelism


def test_blocks_of_the_search_index_are_written_a_few_at_a_time(spark, monkeypatch):
    import pyarrow.parquet as pq

    from strandlake.llm import bit_sliced_search as S

    monkeypatch.setattr(S, "BLOCK_DOCS", 2)
    docs = spark.range(0, 90, 1, 1).selectExpr("id as doc_id", "concat('word', id, ' and more') as text")
    files = [pq.ParquetFile(f.removeprefix("file:")) for f in S.build_index(docs).inputFiles()]
    groups = [f.metadata.row_group(i).num_rows for f in files for i in range(f.metadata.num_row_groups)]
    assert sum(groups) >= 45 and max(groups) <= S.GROUP_BLOCKS


def test_gaps_are_aligned_in_narrow_bands_with_proof(monkeypatch):
    from strandlake.operators import align as al

    rng = random.Random(8)
    pairs = []
    for _ in range(300):
        x = dna(rng, rng.randint(0, 60)) + dna(rng, rng.randint(1, 4)) * rng.randint(1, 9) + dna(rng, rng.randint(1, 200))
        y = list(x)
        for _ in range(rng.choice([1, 2, 5, 12, 40])):
            i = rng.randrange(len(y) + 1)
            y[i : i + rng.choice([0, 1, 6])] = dna(rng, rng.choice([0, 1, 7]))
        pairs.append((x, "".join(y)) if rng.random() < 0.5 else ("".join(y), x))
    rows = []
    whole = al._Batch.next_row
    monkeypatch.setattr(al._Batch, "next_row", lambda self, i, *x: rows.append(x[0].size) or whole(self, i, *x))
    for wide in (False, True):
        rows.clear()
        got = al.align_many(*map(list, zip(*pairs)), wide)
        cells = sum(rows)
        rows.clear()
        monkeypatch.setattr(al, "NARROW", ())
        monkeypatch.setattr(al, "_common_ends", lambda q, t: (0, 0))
        assert al.align_many(*map(list, zip(*pairs)), wide) == got
        assert cells * 3 < sum(rows) * 2
        monkeypatch.undo()
        monkeypatch.setattr(al._Batch, "next_row", lambda self, i, *x: rows.append(x[0].size) or whole(self, i, *x))


def test_mates_and_depth_move_rows_once(spark):
    from strandlake.operators import interval, reads as rd

    rng = random.Random(6)
    table = []
    for i in range(400):
        s, m = rng.choice([0, 5, 9, 20]), rng.choice([0, 5, 9, 20])
        table.append((i, rng.choice("xy"), rng.choice(["p", "q", "", None]), s, s + rng.choice([3, 4]), m, m + rng.choice([-1, 3, 4])))
    df = spark.createDataFrame(table, "id int, chrom string, name string, start_bp int, end_bp int, mate_start int, mate_end int")
    made = rd.mate_lookup(df, "id")
    got = {r.id: r.mate_id for r in made.collect()}
    want = {}
    for i, c, n, s, e, m, f in table:
        if f <= m:
            continue
        ids = [j for j, d, o, a, b, x, y in table if (d, o, a, b, x, y) == (c, n, m, f, s, e)] if n is not None else []
        want[i] = max(ids) if ids and max(ids) != i else None
    assert got == want
    final = lambda df: df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert final(made).count("Exchange hashpartitioning") == 1
    runs = interval.covered_runs(df, keys=["chrom"])
    runs.collect()
    assert "ReusedExchange" in final(runs)
