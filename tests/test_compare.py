"""Comparison operators against the plain statement in brute.py."""

import random

import numpy as np

import pytest
from pyspark.sql import functions as F

import brute
from strandlake.operators import compare as cp
from strandlake.operators import align as al
from strandlake.operators.align import align, align_many, band_for, run_texts, select_monotonic
from strandlake.operators.sequence import minimizers


def dna(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


def mutate(rng, s, rate, indel=0.004):
    out = []
    for b in s:
        r = rng.random()
        if r < rate:
            out.append(rng.choice([x for x in "ACGT" if x != b]))
        elif r < rate + indel:
            if rng.random() < 0.5:
                out.append(b + dna(rng, rng.randint(1, 12)))
        else:
            out.append(b)
    return "".join(out)


def expand(text):
    import re

    return "".join(op * int(n) for n, op in re.findall(r"(\d+)([MXID])", text))


@pytest.fixture(scope="module")
def genomes():
    rng = random.Random(5)
    core, unit = dna(rng, 2500), dna(rng, 30)
    a1 = core + dna(rng, 300) + unit * 14 + dna(rng, 200) + "N" * 40 + dna(rng, 600)
    micro = dna(rng, 400) + "ACGTTGCAAC" * 30 + dna(rng, 400)
    a2 = micro + dna(rng, 700)
    b1 = mutate(rng, core[:1200], 0.02) + dna(rng, 90) + mutate(rng, core[1200:], 0.03) + unit * 9 + dna(rng, 100)
    # A shift inside a repeat gives overlapping anchors on changing diagonals.
    b2 = micro[:520] + micro[550:] + brute.rc(mutate(rng, a1[200:1800], 0.01)) + dna(rng, 100)
    b3 = micro[:600] + dna(rng, 80) + micro[600:]
    return {("a", "c1"): a1, ("a", "c2"): a2, ("b", "d1"): b1, ("b", "d2"): b2, ("b", "d3"): b3, ("b", "tiny"): "ACGT"}


@pytest.fixture(scope="module")
def contigs(spark, genomes):
    return spark.createDataFrame([(g, c, s) for (g, c), s in genomes.items()], "genome string, chrom string, seq string")


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame([("a", "b")], "q_genome string, t_genome string")


@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("step", [64, 1 << 16])
def test_minimizers(contigs, genomes, reverse, step):
    got = minimizers(contigs, reverse=reverse, step=step, keys=("genome", "chrom")).collect()
    assert len(got) == len({(r.genome, r.chrom, r.pos) for r in got})
    want = {(g, c, p, k) for (g, c), s in genomes.items() for p, k in brute.minimizers(s, reverse)}
    assert {(r.genome, r.chrom, r.pos, r.key) for r in got} == want


def test_compare_genomes_equals_brute_force(contigs, pairs, genomes):
    blocks, ops = cp.compare_genomes(contigs, pairs)
    got = sorted((r.q_chrom, r.t_chrom, r.q_start, r.q_end, r.t_start, r.t_end, r.ident_x100, r.same_strand)
                 for r in blocks.collect())
    want, texts = [], {}
    for (g, c), q in genomes.items():
        for (h, d), t in genomes.items():
            if (g, h) == ("a", "b"):
                for q0, q1, t0, t1, pid, same, text in brute.blocks(q, t):
                    want.append((c, d, q0, q1, t0, t1, pid, same))
                    texts[(c, d, q0, t0, same)] = text
    assert got == sorted(want)
    assert any(w[7] for w in want) and any(not w[7] for w in want)
    rows = cp.numbered_runs(ops).join(blocks.select(*cp.MERGED, "q_start", "t_start"), cp.MERGED).orderBy("run_no").collect()
    seen = {}
    for r in rows:
        key = (r.q_chrom, r.t_chrom, r.q_start, r.t_start, r.same_strand)
        seen[key] = seen.get(key, "") + r.op * r.len
    assert seen == {k: v for k, v in texts.items() if v is not None}


def test_identical_genomes_are_100_percent(spark):
    s = dna(random.Random(1), 3000)
    c = spark.createDataFrame([("a", "x", s), ("b", "y", s)], "genome string, chrom string, seq string")
    p = spark.createDataFrame([("a", "b")], "q_genome string, t_genome string")
    blocks, _ = cp.compare_genomes(c, p)
    best = blocks.orderBy(F.desc("q_end")).first()
    assert best.ident_x100 == 10000 and best.same_strand and best.q_end - best.q_start > 2900


def test_split_and_merge_on_random_anchors(spark):
    """Anchor lists dense in tiny atoms and near-threshold gaps, so the folds matter."""
    rng = random.Random(9)
    rows, want_parts, want_merged = [], {}, {}
    for case in range(60):
        q = t = rng.randint(0, 400)
        t += rng.randint(-200, 200) + 600
        anchors = []
        for _ in range(rng.randint(3, 60)):
            anchors.append((q, t, t))
            kind = rng.random()
            dq = rng.choice([3, 6, 11, 15, 16, 40, 90])
            shift = rng.choice([65, 70, 90]) if kind < 0.35 else rng.choice([0, 0, 0, 1, 5])
            if kind > 0.97:
                dq += 8300
            q, t = q + dq, t + dq + (shift if rng.random() < 0.5 else min(0, -shift + dq - 1) + (0 if shift < dq else 0))
            t = max(t, anchors[-1][1] + 1)
        name = f"c{case}"
        rows += [("a", "b", name, "t", True, *a) for a in anchors]
        parts = [p for c in brute.chains(anchors) for p in brute.split(c)]
        want_parts[name] = sorted((p[0][0], p[-1][0], len(p)) for p in parts)
        want_merged[name] = sorted((brute.summary(c)["q0"], brute.summary(c)["q1"], brute.summary(c)["pid"], len(c))
                                   for c in brute.merge(parts)) if parts else []
    df = spark.createDataFrame(
        rows, "q_genome string, t_genome string, q_chrom string, t_chrom string, same_strand boolean, q_pos int, t_pos int, t_trans int")
    parted = cp.split_chains(cp.chain_anchors(cp.bucket_anchors(df)))
    parts = cp.chain_summary(parted, cp.PART)
    got = {}
    for r in parts.collect():
        got.setdefault(r.q_chrom, []).append((r.q_start, r.q_end - 15, r.n_anchors))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want_parts.items() if v}
    merged = cp.merged_summary(cp.merged_anchors(parted, cp.merge_chains(parts)))
    got = {}
    for r in merged.collect():
        got.setdefault(r.q_chrom, []).append((r.q_start, r.q_end, r.ident_x100, r.n_anchors))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want_merged.items() if v}


def test_merge_stops_at_drift(spark):
    """Parts that each step the diagonal a little merge only until the first one's limit."""
    rows, parts, q, t = [], [], 0, 0
    for i in range(130):
        part = [(q + j, t + j, t + j) for j in range(0, 100, 10)]
        parts.append(part)
        rows += [("a", "b", "x", "y", True, *a) for a in part]
        q, t = q + 90 + 15 + 20, t + 90 + 15 + 84
    df = spark.createDataFrame(
        rows, "q_genome string, t_genome string, q_chrom string, t_chrom string, same_strand boolean, q_pos int, t_pos int, t_trans int")
    parted = cp.split_chains(cp.chain_anchors(cp.bucket_anchors(df)))
    m = cp.merge_chains(cp.chain_summary(parted, cp.PART))
    got = sorted((r.q0, r.q1) for r in m.groupBy(*cp.MERGED).agg(F.min("q_start").alias("q0"), F.max("q_end").alias("q1")).collect())
    anchors = [a for p in parts for a in p]
    want = sorted((brute.summary(c)["q0"], brute.summary(c)["q1"])
                  for c in brute.merge([p for c in brute.chains(anchors) for p in brute.split(c)]))
    assert got == want and len(want) > 1


def test_align_is_optimal_and_keeps_tie_rules():
    rng = random.Random(3)
    for _ in range(150):
        a = dna(rng, rng.randint(0, 40))
        b = mutate(rng, a, 0.15, 0.1) if rng.random() < 0.7 else dna(rng, rng.randint(0, 40))
        wide = rng.random() < 0.5
        assert expand(align(a, b, wide)) == brute.align(a, b, band_for(len(a), len(b), wide))
    a = dna(rng, 300)
    b = mutate(rng, a, 0.1, 0.05)
    got = expand(align(a, b))
    assert brute.score(got) == brute.score(brute.align(a, b, band_for(len(a), len(b), False)))
    assert run_texts(np.array([0, 0, 1, 2, 2, 3, 3]), np.array([6, 0, 1])) == ["2M1X2I1D", "", "1D"]


def test_batches_of_gaps_equal_single_ones(monkeypatch):
    rng = random.Random(4)
    pairs = []
    for _ in range(120):
        a = dna(rng, rng.choice([0, 1, 3, 20, 24, 150]))
        pairs.append((a, rng.choice([a, mutate(rng, a, 0.2, 0.1), dna(rng, rng.choice([0, 1, 20, 160, 320]))])))
    want = [brute.align(a, b, band_for(len(a), len(b), False)) for a, b in pairs]
    # Rows kept now and then, traces between them made again.
    for cells in (al.CELLS, 600):
        monkeypatch.setattr(al, "CELLS", cells)
        got = align_many(*zip(*pairs))
        assert [g if g is None else expand(g) for g in got] == want


def test_select_monotonic():
    rng = random.Random(4)
    for _ in range(60):
        ps = []
        for _ in range(rng.randint(1, 8)):
            q, t, n = rng.randint(0, 60), rng.randint(0, 60), rng.randint(1, 25)
            ps.append((q, q + n, t, t + rng.randint(1, 25)))
        ps = sorted(ps)
        pick = select_monotonic(*zip(*ps))
        chosen = [ps[i] for i in pick]
        assert all(x[1] <= y[0] and x[3] <= y[2] for x, y in zip(chosen, chosen[1:]))
        weight = lambda c: sum(max(p[1] - p[0], p[3] - p[2]) for p in c)
        assert weight(chosen) == weight(brute.monotonic(ps))


def test_block_detail_small_and_large(spark):
    rng = random.Random(8)
    q = dna(rng, 9500)
    t = mutate(rng, q, 0.01, 0.002)
    small_q, small_t = q[:400], brute.rc(mutate(rng, q[:400], 0.03, 0.01))
    c = spark.createDataFrame([("a", "x", q), ("b", "y", t), ("a", "s", small_q), ("b", "r", small_t)],
                              "genome string, chrom string, seq string")
    b = spark.createDataFrame(
        [("big", "a", "b", "x", "y", True, 0, len(q), 0, len(t), 9000),
         ("small", "a", "b", "s", "r", False, 0, 400, 0, len(small_t), 9000),
         ("tiny", "a", "b", "s", "r", True, 0, 5, 390, 395, 9000), ("none", "a", "b", "s", "r", True, 7, 7, 0, 0, 9000),
         ("lost", "a", "b", "s", "zz", True, 0, 50, 0, 50, 9000)],
        "block_id string, q_genome string, t_genome string, q_chrom string, t_chrom string, same_strand boolean, "
        "q_start int, q_end int, t_start int, t_end int, ident_x100 int")
    details, ops = cp.block_detail(b, c)
    d = {r.block_id: r for r in details.collect()}
    assert len(d) == 5 and d["small"].status == d["big"].status == "refined"
    assert d["none"].status == "empty span" and d["lost"].status == "unknown contig"
    assert all((d[k].ident_x100 is None) == (d[k].status != "refined") for k in d)
    text = {}
    for r in ops.orderBy("block_id", "run_no").collect():
        text[r.block_id] = text.get(r.block_id, "") + r.op * r.len
    oriented = brute.rc(small_t)
    assert text["small"] == brute.align(small_q, oriented, abs(400 - len(small_t)) + 96)
    assert d["small"].ident_x100 == brute.ident(text["small"])
    # The stitched text must consume both sides exactly and agree base by base.
    i = j = 0
    for op in text["big"]:
        if op in "MX":
            assert (q[i] == t[j]) == (op == "M")
            i, j = i + 1, j + 1
        elif op == "I":
            i += 1
        else:
            j += 1
    assert (i, j) == (len(q), len(t)) and d["big"].ident_x100 == brute.ident(text["big"]) > 9700


def test_frequent_seeds_are_kept_or_thinned(spark, monkeypatch):
    monkeypatch.setattr(cp, "HOT_SEEDS", 3)
    rng = random.Random(2)
    unit = dna(rng, 40)
    rep = "".join(unit + dna(rng, 20) for _ in range(90))
    c = spark.createDataFrame([("a", "x", (unit + dna(rng, 30)) * 9), ("b", "y", rep)], "genome string, chrom string, seq string")
    fwd = minimizers(c, keys=("genome", "chrom"))
    p = spark.createDataFrame([("a", "b")], "q_genome string, t_genome string")
    for most in (None, 64):
        got = sorted((r.q_pos, r.t_pos, r.t_trans) for r in cp.seed_join(fwd, fwd, None, p, max_hits=most).collect())
        want = sorted(brute.anchors(c.collect()[0].seq, rep, True, most))
        assert got == want and len(got) >= 64
