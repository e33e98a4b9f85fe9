"""Genome comparison.

Canonical coordinates are contig-local and forward. ``t_trans`` is the target position
seen along the matching strand, so both axes grow along a chain. Every step is a table;
Python sees only short folds between points where their state is known, and single gaps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strandlake.functions.coords import div
from strandlake.functions.dna import revcomp
from strandlake.operators.interval import overlap_join, to_contig_coords
from strandlake.operators.prefix import STEP, prefix_sums, previous_row, rank_in_order
from strandlake.operators.sequence import K, WINDOW, minimizer_lists, minimizers, reference_slices, salted_join, small
from strandlake.session import materialize

# Thresholds of chains, blocks and merges.
MIN_ANCHORS = 3
MIN_BLOCK = 100
MIN_IDENTITY = 5000
MAX_ANCHOR_GAP = 20000
MAX_DRIFT = 6000
DIAGONAL_BIN = 512
MERGE_GAP = 256
MERGE_OVERLAP = 32
MERGE_INDEL = 64
STRICT_SPAN = 8192
HOT_SEEDS = 20000
#: Seeds of a genome that is paired where its contigs lie together, and of its query contigs that one task has.
FOLD_SEEDS, SLOT_SEEDS = 1 << 21, 1 << 18

PAIR = ["q_genome", "t_genome", "q_chrom", "t_chrom", "same_strand"]
CHAIN = [*PAIR, "bucket", "chain_no"]
PART = [*CHAIN, "part"]
MERGED = [*PAIR, "island", "seg"]


# --- seeds and chains ---------------------------------------------------------------


def thin_seeds(seeds: DataFrame, *, max_hits: int | None = None) -> DataFrame:
    """Target seeds, or with ``max_hits`` at most so many positions per (contig, key): evenly spaced ranks.

    Counting decides which keys are frequent; only their rows are ranked, in two levels.
    """
    if max_hits is None:
        return seeds
    key = ["genome", "chrom", "key"]
    frequent = seeds.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > max_hits)
    few = seeds.join(frequent, key, "left_anti")
    many = rank_in_order(seeds.join(frequent, key), key, "pos", "r")
    r, last = F.col("r") - 1, F.col("n") - 1
    i = div(r * (max_hits - 1) + last - 1, last)
    return few.unionByName(many.where(div(i * last, max_hits - 1) == r).drop("n", "r"))


def seed_join(query: DataFrame, target_forward: DataFrame, target_reverse: DataFrame | None, pairs: DataFrame, *,
              k: int = K, max_hits: int | None = None) -> DataFrame:
    """H1: anchors of the paired genomes: (PAIR, q_pos, t_pos, t_trans), of all target positions or ``max_hits`` a contig and key.

    Inputs are minimizer tables (D8) with genome and chrom; ``pairs`` has q_genome, t_genome.
    """
    q = query.select(F.col("genome").alias("q_genome"), F.col("chrom").alias("q_chrom"), F.col("pos").alias("q_pos"), "key")
    asked = q.join(pairs.select("q_genome", "t_genome").distinct(), "q_genome")
    sides = [(target_forward, True)] + ([(target_reverse, False)] if target_reverse is not None else [])
    targets = None
    for table, same in sides:
        trans = F.col("pos") if same else F.col("length") - (F.col("pos") + k)
        t = thin_seeds(table, max_hits=max_hits).select(
            F.col("genome").alias("t_genome"), F.col("chrom").alias("t_chrom"), "key", F.lit(same).alias("same_strand"),
            F.col("pos").alias("t_pos"), trans.alias("t_trans"))
        targets = t if targets is None else targets.unionByName(t)
    # A key that a repeat puts on very many query positions is spread over salts; its targets are repeated once per salt.
    met = salted_join(asked, targets, ["t_genome", "key"], ["q_chrom", "q_pos"], pile=HOT_SEEDS)
    return met.select(*PAIR, "q_pos", "t_pos", "t_trans")


def bucket_anchors(anchors: DataFrame) -> DataFrame:
    """H2: adds the diagonal bucket."""
    return anchors.withColumn("bucket", div(F.col("t_trans") - F.col("q_pos"), DIAGONAL_BIN))


def _usable(n: Column, q: Column, t: Column) -> Column:
    return (n >= MIN_ANCHORS) & (q >= MIN_BLOCK) & (t >= MIN_BLOCK)


def _linked(dq: Column, dt: Column) -> Column:
    near = (dq > 0) & (dt > 0) & (dq <= MAX_ANCHOR_GAP) & (dt <= MAX_ANCHOR_GAP)
    return F.coalesce(near, F.lit(False))


def chain_anchors(anchors: DataFrame, *, k: int = K) -> DataFrame:
    """H3: anchors of usable chains, with chain_no and the anchor before (prev_q, prev_t; NULL first).

    Buckets of query contigs whose anchors all lie in the first step are sent once and chained where they are; those of longer
    contigs are cut into steps.
    """
    ends = anchors.where(F.col("q_pos") >= STEP).select("q_genome", "q_chrom").distinct()
    long, n = small(ends, "long_queries")
    if not n:
        return _short_chains(anchors, k)
    on = ["q_genome", "q_chrom"]
    short = _short_chains(anchors.join(long, on, "left_anti"), k)
    return short.unionByName(_long_chains(anchors.join(long, on, "left_semi"), k).select(*short.columns))


def _chain_sorted(k: int):
    """A pass over anchors in order of (bucket, q_pos, t_trans, t_pos): those of usable chains. All buckets of a batch are chained as one
    array; the last one waits for the batch that ends it."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def chained(table):
        """Rows of whole buckets."""
        n = table.num_rows
        numbers = {c: table.column(c).to_numpy().astype(np.int64) for c in ("q_pos", "t_trans", "t_pos", "bucket")}
        head = np.zeros(n, bool)
        head[1:] = numbers["bucket"][1:] != numbers["bucket"][:-1]
        for c in PAIR:
            v = table.column(c).combine_chunks()
            head[1:] |= pc.not_equal(v.slice(1), v.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        head[0] = True
        new = head.copy()
        for c in ("q_pos", "t_trans", "t_pos"):
            new[1:] |= numbers[c][1:] != numbers[c][:-1]
        kept = np.flatnonzero(new)
        head, (q, t, tp) = head[kept], (numbers[c][kept] for c in ("q_pos", "t_trans", "t_pos"))
        dq, dt = np.diff(q, prepend=0), np.diff(t, prepend=0)
        linked = ~head & (dq > 0) & (dt > 0) & (dq <= MAX_ANCHOR_GAP) & (dt <= MAX_ANCHOR_GAP)
        chain = np.cumsum(~linked) - 1
        number = chain - np.maximum.accumulate(np.where(head, chain, 0)) + 1
        starts = np.flatnonzero(~linked)
        ends = np.append(starts[1:], len(q))
        good = (ends - starts >= MIN_ANCHORS) & (q[ends - 1] - q[starts] + k >= MIN_BLOCK)
        good &= np.maximum.reduceat(tp, starts) - np.minimum.reduceat(tp, starts) + k >= MIN_BLOCK
        use = np.flatnonzero(good[chain])
        out = table.take(pa.array(kept[use]))
        for c, like, back in (("prev_q", "q_pos", (q - dq)[use]), ("prev_t", "t_trans", (t - dt)[use])):
            out = out.append_column(c, pa.array(back, mask=~linked[use]).cast(table.schema.field(like).type))
        return out.append_column("chain_no", pa.array(number[use], pa.int64()))

    def run(batches):
        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            # Rows of the last bucket: it is searched from the batch's end.
            same = np.ones(batch.num_rows, bool)
            for c in [*PAIR, "bucket"]:
                v = batch.column(c)
                same &= pc.equal(v, v[-1]).to_numpy(zero_copy_only=False)
            first = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            ends = [pa.Table.from_batches([batch.slice(0, first)])] if first else []
            if held and not first and any(held[-1].column(c)[-1] != batch.column(c)[-1] for c in [*PAIR, "bucket"]):
                ends = [pa.Table.from_batches([batch.slice(0, 0)])]
            if ends:
                yield from chained(pa.concat_tables([*held, *ends])).to_batches()
                held = []
            held.append(pa.Table.from_batches([batch.slice(first)]))
        if held:
            yield from chained(pa.concat_tables(held)).to_batches()

    return run


def _short_chains(anchors: DataFrame, k: int) -> DataFrame:
    """Chains of buckets of short contigs: one shuffle, a sort by the bucket's hash first, and arrays."""
    key = [*PAIR, "bucket"]
    tasks = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    types = {f.name: f.dataType.simpleString() for f in anchors.schema.fields}
    schema = ", ".join(f"{c} {t}" for c, t in (types | {"prev_q": types["q_pos"], "prev_t": types["t_trans"], "chain_no": "bigint"}).items())
    spread = anchors.repartition(tasks, *key).withColumn("__h", F.xxhash64(*key))
    return spread.sortWithinPartitions("__h", *key, "q_pos", "t_trans", "t_pos").drop("__h").mapInArrow(_chain_sorted(k), schema)


def _long_chains(anchors: DataFrame, k: int) -> DataFrame:
    """Chains by two-level windows."""
    a = materialize(anchors.dropDuplicates([*PAIR, "q_pos", "t_pos", "t_trans"]), "long_anchors")
    key = [*PAIR, "bucket"]
    back = previous_row(a, key, "q_pos", {"prev_q": F.col("q_pos"), "prev_t": F.col("t_trans")}, ties=["t_trans", "t_pos"])
    linked = _linked(F.col("q_pos") - F.col("prev_q"), F.col("t_trans") - F.col("prev_t"))
    back = back.withColumns({c: F.when(linked, F.col(c)) for c in ("prev_q", "prev_t")})
    back = materialize(back, "linked")
    numbered = prefix_sums(back, key, "q_pos", {"chain_no": F.col("prev_q").isNull().cast("bigint")}, ties=["t_trans", "t_pos"])
    numbered = materialize(numbered, "chained")
    span = lambda c: F.max(c) - F.min(c) + k
    good = numbered.groupBy(*CHAIN).agg(F.count("*").alias("n"), span("q_pos").alias("qs"), span("t_pos").alias("ts")).where(
        _usable(F.col("n"), F.col("qs"), F.col("ts"))).select(*CHAIN)
    return numbered.join(good, CHAIN, "left_semi")


def _each_group(fold, keys: list[str]):
    """A pass over rows sorted by ``keys``: ``fold`` of a group's other columns as arrays gives columns again. Groups are slices of a
    batch, so that very many small ones cost no frame each; one that goes over batches is put together first."""
    import numpy as np
    import pandas as pd

    def out_of(frame, starts):
        groups = {c: frame[c].to_numpy() for c in frame.columns}
        found = []
        for lo, hi in zip(starts, [*starts[1:], len(frame)]):
            found.append(fold({c: v[lo:hi] for c, v in groups.items() if c not in keys}))
        sizes = [len(next(iter(f.values()))) for f in found]
        names = {c: np.repeat(groups[c][starts], sizes) for c in keys}
        return pd.DataFrame(names | {c: np.concatenate([f[c] for f in found]) for c in found[0]})

    def run(batches):
        held, last = [], None
        for pdf in batches:
            if not len(pdf):
                continue
            new = np.ones(len(pdf), bool)
            new[1:] = False
            for c in keys:
                v = pdf[c].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            starts = np.flatnonzero(new)
            head = tuple(pdf[c].iloc[0] for c in keys)
            if held and head != last:
                yield out_of(pd.concat(held, ignore_index=True), [0])
                held = []
            if len(starts) > 1:
                if held:
                    yield out_of(pd.concat([*held, pdf.iloc[:starts[1]]], ignore_index=True), [0])
                    starts = starts[1:]
                if len(starts) > 1:
                    yield out_of(pdf.iloc[starts[0]:starts[-1]], (starts[:-1] - starts[0]).tolist())
                held = [pdf.iloc[starts[-1]:]]
            else:
                held.append(pdf)
            last = tuple(pdf[c].iloc[-1] for c in keys)
        if held:
            yield out_of(pd.concat(held, ignore_index=True), [0])

    return run


def _fold_groups(df: DataFrame, keys: list[str], order: list[str], fold, schema: str) -> DataFrame:
    """``fold`` of every group of ``keys`` in ``order``; the rows are spread by their group and sorted by Spark."""
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys).sortWithinPartitions(*keys, *order).mapInPandas(_each_group(fold, keys), schema)


def _close_parts(g: dict, k: int = K) -> dict:
    """Fold of one stretch without a usable atom before its last: cut as soon as a part is usable."""
    sub, n, q0, q1, t0, t1, out = 0, 0, None, None, None, None, []
    for an, aq0, aq1, at0, at1 in zip(*(g[c].tolist() for c in ("n", "q0", "q1", "t0", "t1"))):
        if n and _closed(n, q0, q1, t0, t1, k):
            sub, n = sub + 1, 0
        if n == 0:
            q0, q1, t0, t1 = aq0, aq1, at0, at1
        n += an
        q0, q1, t0, t1 = min(q0, aq0), max(q1, aq1), min(t0, at0), max(t1, at1)
        out.append(sub)
    return {"atom": g["atom"], "sub": out}


def _closed(n, q0, q1, t0, t1, k) -> bool:
    return n >= MIN_ANCHORS and q1 - q0 + k >= MIN_BLOCK and t1 - t0 + k >= MIN_BLOCK


def _split_chain(g: dict, k: int = K) -> dict:
    """Fold of one short chain: its usable parts."""
    import numpy as np

    q, t, tp = (g[c].astype(np.int64) for c in ("q_pos", "t_trans", "t_pos"))
    cut = np.zeros(len(q), bool)
    gq, gt = np.diff(q) - k, np.diff(t) - k
    cut[1:] = (np.maximum(gq, gt) > STRICT_SPAN) | (np.abs(gq - gt) > MERGE_INDEL)
    starts = np.flatnonzero(np.concatenate([[True], cut[1:]]))
    n = np.diff(starts, append=len(q))
    low, high = np.minimum.reduceat, np.maximum.reduceat
    atoms = {"n": n, "q0": low(q, starts), "q1": high(q, starts), "t0": low(tp, starts), "t1": high(tp, starts)}
    own = (n >= MIN_ANCHORS) & (atoms["q1"] - atoms["q0"] + k >= MIN_BLOCK) & (atoms["t1"] - atoms["t0"] + k >= MIN_BLOCK)
    stretch = np.cumsum(own) - own
    first = np.flatnonzero(np.diff(stretch, prepend=-1))
    part = stretch << 32
    for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(n)]):
        if hi - lo > 1:
            each = {c: v[lo:hi] for c, v in atoms.items()}
            part[lo:hi] += _close_parts(each | {"atom": np.arange(lo, hi)}, k)["sub"]
    heads = np.flatnonzero(np.diff(part, prepend=-1))
    good = np.add.reduceat(n, heads) >= MIN_ANCHORS
    for lo, hi in (("q0", "q1"), ("t0", "t1")):
        good &= high(atoms[hi], heads) - low(atoms[lo], heads) + k >= MIN_BLOCK
    keep = np.repeat(np.repeat(good, np.diff(heads, append=len(n))), n)
    return {c: v[keep] for c, v in g.items()} | {"part": np.repeat(part, n)[keep]}


def _short_and_long(df: DataFrame, keys: list[str], axis: str, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Groups whose places all lie in the first step, and the others (None without any)."""
    long, n = small(df.where(F.col(axis) >= STEP).select(*keys).distinct(), name)
    return (df.join(long, keys, "left_anti"), df.join(long, keys, "left_semi")) if n else (df, None)


def split_chains(chained: DataFrame, *, k: int = K) -> DataFrame:
    """H4: adds ``part``: a chain is cut at a wide or shifted gap once what came before is usable.

    Chains that lie in the first step of their contig are folded after one shuffle; longer ones are cut into atoms first.
    """
    short, long = _short_and_long(chained, CHAIN, "q_pos", "long_chains")
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chained.schema.fields)
    parted = _fold_groups(short, CHAIN, ["q_pos"], lambda g: _split_chain(g, k), types + ", part bigint")
    return parted if long is None else parted.unionByName(_split_long_chains(long, k))


def _split_long_chains(chained: DataFrame, k: int) -> DataFrame:
    """Anchors between two possible cuts form an atom. After an atom that is usable by itself
    a cut always happens, so the fold restarts there: single-atom stretches, the bulk, need
    no Python, and the others are short runs of tiny atoms.
    """
    gq, gt = F.col("q_pos") - F.col("prev_q") - k, F.col("t_trans") - F.col("prev_t") - k
    may_cut = F.coalesce((F.greatest(gq, gt) > STRICT_SPAN) | (F.abs(gq - gt) > MERGE_INDEL), F.lit(False))
    a = materialize(prefix_sums(chained, CHAIN, "q_pos", {"atom": may_cut.cast("bigint")}), "atoms")
    atoms = a.groupBy(*CHAIN, "atom").agg(
        F.count("*").alias("n"), F.min("q_pos").alias("q0"), F.max("q_pos").alias("q1"), F.min("t_pos").alias("t0"),
        F.max("t_pos").alias("t1"))
    own = _usable(F.col("n"), F.col("q1") - F.col("q0") + k, F.col("t1") - F.col("t0") + k).cast("bigint")
    atoms = prefix_sums(atoms.withColumn("own", own), CHAIN, "atom", {"stretch": F.col("own")}).withColumn(
        "stretch", F.col("stretch") - F.col("own"))
    sizes = atoms.groupBy(*CHAIN, "stretch").agg(F.count("*").alias("size"))
    sized = materialize(atoms.join(sizes, [*CHAIN, "stretch"]), "stretches")
    single = sized.where("size = 1").select(*CHAIN, "atom", (F.col("stretch") * (1 << 32)).alias("part"))
    types = {f.name: f.dataType.simpleString() for f in single.schema.fields}
    stretch = [*CHAIN, "stretch"]
    folded = _fold_groups(sized.where("size > 1").select(*stretch, "atom", "n", "q0", "q1", "t0", "t1"), stretch, ["atom"],
                          lambda g: _close_parts(g, k), ", ".join(f"{c} {types[c]}" for c in [*CHAIN, "atom"]) + ", stretch bigint, sub bigint")
    folded = folded.select(*CHAIN, "atom", (F.col("stretch") * (1 << 32) + F.col("sub")).alias("part"))
    parted = a.join(single.unionByName(folded), [*CHAIN, "atom"]).drop("atom")
    span = lambda c: F.max(c) - F.min(c) + k
    good = parted.groupBy(*PART).agg(F.count("*").alias("n"), span("q_pos").alias("qs"), span("t_pos").alias("ts")).where(
        _usable(F.col("n"), F.col("qs"), F.col("ts"))).select(*PART)
    return parted.join(good, PART, "left_semi")


def chain_summary(anchors: DataFrame, keys: Sequence[str], *, k: int = K) -> DataFrame:
    """H5: union span on both sides, covered query bases and the identity estimate per chain."""
    step = F.least(F.lit(k), F.coalesce(F.col("q_pos") - F.col("prev_q"), F.lit(k)))
    s = anchors.groupBy(*keys).agg(
        F.count("*").alias("n_anchors"), F.min("q_pos").alias("q_start"), (F.max("q_pos") + k).alias("q_end"),
        F.min("t_pos").alias("t_start"), (F.max("t_pos") + k).alias("t_end"), F.min("t_trans").alias("o_start"),
        (F.max("t_trans") + k).alias("o_end"), F.sum(step).alias("__s"),
        F.min(F.struct("q_pos", step.alias("step"))).alias("__f"))
    # The first anchor of a part covers k bases whatever lies before the cut.
    s = s.withColumn("covered", F.col("__s") - F.col("__f.step") + k).drop("__s", "__f")
    return s.withColumn("ident_x100", _estimate())


def _estimate() -> Column:
    span = F.greatest(F.col("q_end") - F.col("q_start"), F.col("t_end") - F.col("t_start"))
    return F.least(F.round(F.lit(10000.0) * F.col("covered") / span).cast("int"), F.lit(10000))


def _cut_drift(g: dict) -> dict:
    seg, first, out = 0, None, []
    for d in g["diag"].tolist():
        if first is None:
            first = d
        elif abs(d - first) > MAX_DRIFT:
            seg, first = seg + 1, d
        out.append(seg)
    return {"rank": g["rank"], "seg": out}


def merge_chains(parts: DataFrame) -> DataFrame:
    """H6: part summaries (H5) with island, seg (one merged chain), rank and the end of the merged part before.

    A merged chain's ends are those of its last part, so joining depends on neighbours only:
    islands of a lag. The one remembered value, the diagonal of the first part, can stop a
    merge only in islands that drift beyond the limit; those alone are folded.
    """
    order = ["q_end", "o_start", "o_end", "bucket", "chain_no", "part"]
    diag = F.col("o_start") - F.col("q_start")
    carry = {f"p_{c}": F.col(c) for c in ("q_end", "o_end", "q_start", "o_start")}
    b = previous_row(parts, PAIR, "q_start", carry, ties=order)
    gq, gt = F.col("q_start") - F.col("p_q_end"), F.col("o_start") - F.col("p_o_end")
    joins = (gq >= -MERGE_OVERLAP) & (gt >= -MERGE_OVERLAP) & (F.greatest(gq, gt) <= MERGE_GAP) & (
        F.abs(gq - gt) <= MERGE_INDEL)
    b = b.withColumn("joins", F.coalesce(joins, F.lit(False)))
    b = prefix_sums(b, PAIR, "q_start", {"island": (~F.col("joins")).cast("bigint"), "rank": F.lit(1).cast("bigint")}, ties=order)
    b = materialize(b.withColumn("diag", diag), "islands")
    isl = [*PAIR, "island"]
    firsts = b.groupBy(*isl).agg(F.min(F.struct("rank", "diag")).alias("f"), F.min("diag").alias("lo"), F.max("diag").alias("hi"))
    wild = firsts.where(F.greatest(F.col("hi") - F.col("f.diag"), F.col("f.diag") - F.col("lo")) > MAX_DRIFT).select(*isl)
    calm = b.join(wild, isl, "left_anti").withColumn("seg", F.lit(0).cast("bigint"))
    types = {f.name: f.dataType.simpleString() for f in calm.schema.fields}
    folded = _fold_groups(b.join(wild, isl, "left_semi").select(*isl, "rank", "diag"), isl, ["rank"], _cut_drift,
                          ", ".join(f"{c} {types[c]}" for c in [*isl, "rank", "seg"]))
    out = calm.unionByName(b.join(folded.select(*PAIR, "island", "rank", "seg"), [*PAIR, "island", "rank"]).select(*calm.columns))
    # The first part of a merged chain has nothing before it.
    heads = out.groupBy(*MERGED).agg(F.min("rank").alias("head"))
    out = out.join(heads, MERGED)
    inside = F.col("rank") > F.col("head")
    return out.withColumns({c: F.when(inside, F.col(c)) for c in ("p_q_end", "p_o_end")}).drop(
        "joins", "diag", "head", "p_q_start", "p_o_start")


def merged_anchors(parted: DataFrame, merged: DataFrame, *, k: int = K) -> DataFrame:
    """Anchors of merged chains with their axis and the anchor before them in the chain."""
    info = merged.select(*PART, "island", "seg", "q_start", "p_q_end", "p_o_end")
    a = parted.join(info, PART)
    first = F.col("q_pos") == F.col("q_start")
    return a.withColumns({
        "prev_q": F.when(first, F.col("p_q_end") - k).otherwise(F.col("prev_q")),
        "prev_t": F.when(first, F.col("p_o_end") - k).otherwise(F.col("prev_t")),
        "axis": F.greatest(F.col("q_pos"), F.coalesce("p_q_end", F.lit(0))),
        "lim_q": F.greatest(F.when(first, F.col("p_q_end")).otherwise(F.col("prev_q") + k), F.col("p_q_end")),
        "lim_t": F.greatest(F.when(first, F.col("p_o_end")).otherwise(F.col("prev_t") + k), F.col("p_o_end")),
    }).drop("q_start", "p_q_end", "p_o_end")


def merged_summary(anchors: DataFrame, *, k: int = K) -> DataFrame:
    """H5 for merged chains: covered counts only bases beyond what earlier anchors reached."""
    new = F.greatest(F.lit(0), F.col("q_pos") + k - F.greatest("q_pos", F.coalesce("lim_q", F.lit(0))))
    s = anchors.groupBy(*MERGED).agg(
        F.count("*").alias("n_anchors"), F.min("q_pos").alias("q_start"), (F.max("q_pos") + k).alias("q_end"),
        F.min("t_pos").alias("t_start"), (F.max("t_pos") + k).alias("t_end"), F.min("t_trans").alias("o_start"),
        (F.max("t_trans") + k).alias("o_end"), F.sum(new).alias("covered"))
    return s.withColumn("ident_x100", _estimate())


# --- gaps and refinement ------------------------------------------------------------


def _walk_block(g: dict, k: int = K) -> dict:
    """Pieces of one anchor block whose diagonal shifts: matched runs and the gaps between them."""
    qs, ts, rows = g["q_pos"].tolist(), g["t_trans"].tolist(), []
    cq, ct = qs[0], ts[0]
    for q, t in zip(qs, ts):
        mq, mt = max(q, cq), max(t, ct)
        if mq > cq or mt > ct:
            rows.append(("G", 0, cq, mq, ct, mt))
        n = min(q + k - mq, t + k - mt)
        if n > 0:
            rows.append(("M", n, mq, mq + n, mt, mt + n))
            cq, ct = mq + n, mt + n
    rows.append(("E", 0, cq, cq, ct, ct))
    return {"piece": range(len(rows))} | dict(zip(("kind", "n", "g_q0", "g_q1", "g_t0", "g_t1"), map(list, zip(*rows))))


def _piece_chain(g: dict, k: int = K) -> dict:
    """Pieces of one short merged chain, with the gaps between its blocks."""
    import numpy as np

    q, t = g["q_pos"].astype(np.int64), g["t_trans"].astype(np.int64)
    behind = (q < g["lim_q"].astype(float)) | (t < g["lim_t"].astype(float))  # no limit: not behind it
    back_q, back_t = g["prev_q"].astype(float), g["prev_t"].astype(float)
    shift = behind & ~np.isnan(back_q) & ((q - back_q) != (t - back_t))
    block = np.cumsum(~behind)
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    ends = np.append(starts[1:], len(q))
    walk = np.logical_or.reduceat(shift, starts).tolist()
    q1, t1 = np.maximum.reduceat(q, starts).tolist(), np.maximum.reduceat(t, starts).tolist()
    rows, last = [], None
    for i, (lo, hi, no) in enumerate(zip(starts.tolist(), ends.tolist(), block[starts].tolist())):
        q0, t0 = int(q[lo]), int(t[lo])
        if last and (q0 > last[0] or t0 > last[1]):
            rows.append((no, -1, "G", 0, last[0], q0, last[1], t0))
        if walk[i]:
            found = _walk_block({"q_pos": q[lo:hi], "t_trans": t[lo:hi]}, k)
            rows += zip([no] * len(found["kind"]), *(found[c] for c in PIECE[1:]))
        else:
            rows.append((no, 0, "M", q1[i] + k - q0, q0, q1[i] + k, t0, t1[i] + k))
        last = rows[-1][5], rows[-1][7]
    return dict(zip(PIECE, map(list, zip(*rows))))


PIECE = ("block_no", "piece", "kind", "n", "g_q0", "g_q1", "g_t0", "g_t1")


def chain_pieces(anchors: DataFrame, *, k: int = K) -> DataFrame:
    """Matched runs (M), gaps (G) and the final point (E) of each merged chain, ordered by (block_no, piece).

    An anchor that lies beyond everything before it on both axes starts a block: what
    precedes it cannot matter. Blocks on one diagonal are one run; only the others are walked.
    Chains that lie in the first step of their contig are folded after one shuffle.
    """
    short, long = _short_and_long(anchors, MERGED, "axis", "long_merged")
    types = {f.name: f.dataType.simpleString() for f in anchors.schema.fields}
    schema = ", ".join([*(f"{c} {types[c]}" for c in MERGED), *(f"{c} {'string' if c == 'kind' else 'bigint'}" for c in PIECE)])
    rows = short.select(*MERGED, "axis", "q_pos", "t_trans", "prev_q", "prev_t", "lim_q", "lim_t")
    pieces = _fold_groups(rows, MERGED, ["axis", "q_pos"], lambda g: _piece_chain(g, k), schema)
    return pieces if long is None else pieces.unionByName(_long_chain_pieces(long, k))


def _long_chain_pieces(anchors: DataFrame, k: int) -> DataFrame:
    """Pieces by two-level windows."""
    reset = F.coalesce((F.col("q_pos") >= F.col("lim_q")) & (F.col("t_trans") >= F.col("lim_t")), F.lit(True))
    shift = ~reset & ((F.col("q_pos") - F.col("prev_q")) != (F.col("t_trans") - F.col("prev_t")))
    a = anchors.withColumns({"reset": reset, "shift": shift})
    a = materialize(prefix_sums(a, MERGED, "axis", {"block_no": F.col("reset").cast("bigint")}, ties=["q_pos"]), "blocks")
    key = [*MERGED, "block_no"]
    ends = a.groupBy(*key).agg(
        F.min(F.struct("axis", "q_pos", "t_trans")).alias("f"), F.max("q_pos").alias("q1"), F.max("t_trans").alias("t1"),
        F.max("shift").alias("walk"))
    ends = ends.select(*key, F.col("f.q_pos").alias("q0"), F.col("f.t_trans").alias("t0"), "q1", "t1", "walk")
    straight = ends.where("not walk").select(
        *key, F.lit(0).cast("bigint").alias("piece"), F.lit("M").alias("kind"), (F.col("q1") + k - F.col("q0")).cast("bigint").alias("n"),
        F.col("q0").cast("bigint").alias("g_q0"), (F.col("q1") + k).cast("bigint").alias("g_q1"),
        F.col("t0").cast("bigint").alias("g_t0"), (F.col("t1") + k).cast("bigint").alias("g_t1"))
    types = {f.name: f.dataType.simpleString() for f in straight.schema.fields}
    walk = a.join(ends.where("walk").select(*key), key, "left_semi").select(*key, "axis", "q_pos", "t_trans")
    walked = _fold_groups(walk, key, ["axis", "q_pos"], lambda g: _walk_block(g, k), ", ".join(f"{c} {types[c]}" for c in straight.columns))
    inner = materialize(straight.unionByName(walked), "pieces")
    # The gap before a block runs from the final point of the block before it.
    last = inner.groupBy(*key).agg(
        F.max(F.struct("piece", "g_q1", "g_t1")).alias("e"), F.min(F.struct("piece", "g_q0", "g_t0")).alias("s"))
    pts = last.select(*key, F.col("e.g_q1").alias("eq"), F.col("e.g_t1").alias("et"), F.col("s.g_q0").alias("sq"),
                      F.col("s.g_t0").alias("st"))
    back = previous_row(pts, MERGED, "block_no", {"pq": F.col("eq"), "pt": F.col("et")})
    between = back.where("pq is not null and (sq > pq or st > pt)").select(
        *key, F.lit(-1).cast("bigint").alias("piece"), F.lit("G").alias("kind"), F.lit(0).cast("bigint").alias("n"),
        F.col("pq").alias("g_q0"), F.col("sq").alias("g_q1"), F.col("pt").alias("g_t0"), F.col("st").alias("g_t1"))
    return inner.unionByName(between)


def oriented_slices(regions: DataFrame, contigs: DataFrame, lengths: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """q_seq and t_seq of (q_genome, q_chrom, g_q0, g_q1) and (t_genome, t_chrom, g_t0, g_t1, same_strand).

    Target coordinates run along the matching strand; a reverse slice is cut forward and
    then complemented.
    """
    ids = list(id_cols)
    gk = ("genome", "chrom")
    q = regions.select(*ids, F.col("q_genome").alias("genome"), F.col("q_chrom").alias("chrom"),
                       F.col("g_q0").alias("start_bp"), F.col("g_q1").alias("end_bp"))
    q = reference_slices(contigs, q, id_cols=tuple(ids), keys=gk, out="q_seq").select(*ids, "q_seq")
    lens = lengths.select(F.col("genome").alias("t_genome"), F.col("chrom").alias("t_chrom"), F.col("length").alias("__l"))
    t = regions.join(lens, ["t_genome", "t_chrom"])
    s = F.when(F.col("same_strand"), F.col("g_t0")).otherwise(F.col("__l") - F.col("g_t1"))
    e = F.when(F.col("same_strand"), F.col("g_t1")).otherwise(F.col("__l") - F.col("g_t0"))
    t = t.select(*ids, "same_strand", F.col("t_genome").alias("genome"), F.col("t_chrom").alias("chrom"),
                 s.alias("start_bp"), e.alias("end_bp"))
    t = reference_slices(contigs, t, id_cols=tuple(ids), keys=gk, out="t_fwd")
    t = t.select(*ids, F.when(F.col("same_strand"), F.col("t_fwd")).otherwise(revcomp("t_fwd")).alias("t_seq"))
    return regions.join(q, ids).join(t, ids)


def _align_rows(wide: bool):
    def run(batches):
        from strandlake.operators.align import align_many

        for pdf in batches:
            sides = list(zip(pdf["q_seq"], pdf["t_seq"]))
            once = list(dict.fromkeys(sides))
            found = dict(zip(once, align_many([q for q, _ in once], [t for _, t in once], wide)))
            ops = [found[x] for x in sides]
            yield pdf.drop(columns=["q_seq", "t_seq"]).assign(ops=ops)

    return run


def align_gaps(gaps: DataFrame, *, wide: bool = False, tasks: int | None = None) -> DataFrame:
    """H7: rows with q_seq and t_seq to ``ops``, run-length M X I D text (NULL when no path).

    Empty and equal sides are settled by expressions; the rest is spread over tasks by hash so that neighbours do not pile up, gaps
    of equal sides lie together and are aligned once, and gaps of like size are aligned as one array.
    """
    nq, nt = F.length("q_seq"), F.length("t_seq")
    easy = (
        F.when((nq == 0) & (nt == 0), F.lit("")).when(nq == 0, F.concat(nt.cast("string"), F.lit("D")))
        .when(nt == 0, F.concat(nq.cast("string"), F.lit("I")))
        .when(F.col("q_seq") == F.col("t_seq"), F.concat(nq.cast("string"), F.lit("M")))
        .when((nq == 1) & (nt == 1), F.lit("1X")))
    marked = gaps.withColumn("ops", easy)
    done = marked.where("ops is not null").drop("q_seq", "t_seq")
    hard = marked.where("ops is null").drop("ops")
    tasks = tasks or int(gaps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [f for f in hard.schema.fields if f.name not in ("q_seq", "t_seq")]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in cols), "ops string"])
    spread = hard.withColumn("__pair", F.xxhash64("q_seq", "t_seq")).repartition(tasks, "__pair").sortWithinPartitions("__pair").drop("__pair")
    return done.unionByName(spread.mapInPandas(_align_rows(wide), schema))


def op_runs(ops: Column | str) -> Column:
    """ARRAY<STRUCT<len, op>> of run-length text."""
    parts = F.regexp_extract_all(F.col(ops) if isinstance(ops, str) else ops, F.lit("[0-9]+[A-Z]"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(
        F.substring(p, 1, F.length(p) - 1).cast("int").alias("len"), F.right(p, F.lit(1)).alias("op")))


def refine_blocks(pieces: DataFrame, summary: DataFrame, contigs: DataFrame, *, wide: bool = False
                  ) -> tuple[DataFrame, DataFrame]:
    """H8: (blocks, block_ops) of merged chains from their pieces.

    A chain is refined when every gap is within the strict span (unless ``wide``), aligns,
    and the pieces reach the chain's ends with at least half of the columns equal. Others
    keep the estimate, or 100 % when the two spans are the same text. ``block_ops`` rows
    are runs ordered by (block_no, piece, run).
    """
    gk = ["genome", "chrom"]
    lengths = contigs.select(*gk, F.length("seq").cast("int").alias("length"))
    gap_len = F.greatest(F.col("g_q1") - F.col("g_q0"), F.col("g_t1") - F.col("g_t0"))
    p = materialize(pieces.withColumn("piece_id", F.monotonically_increasing_id()), "piece_ids")
    final = p.groupBy(*MERGED).agg(
        F.max(F.struct("block_no", "piece", "g_q1", "g_t1")).alias("e"),
        F.max(F.when(F.col("kind") == "G", gap_len).otherwise(0)).alias("widest"))
    reach = summary.join(final, MERGED)
    fits = (F.col("e.g_q1") == F.col("q_end")) & (F.col("e.g_t1") == F.col("o_end"))
    if not wide:
        fits = fits & (F.col("widest") <= STRICT_SPAN)
    open_chains = reach.where(fits).select(*MERGED)
    keep = p.join(open_chains, MERGED, "left_semi")
    gaps = oriented_slices(keep.where("kind = 'G'"), contigs, lengths, ["piece_id"])
    aligned = align_gaps(gaps, wide=wide)
    matched = keep.where("kind = 'M'").withColumn("ops", F.concat(F.col("n").cast("string"), F.lit("M")))
    cols = [*MERGED, "block_no", "piece", "ops"]
    ops = materialize(matched.select(*cols).unionByName(aligned.select(*cols)), "ops")
    runs = ops.select(*MERGED, "block_no", "piece", F.posexplode_outer(op_runs("ops")).alias("run", "o")).select(
        *MERGED, "block_no", "piece", "run", F.col("o.op").alias("op"), F.col("o.len").alias("len"))
    total = lambda *k_: F.coalesce(F.sum(F.when(F.col("op").isin(*k_), F.col("len"))), F.lit(0))
    ident = runs.groupBy(*MERGED).agg(total("M").alias("m"), total("M", "X", "I", "D").alias("all"),
                                      F.max(F.col("op").isNull()).alias("failed"))
    ident = ident.where("not failed and all > 0").select(
        *MERGED, F.round(F.lit(10000.0) * F.col("m") / F.col("all")).cast("int").alias("refined")).where(
        F.col("refined") >= MIN_IDENTITY)
    out = materialize(summary.join(ident, MERGED, "left"), "refined")
    same = _equal_spans(out.where("refined is null and q_end - q_start = t_end - t_start"), contigs, lengths)
    out = out.join(same, MERGED, "left")
    blocks = out.withColumn("ident_x100", F.coalesce("refined", F.when(F.col("equal"), 10000), "ident_x100")).where(
        F.col("ident_x100") >= MIN_IDENTITY)
    blocks = blocks.withColumn("has_ops", F.col("refined").isNotNull()).drop("refined", "equal")
    return blocks, runs.join(ident.select(*MERGED), MERGED, "left_semi")


def _equal_spans(chains: DataFrame, contigs: DataFrame, lengths: DataFrame, *, step: int = 4096) -> DataFrame:
    """(MERGED, equal): whether both spans are the same text, compared in pieces."""
    n = F.col("q_end") - F.col("q_start")
    cut = chains.withColumn("i", F.explode(F.sequence(F.lit(0), div(n - 1, step)))).withColumn("i", F.col("i").cast("int"))
    lo, hi = F.col("i") * step, F.least((F.col("i") + 1) * step, n)
    r = cut.select(*MERGED, "i", (F.col("q_start") + lo).alias("g_q0"), (F.col("q_start") + hi).alias("g_q1"),
                   (F.col("o_start") + lo).alias("g_t0"), (F.col("o_start") + hi).alias("g_t1"))
    got = oriented_slices(r, contigs, lengths, [*MERGED, "i"])
    return got.groupBy(*MERGED).agg(F.min(F.col("q_seq") == F.col("t_seq")).alias("equal"))


def anchors_for(contigs: DataFrame, pairs: DataFrame, *, k: int = K, w: int = WINDOW, both_strands: bool = True) -> DataFrame:
    """D8 and H1 and H2 for the genomes in ``pairs``, with a row for each anchor."""
    gk = ("genome", "chrom")
    fwd = materialize(minimizers(contigs, k=k, w=w, keys=gk), "minimizers")
    rev = materialize(minimizers(contigs, k=k, w=w, reverse=True, keys=gk), "minimizers_reverse") if both_strands else None
    return materialize(bucket_anchors(seed_join(fwd, fwd, rev, pairs, k=k)), "anchors")


def _paired(contigs: DataFrame, pairs: DataFrame, k: int, w: int, both_strands: bool, fold, schema: str) -> tuple[DataFrame, DataFrame | None]:
    """``fold`` over anchor sets of all pairs of genomes that are small enough to lie together, and the pairs that are not (None without any).

    Seeds travel as lists, a row for each chunk. Query contigs are dealt to slots by their names, a pair's targets go to all of its slots.
    """
    lists = materialize(minimizer_lists(contigs, k=k, w=w, both_strands=both_strands, keys=("genome", "chrom")), "seed_lists")
    sizes = materialize(lists.where("not reverse").groupBy("genome").agg(F.sum("n").alias("n")), "seed_counts")
    on = pairs.select("q_genome", "t_genome").distinct()
    for s in ("q", "t"):
        on = on.join(sizes.select(F.col("genome").alias(f"{s}_genome"), F.col("n").alias(f"__{s}")), f"{s}_genome")
    on = materialize(on.withColumn("slots", F.ceil(F.col("__q") / SLOT_SEEDS).cast("int")), "seed_pairs")
    fits = (F.col("__q") <= FOLD_SEEDS) & (F.col("__t") <= FOLD_SEEDS)
    near = on.where(fits).select("q_genome", "t_genome", "slots")
    slot = F.pmod(F.xxhash64("chrom"), F.col("slots")).cast("int")
    q = lists.where("not reverse").join(near, F.col("genome") == F.col("q_genome")).withColumns({"slot": slot, "query": F.lit(True)})
    t = lists.join(near, F.col("genome") == F.col("t_genome")).withColumns(
        {"slot": F.explode(F.sequence(F.lit(0), F.col("slots") - 1)), "query": F.lit(False)})
    group = ["q_genome", "t_genome", "slot"]
    rows = q.unionByName(t).select(*group, "query", "reverse", "chrom", "start_bp", "length", "pos", "key")
    tasks = int(contigs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartition(tasks, *group).sortWithinPartitions(*group, "query", "reverse", "chrom", "start_bp")
    far = on.where(~fits).select("q_genome", "t_genome")
    return laid.mapInArrow(_seed_groups(k, fold), schema), None if far.isEmpty() else far


def _seed_groups(k: int, fold):
    """A pass over rows of seed lists sorted by their group: ``fold`` of the anchor sets of whole groups, some small ones at a time."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    from strandlake.operators import pairing

    def changes(table, names):
        new = np.zeros(table.num_rows, bool)
        new[:1] = True
        for c in names:
            v = table.column(c).combine_chunks()
            new[1:] |= pc.not_equal(v.slice(1), v.slice(0, len(v) - 1)).to_numpy(zero_copy_only=False)
        return new

    def of(table):
        heads = changes(table, ["q_genome", "t_genome", "slot"])
        contigs = heads | changes(table, ["query", "reverse", "chrom"])
        names = table.select(["q_genome", "t_genome", "chrom", "reverse"]).take(pa.array(np.flatnonzero(contigs)))
        lists = table.column("pos").combine_chunks()
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        pos = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        key = table.column("key").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        query, reverse, length = (np.repeat(table.column(c).to_numpy(), n) for c in ("query", "reverse", "length"))
        along = np.where(reverse, length - (pos + k), pos)
        q, t = pairing.sides(np.repeat(np.cumsum(heads) - 1, n), np.repeat(np.cumsum(contigs) - 1, n), query, key, pos, along)
        for found in fold(pairing.anchor_sets(q, t, DIAGONAL_BIN)):
            a, b = names.take(pa.array(found.pop("q"))), names.take(pa.array(found.pop("t")))
            yield {"q_genome": a.column("q_genome"), "t_genome": a.column("t_genome"), "q_chrom": a.column("chrom"), "t_chrom": b.column("chrom"),
                   "same_strand": pc.invert(b.column("reverse"))} | found

    def out(table):
        for found in of(table):
            yield from pa.table(found).to_batches()

    def run(batches):
        held, seeds = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            n = np.cumsum(pc.list_value_length(batch.column("pos")).to_numpy(zero_copy_only=False).astype(np.int64))
            new = changes(table, ["q_genome", "t_genome", "slot"])
            if held:
                new[0] = any(held[-1].column(c)[-1] != batch.column(c)[0] for c in ("q_genome", "t_genome", "slot"))
            else:
                new[0] = False
            lo = 0
            for at in np.flatnonzero(new).tolist():
                if seeds + (n[at - 1] if at else 0) - (n[lo - 1] if lo else 0) >= pairing.SEEDS:
                    yield from out(pa.concat_tables([*held, table.slice(lo, at - lo)]))
                    held, seeds, lo = [], 0, at
            held.append(table.slice(lo))
            seeds += int(n[-1] - (n[lo - 1] if lo else 0))
        if held:
            yield from out(pa.concat_tables(held))

    return run


def _fold_chains(k: int):
    def fold(sets):
        import numpy as np
        import pyarrow as pa

        from strandlake.operators import pairing

        def linked(dq, dt):
            return (dq > 0) & (dt > 0) & (dq <= MAX_ANCHOR_GAP) & (dt <= MAX_ANCHOR_GAP)

        for c in pairing.chains(sets, linked, lambda n, q0, q1, t0, t1: (n >= MIN_ANCHORS) & (q1 - q0 + k >= MIN_BLOCK) & (t1 - t0 + k >= MIN_BLOCK)):
            place = lambda name, mask=None: pa.array(c[name].astype(np.int32), mask=mask)
            yield {"q": c["q"], "t": c["t"], "q_pos": place("q_pos"), "t_pos": place("t_pos"), "t_trans": place("t_trans"), "bucket": pa.array(c["bucket"]),
                   "prev_q": place("prev_q", c["first"]), "prev_t": place("prev_t", c["first"]), "chain_no": pa.array(c["chain_no"])}

    return fold


def _fold_counts(sets):
    import pyarrow as pa

    from strandlake.operators import pairing

    for c in pairing.bucket_counts(sets):
        yield {"q": c["q"], "t": c["t"], "bucket": pa.array(c["bucket"]), "n": pa.array(c["n"])}


PAIR_TYPES = "q_genome string, t_genome string, q_chrom string, t_chrom string, same_strand boolean, "


def chains_for(contigs: DataFrame, pairs: DataFrame, *, k: int = K, w: int = WINDOW, both_strands: bool = True) -> DataFrame:
    """D8, H1, H2 and H3 for the genomes in ``pairs``: the rows of ``chain_anchors``.

    Genomes of at most ``FOLD_SEEDS`` seeds meet where their seeds lie together, and only anchors of usable chains become rows; larger ones
    meet by key, with a row for each anchor.
    """
    schema = PAIR_TYPES + "q_pos int, t_pos int, t_trans int, bucket bigint, prev_q int, prev_t int, chain_no bigint"
    near, far = _paired(contigs, pairs, k, w, both_strands, _fold_chains(k), schema)
    if far is None:
        return near
    return near.unionByName(chain_anchors(anchors_for(contigs, far, k=k, w=w, both_strands=both_strands), k=k).select(*near.columns))


def bucket_sizes(contigs: DataFrame, pairs: DataFrame, *, k: int = K, w: int = WINDOW, both_strands: bool = True) -> DataFrame:
    """D8, H1 and H2 for the genomes in ``pairs``: (PAIR, bucket, n), how many anchors each diagonal bucket has."""
    near, far = _paired(contigs, pairs, k, w, both_strands, _fold_counts, PAIR_TYPES + "bucket bigint, n bigint")
    if far is None:
        return near
    anchors = anchors_for(contigs, far, k=k, w=w, both_strands=both_strands)
    return near.unionByName(anchors.groupBy(*PAIR, "bucket").agg(F.count("*").alias("n")))


def compare_chains(chained: DataFrame, *, k: int = K) -> tuple[DataFrame, DataFrame]:
    """H4-H6 of usable chains: (merged anchors, merged summaries)."""
    parted = materialize(split_chains(materialize(chained, "usable"), k=k), "parts")
    merged = merge_chains(chain_summary(parted, PART, k=k))
    together = materialize(merged_anchors(parted, merged, k=k), "merged")
    return together, materialize(merged_summary(together, k=k), "summary")


def compare_genomes(contigs: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """H9: (blocks, block_ops) for every genome pair, all contig pairs, both strands."""
    together, summary = compare_chains(chains_for(contigs, pairs))
    return refine_blocks(chain_pieces(together), summary, contigs)


# --- op tables ----------------------------------------------------------------------


def percent_identity(ops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """round(10000 * M / (M+X+I+D)) per block from run rows (op, len)."""
    m = F.sum(F.when(F.col("op") == "M", F.col("len")).otherwise(0))
    n = F.sum(F.when(F.col("op").isin("M", "X", "I", "D"), F.col("len")).otherwise(0))
    return ops.groupBy(*keys).agg(
        F.when(n > 0, F.least(F.round(F.lit(10000.0) * m / n).cast("int"), F.lit(10000))).otherwise(0).alias("ident_x100"))


def block_variants(blocks: DataFrame, ops: DataFrame, keys: Sequence[str], *, run: str = "run_no") -> DataFrame:
    """X once per base, I and D once per run; the target runs backwards on the reverse strand.

    ``ops`` has (keys, run_no, op, len) with run_no in order along the block; ``blocks`` has
    q_start, t_start, t_end, same_strand.
    """
    dq = F.when(F.col("op").isin("M", "X", "I"), F.col("len")).otherwise(0).cast("bigint")
    dt = F.when(F.col("op").isin("M", "X", "D"), F.col("len")).otherwise(0).cast("bigint")
    at = prefix_sums(ops, keys, run, {"q_off": dq, "t_off": dt}).withColumns(
        {"q_off": F.col("q_off") - dq, "t_off": F.col("t_off") - dt}).where("op <> 'M'")
    j = at.join(blocks.select(*keys, "q_start", "t_start", "t_end", "same_strand"), list(keys))
    n = F.when(F.col("op") == "X", F.col("len")).otherwise(1).cast("int")
    each = j.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    t = F.when(F.col("same_strand"), F.col("t_start") + F.col("t_off") + F.col("i")).otherwise(
        F.col("t_end") - 1 - F.col("t_off") - F.col("i"))
    pad = lambda op: F.when(F.col("op") == op, F.expr("repeat('N', len)")).otherwise("")
    return each.select(*keys, F.col("op").alias("kind"), (F.col("q_start") + F.col("q_off") + F.col("i")).alias("q_pos"),
                       t.alias("t_pos"), pad("D").alias("ref_bases"), pad("I").alias("alt_bases"))


def aligned_extent(blocks: DataFrame, ops: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Block ends recomputed from what the ops consume; blocks without ops stay."""
    q = F.sum(F.when(F.col("op").isin("M", "X", "I"), F.col("len")).otherwise(0))
    t = F.sum(F.when(F.col("op").isin("M", "X", "D"), F.col("len")).otherwise(0))
    used = ops.groupBy(*keys).agg(q.alias("__q"), t.alias("__t"))
    j = blocks.join(used, list(keys), "left")
    has = F.col("__q").isNotNull()
    return j.withColumns({
        "q_end": F.when(has, F.col("q_start") + F.col("__q")).otherwise(F.col("q_end")),
        "t_end": F.when(has & F.col("same_strand"), F.col("t_start") + F.col("__t")).otherwise(F.col("t_end")),
        "t_start": F.when(has & ~F.col("same_strand"), F.col("t_end") - F.col("__t")).otherwise(F.col("t_start")),
    }).drop("__q", "__t")


def numbered_runs(block_ops: DataFrame) -> DataFrame:
    """One run_no per chain in order of (block_no, piece, run), for H10, H11 and H19."""
    return rank_in_order(block_ops, MERGED, "block_no", "run_no", ties=["piece", "run"], step=1 << 12)


# --- block tables -------------------------------------------------------------------


def swap_blocks(blocks: DataFrame) -> DataFrame:
    """Query and target exchanged."""
    other = {"q_": "t_", "t_": "q_"}
    return blocks.select(*[F.col(other.get(c[:2], c[:2]) + c[2:]).alias(c) for c in blocks.columns])


def swap_ops(ops: Column | str) -> Column:
    """I and D exchanged in op text or a single op."""
    return F.translate(F.col(ops) if isinstance(ops, str) else ops, "ID", "DI")


def swap_variants(variants: DataFrame) -> DataFrame:
    """Positions, bases and I/D exchanged in H11 rows."""
    other = {"q_pos": "t_pos", "t_pos": "q_pos", "ref_bases": "alt_bases", "alt_bases": "ref_bases"}
    return variants.select(*[
        (swap_ops("kind") if c == "kind" else F.col(other.get(c, c))).alias(c) for c in variants.columns])


def pair_blocks(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """Blocks of any wanted (q_genome, t_genome), stored either way round; a genome against itself is an error."""
    asked = wanted.select("q_genome", "t_genome").distinct()
    bad = F.when(F.col("q_genome") == F.col("t_genome"), F.raise_error(F.lit("genomes must differ"))).otherwise(True)
    asked = asked.where(bad)
    stored = blocks.select("q_genome", "t_genome").distinct()
    turned = swap_blocks(blocks.join(asked.select(F.col("q_genome").alias("t_genome"), F.col("t_genome").alias("q_genome")),
                                     ["q_genome", "t_genome"], "left_semi"))
    # A pair stored in the wanted direction is used as it is, not doubled by its swap.
    turned = turned.join(stored, ["q_genome", "t_genome"], "left_anti")
    return blocks.join(asked, ["q_genome", "t_genome"], "left_semi").unionByName(turned)


def _display(blocks: DataFrame, segments: DataFrame, side: str) -> DataFrame:
    seg = segments.select(
        F.col("genome").alias(f"{side}_genome"), F.col("chrom").alias(f"{side}_chrom"), F.col("start_bp").alias("__s0"),
        (F.col("end_bp") - F.col("start_bp")).alias("__n"), F.coalesce("reversed", F.lit(False)).alias(f"__{side}_rev"))
    d = blocks.join(seg, [f"{side}_genome", f"{side}_chrom"])
    a, b, rev = F.col(f"{side}_start"), F.col(f"{side}_end"), F.col(f"__{side}_rev")
    d = d.where((a >= 0) & (b >= a) & (b <= F.col("__n")))
    return d.withColumns({
        f"{side}_start": F.col("__s0") + F.when(rev, F.col("__n") - b).otherwise(a),
        f"{side}_end": F.col("__s0") + F.when(rev, F.col("__n") - a).otherwise(b),
    }).drop("__s0", "__n")


def display_blocks(blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """Contig-local blocks in concatenated coordinates, orientation applied."""
    d = _display(_display(blocks, segments, "q"), segments, "t")
    turned = F.col("__q_rev") != F.col("__t_rev")
    return d.withColumn("same_strand", F.when(turned, ~F.col("same_strand")).otherwise(F.col("same_strand"))).drop(
        "__q_rev", "__t_rev")


def orient_segments(segments: DataFrame, *, genome: str | None = None, chrom: str | None = None, reversed: bool = True
                    ) -> DataFrame:
    """Set the orientation of one segment, a genome or all; blocks follow through H14, uncomputed."""
    hit = F.lit(True)
    if genome is not None:
        hit = hit & (F.col("genome") == genome)
    if chrom is not None:
        hit = hit & (F.col("chrom") == chrom)
    return segments.withColumn("reversed", F.when(hit, F.lit(reversed)).otherwise(F.col("reversed")))


def filter_blocks(
    blocks: DataFrame, views: DataFrame, *, min_length: int = 0, max_length: int = 0, min_identity: float = 0.0,
    max_identity: float = 100.0, cap: int | None = None, ties: Sequence[str] = ("q_start", "q_end", "t_start", "t_end", "q_chrom", "t_chrom"),
) -> DataFrame:
    """Blocks by length, identity and view (genome, v_start, v_span; a quarter span around), widest first.

    ``max_length`` 0 is off; ``cap`` holds per genome pair and is a rank limit. A genome without a view shows nothing of
    its own, so its blocks stay if the other side is in view.
    """
    max_identity = max(max_identity, min_identity)
    v = views.select("genome", "v_start", "v_span")
    d = blocks
    for s in ("q", "t"):
        d = d.join(v.select(F.col("genome").alias(f"{s}_genome"),
                            (F.col("v_start") - F.col("v_span") * 0.25).alias(f"__{s}0"),
                            (F.col("v_start") + F.col("v_span") * 1.25).alias(f"__{s}1")), f"{s}_genome", "left")
    span = F.greatest(F.col("q_end") - F.col("q_start"), F.col("t_end") - F.col("t_start"))
    keep = (span >= min_length) & F.col("ident_x100").between(min_identity * 100, max_identity * 100)
    if max_length > 0:
        keep = keep & (span <= max_length)
    seen = lambda s: F.coalesce((F.col(f"{s}_end") > F.col(f"__{s}0")) & (F.col(f"{s}_start") < F.col(f"__{s}1")), F.lit(False))
    d = d.where(keep & (seen("q") | seen("t"))).drop("__q0", "__q1", "__t0", "__t1").withColumn("span", span)
    rank = F.row_number().over(W.partitionBy("q_genome", "t_genome").orderBy(F.desc("span"), F.desc("ident_x100"), *ties))
    ranked = d.withColumn("rank", rank)
    return ranked if cap is None else ranked.where(F.col("rank") <= cap)


def blocks_in_region(blocks: DataFrame, regions: DataFrame, segments: DataFrame, *, id_col: str = "block_id") -> DataFrame:
    """Displayed blocks that overlap a selection (genome, sel_id, r_start, r_end) and their contig places.

    ``side`` is 'below' when the selected genome is the block's query, 'above' when it is
    the target; ``rank`` orders a side by start, then identity.
    """
    found = None
    for side, mine in (("below", "q"), ("above", "t")):
        b = blocks.withColumn("genome", F.col(f"{mine}_genome"))
        hit = overlap_join(b, regions, keys=["genome"], bin_size=1 << 14, left_on=(f"{mine}_start", f"{mine}_end"))
        hit = hit.withColumns({"side": F.lit(side), "__at": F.col(f"{mine}_start")}).drop("genome")
        found = hit if found is None else found.unionByName(hit)
    found = rank_in_order(found, ["sel_id", "side"], "__at", "rank", ties=[F.desc("ident_x100"), id_col]).drop("__at")
    for side in ("q", "t"):
        w = blocks.select(id_col, F.col(f"{side}_genome").alias("genome"), F.col(f"{side}_start").cast("bigint").alias("w_start"),
                          F.col(f"{side}_end").cast("bigint").alias("w_end"))
        at = to_contig_coords(w, segments, id_cols=(id_col,), bin_size=1 << 14).select(
            id_col, F.col("contig").alias(f"{side}_contig"), F.col("local_start").alias(f"{side}_local_start"),
            F.col("local_end").alias(f"{side}_local_end"))
        found = found.join(at, id_col, "left")
    return found


# --- detail of requested blocks -----------------------------------------------------


def select_monotonic(pieces: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per block the heaviest set of pieces (q_start, q_end, o_start, o_end) that advance on both axes."""
    from strandlake.operators.align import select_monotonic as pick

    order = ["q_start", "q_end", "o_start", "o_end"]

    def run(g: dict) -> dict:
        chosen = pick(*(g[c] for c in order)) if len(g["q_start"]) > 1 else [0]
        return {c: v[chosen] for c, v in g.items()}

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return _fold_groups(pieces, list(keys), order, run, types)


def block_detail(blocks: DataFrame, contigs: DataFrame, *, id_col: str = "block_id") -> tuple[DataFrame, DataFrame]:
    """(details, ops) of requested blocks (id, PAIR, q_start, q_end, t_start, t_end).

    Blocks within the strict span are aligned whole. Larger ones, and small ones below half
    identity, are cut out as a query and a target of their own, chained forward only,
    refined with generous bands, reduced to a monotonic set and stitched. ``ops`` rows are
    (id, run_no, op, len). Every requested block has a row in ``details``; ``status`` is
    'refined', 'empty span', 'unknown contig' or 'too different', and only refined ones have an identity.
    """
    gk = ["genome", "chrom"]
    lengths = contigs.select(*gk, F.length("seq").cast("int").alias("length"))
    lens = lengths.select(F.col("genome").alias("t_genome"), F.col("chrom").alias("t_chrom"), F.col("length").alias("__l"))
    want = blocks.where("q_end > q_start and t_end > t_start").join(lens, ["t_genome", "t_chrom"])
    same = F.col("same_strand")
    want = want.withColumns({
        "g_q0": F.col("q_start"), "g_q1": F.col("q_end"),
        "g_t0": F.when(same, F.col("t_start")).otherwise(F.col("__l") - F.col("t_end")),
        "g_t1": F.when(same, F.col("t_end")).otherwise(F.col("__l") - F.col("t_start"))}).drop("__l")
    cut = materialize(oriented_slices(want, contigs, lengths, [id_col]), "block_slices")
    small = F.greatest(F.length("q_seq"), F.length("t_seq")) <= STRICT_SPAN
    whole = align_gaps(cut.where(small).select(id_col, "q_seq", "t_seq"))
    whole_runs = materialize(whole.select(id_col, F.posexplode(op_runs("ops")).alias("run_no", "o")).select(
        id_col, F.col("run_no").cast("bigint").alias("run_no"), F.col("o.op").alias("op"), F.col("o.len").alias("len")), "whole")
    whole_ok = percent_identity(whole_runs, [id_col]).where(F.col("ident_x100") >= MIN_IDENTITY)
    rest = materialize(cut.join(whole_ok.select(id_col), id_col, "left_anti").where(
        (F.length("q_seq") >= K) & (F.length("t_seq") >= K)), "large_blocks")
    stitched = _stitched_detail(rest, id_col)
    good = percent_identity(stitched, [id_col]).where(F.col("ident_x100") >= MIN_IDENTITY)
    ident = whole_ok.unionByName(good)
    ops = whole_runs.join(whole_ok.select(id_col), id_col, "left_semi").unionByName(
        stitched.join(good.select(id_col), id_col, "left_semi"))
    known = cut.select(id_col, F.lit(True).alias("__known"))
    status = (F.when(F.col("ident_x100").isNotNull(), "refined")
              .when((F.col("q_end") <= F.col("q_start")) | (F.col("t_end") <= F.col("t_start")), "empty span")
              .when(F.col("__known").isNull(), "unknown contig").otherwise("too different"))
    details = blocks.drop("ident_x100").join(ident, id_col, "left").join(known, id_col, "left").withColumn("status", status)
    return details.drop("__known"), ops


def _stitched_detail(rest: DataFrame, id_col: str) -> DataFrame:
    """(id, run_no, op, len) of blocks given as q_seq and t_seq, both forward."""
    q = rest.select(F.concat(F.lit("q"), F.col(id_col).cast("string")).alias("genome"), F.lit("x").alias("chrom"), F.col("q_seq").alias("seq"))
    t = rest.select(F.concat(F.lit("t"), F.col(id_col).cast("string")).alias("genome"), F.lit("x").alias("chrom"), F.col("t_seq").alias("seq"))
    local = materialize(q.unionByName(t), "local_contigs")
    names = rest.select(id_col, F.concat(F.lit("q"), F.col(id_col).cast("string")).alias("q_genome"),
                        F.concat(F.lit("t"), F.col(id_col).cast("string")).alias("t_genome"),
                        F.length("q_seq").alias("q_len"), F.length("t_seq").alias("t_len"))
    together, summary = compare_chains(chains_for(local, names, both_strands=False))
    pieces, runs = refine_blocks(chain_pieces(together), summary, local, wide=True)
    usable = pieces.where("has_ops").join(names, ["q_genome", "t_genome"])
    usable = materialize(usable.select(id_col, *MERGED, "q_start", "q_end", "o_start", "o_end", "q_len", "t_len"), "usable")
    chosen = select_monotonic(usable, [id_col])
    chosen = materialize(chosen, "chosen")
    back = previous_row(chosen, [id_col], "q_start", {"p_q": F.col("q_end"), "p_t": F.col("o_end")}, ties=["q_end"])
    lead = back.select(
        id_col, "q_genome", "t_genome", "q_start", F.coalesce("p_q", F.lit(0)).alias("g_q0"), F.col("q_start").alias("g_q1"),
        F.coalesce("p_t", F.lit(0)).alias("g_t0"), F.col("o_start").alias("g_t1"))
    tail = chosen.groupBy(id_col, "q_genome", "t_genome", "q_len", "t_len").agg(
        F.max("q_end").alias("g_q0"), F.max("o_end").alias("g_t0")).select(
        id_col, "q_genome", "t_genome", F.col("q_len").alias("q_start"), "g_q0", F.col("q_len").alias("g_q1"), "g_t0",
        F.col("t_len").alias("g_t1"))
    gaps = lead.unionByName(tail).withColumns({"q_chrom": F.lit("x"), "t_chrom": F.lit("x"), "same_strand": F.lit(True)})
    gaps = materialize(gaps.withColumn("gap_id", F.monotonically_increasing_id()), "stitch_gaps")
    lengths = local.select("genome", "chrom", F.length("seq").cast("int").alias("length"))
    aligned = align_gaps(oriented_slices(gaps, local, lengths, ["gap_id"]).select(id_col, "q_start", "q_seq", "t_seq"), wide=True)
    filled = aligned.select(id_col, "q_start", F.posexplode(op_runs("ops")).alias("run", "o")).select(
        id_col, "q_start", F.lit(-1).cast("bigint").alias("block_no"), F.lit(0).cast("bigint").alias("piece"), "run",
        F.col("o.op").alias("op"), F.col("o.len").alias("len"))
    own = runs.join(chosen.select(id_col, *MERGED, "q_start"), MERGED).select(
        id_col, "q_start", "block_no", "piece", "run", "op", "len")
    # Order: by piece start; the gap before it (block_no -1) first. The axis packs start and block.
    both = filled.unionByName(own).where("op is not null").withColumn("__axis", F.col("q_start").cast("bigint") * (1 << 32) + F.col("block_no") + 1)
    return rank_in_order(both, [id_col], "__axis", "run_no", ties=["piece", "run"], step=1 << 48).select(
        id_col, "run_no", "op", "len")
