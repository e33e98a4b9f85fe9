"""H1-H20 over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import compare as cp
from strandlake.operators.catalog import adjacent_pairs
from strandlake.operators.sequence import minimizers
from strandlake.plans.catalog import SEGMENTS, segments
from strandlake.plans.registry import query
from strandlake.plans.sequences import minimizer_cte

PAIR = ", ".join(cp.PAIR)
CHAIN = ", ".join(cp.CHAIN)
ANCHORS = minimizer_cte("cmp_contigs", "genome, chrom", "mf", False) + ", " + \
    minimizer_cte("cmp_contigs", "genome, chrom", "mr", True) + """,
  pairs as (select * from (select genome as q_genome, lead(genome) over (order by ord) as t_genome from
    (select distinct genome, ord from cmp_contigs)) where t_genome is not null),
  tall as (select *, true as same_strand, pos as t_trans from mf
    union all select *, false, length - (pos + 15) from mr),
  anchors as (select p.q_genome, p.t_genome, q.chrom as q_chrom, t.chrom as t_chrom, same_strand, q.pos as q_pos,
      t.pos as t_pos, t.t_trans, cast(floor((t.t_trans - q.pos) / 512.0) as bigint) as bucket
    from pairs p join mf q on q.genome = p.q_genome join tall t on t.genome = p.t_genome and t.key = q.key)"""
CHAINED = ANCHORS + f""", g as (select *, lag(q_pos) over w as pq, lag(t_trans) over w as pt from (select distinct * from anchors)
    window w as (partition by {PAIR}, bucket order by q_pos, t_trans, t_pos)),
  l as (select *, coalesce(q_pos - pq between 1 and 20000 and t_trans - pt between 1 and 20000, false) as linked from g),
  c as (select *, sum(case when linked then 0 else 1 end) over (partition by {PAIR}, bucket order by q_pos, t_trans, t_pos
    rows unbounded preceding) as chain_no from l),
  ok as (select {CHAIN} from c group by {CHAIN} having count(*) >= 3 and max(q_pos) - min(q_pos) + 15 >= 100
    and max(t_pos) - min(t_pos) + 15 >= 100),
  chained as (select c.* from c semi join ok using ({CHAIN}))"""


def pairs(fx):
    return adjacent_pairs(fx.cmp_contigs.select("genome", "ord").distinct(), "ord")


def chained(fx):
    return fx.stored("cmp_chained", lambda: cp.chains_for(fx.cmp_contigs, pairs(fx)))


def parted(fx):
    return fx.stored("cmp_parts", lambda: cp.split_chains(chained(fx)))


def merged(fx):
    return fx.stored("cmp_merged", lambda: cp.merge_chains(cp.chain_summary(parted(fx), cp.PART)))


def together(fx):
    return fx.stored("cmp_together", lambda: cp.merged_anchors(parted(fx), merged(fx)))


def pieces(fx):
    return fx.stored("cmp_pieces", lambda: cp.chain_pieces(together(fx)))


def found(fx):
    """(blocks, numbered op runs) of the whole comparison."""
    made = {}

    def run():
        if not made:
            made["b"], made["o"] = cp.refine_blocks(pieces(fx), cp.merged_summary(together(fx)), fx.cmp_contigs)
        return made

    return fx.stored("cmp_found", lambda: run()["b"]), fx.stored("cmp_found_ops", lambda: cp.numbered_runs(run()["o"]))


@query("seed_join", "cmp_contigs", "with " + ANCHORS + f" select {PAIR}, q_pos, t_pos, t_trans from anchors")
def _(fx):
    gk = ("genome", "chrom")
    fwd = minimizers(fx.cmp_contigs, keys=gk)
    rev = minimizers(fx.cmp_contigs, keys=gk, reverse=True)
    return cp.seed_join(fwd, fwd, rev, pairs(fx))


@query("bucket_anchors", "cmp_contigs",
       "with " + ANCHORS + f" select {PAIR}, bucket, count(*) as n from anchors group by {PAIR}, bucket")
def _(fx):
    return cp.bucket_sizes(fx.cmp_contigs, pairs(fx))


@query("chain_anchors", "cmp_contigs", "with " + CHAINED + f" select {CHAIN}, q_pos, t_trans from chained")
def _(fx):
    return chained(fx).select(*cp.CHAIN, "q_pos", "t_trans")


@query("split_chains")
def _(fx):
    parts = cp.split_chains(chained(fx))
    return parts.groupBy(*cp.PART).agg(F.count("*").alias("n"), F.min("q_pos").alias("q_first"), F.max("q_pos").alias("q_last"))


@query("chain_summary", "cmp_contigs",
       "with " + CHAINED + f""", cov as (select *, greatest(0, q_pos + 15 - greatest(q_pos, coalesce(max(q_pos + 15) over
            (partition by {CHAIN} order by q_pos rows between unbounded preceding and 1 preceding), 0))) as new from chained),
          s as (select {CHAIN}, count(*) as n_anchors, min(q_pos) as q_start, max(q_pos) + 15 as q_end, min(t_pos) as t_start,
            max(t_pos) + 15 as t_end, min(t_trans) as o_start, max(t_trans) + 15 as o_end, cast(sum(new) as bigint) as covered
            from cov group by {CHAIN})
          select *, least(cast(round(10000.0 * covered / greatest(q_end - q_start, t_end - t_start)) as int), 10000) as ident_x100
          from s""")
def _(fx):
    return cp.chain_summary(chained(fx), cp.CHAIN)


@query("merge_chains")
def _(fx):
    m = cp.merge_chains(cp.chain_summary(parted(fx), cp.PART))
    return m.groupBy(*cp.MERGED).agg(F.count("*").alias("n_parts"), F.min("q_start").alias("q_start"), F.max("q_end").alias("q_end"))


@query("align_gaps")
def _(fx):
    lengths = fx.cmp_contigs.select("genome", "chrom", F.length("seq").cast("int").alias("length"))
    gaps = pieces(fx).where("kind = 'G'")
    key = [*cp.MERGED, "block_no", "piece"]
    rows = cp.oriented_slices(gaps, fx.cmp_contigs, lengths, key)
    return cp.align_gaps(rows).select(*key, "g_q0", "g_q1", "g_t0", "g_t1", "ops")


@query("refine_blocks")
def _(fx):
    blocks, _ = cp.refine_blocks(pieces(fx), cp.merged_summary(together(fx)), fx.cmp_contigs)
    return blocks.select(*cp.MERGED, "q_start", "q_end", "t_start", "t_end", "ident_x100", "has_ops")


@query("compare_genomes")
def _(fx):
    blocks, _ = cp.compare_genomes(fx.cmp_contigs, pairs(fx))
    return blocks.select(*cp.PAIR, "q_start", "q_end", "t_start", "t_end", "ident_x100")


@query("percent_identity", "read_ops",
       """select okey, rn, cast(round(10000.0 * sum(case when op = 'M' then len else 0 end) / sum(len)) as int) as ident_x100
          from read_ops group by 1, 2""")
def _(fx):
    return cp.percent_identity(fx.read_ops, ["okey", "rn"])


RUNS = """runs as (select o.*, b.q_start, b.t_start, b.t_end, b.same_strand,
    coalesce(sum(case when op in ('M','X','I') then len else 0 end) over w, 0) as qo,
    coalesce(sum(case when op in ('M','X','D') then len else 0 end) over w, 0) as t_off from read_ops o
    join read_blocks b on b.okey = o.okey and b.rn = o.rn window w as (partition by o.okey, o.rn order by run_no
    rows between unbounded preceding and 1 preceding))"""


@query("block_variants", "read_ops read_blocks",
       "with " + RUNS + """ select okey, rn, op as kind, cast(q_start + qo as bigint) as q_pos,
         cast(case when same_strand then t_start + t_off else t_end - 1 - t_off end as bigint) as t_pos,
         case when op = 'D' then repeat('N', len) else '' end as ref_bases,
         case when op = 'I' then repeat('N', len) else '' end as alt_bases from runs where op <> 'M'""")
def _(fx):
    return cp.block_variants(fx.read_blocks, fx.read_ops, ["okey", "rn"])


@query("found_block_variants")
def _(fx):
    blocks, ops = found(fx)
    return cp.block_variants(blocks, ops, cp.MERGED).groupBy(*cp.PAIR, "kind").agg(F.count("*").alias("n"))


@query("aligned_extent", "read_ops read_blocks",
       """with u as (select okey, rn, sum(case when op in ('M','X','I') then len else 0 end) as q,
            sum(case when op in ('M','X','D') then len else 0 end) as t from read_ops group by 1, 2)
          select b.okey, b.rn, cast(b.q_start + q as bigint) as q_end,
            cast(case when same_strand then t_start else t_end - t end as bigint) as t_start,
            cast(case when same_strand then t_start + t else t_end end as bigint) as t_end
          from read_blocks b join u on u.okey = b.okey and u.rn = b.rn""")
def _(fx):
    return cp.aligned_extent(fx.read_blocks, fx.read_ops, ["okey", "rn"]).select("okey", "rn", "q_end", "t_start", "t_end")


@query("block_detail")
def _(fx):
    blocks, _ = found(fx)
    named = blocks.withColumn("block_id", F.md5(F.concat_ws("|", *cp.MERGED)))
    details, _ = cp.block_detail(named, fx.cmp_contigs)
    return details.select("block_id", *cp.PAIR, "q_start", "q_end", "t_start", "t_end", "ident_x100", "status")


@query("select_monotonic")
def _(fx):
    b = merged(fx)
    return cp.select_monotonic(b.select(*cp.PAIR, "q_start", "q_end", "o_start", "o_end"), cp.PAIR)


DISP = """disp as (select b.block_id, b.q_genome, b.t_genome, b.q_chrom, b.t_chrom, b.ident_x100,
    case when q.reversed <> t.reversed then not b.same_strand else b.same_strand end as same_strand,
    cast(q.start_bp + case when q.reversed then q.length - b.q_end else b.q_start end as bigint) as q_start,
    cast(q.start_bp + case when q.reversed then q.length - b.q_start else b.q_end end as bigint) as q_end,
    cast(t.start_bp + case when t.reversed then t.length - b.t_end else b.t_start end as bigint) as t_start,
    cast(t.start_bp + case when t.reversed then t.length - b.t_start else b.t_end end as bigint) as t_end
  from cmp_blocks b join {seg} q on q.genome = b.q_genome and q.chrom = b.q_chrom
  join {seg} t on t.genome = b.t_genome and t.chrom = b.t_chrom
  where b.q_end <= q.length and b.t_end <= t.length)"""
DISPLAY = SEGMENTS + ", " + DISP.format(seg="segments")


def displayed(fx):
    return cp.display_blocks(fx.cmp_blocks, segments(fx)).drop("doc_id", "k")


@query("display_blocks", "cmp_contigs cmp_blocks", "with " + DISPLAY + " select * from disp")
def _(fx):
    return displayed(fx)


@query("swap_blocks", "cmp_blocks",
       """select block_id, t_genome as q_genome, q_genome as t_genome, t_chrom as q_chrom, q_chrom as t_chrom, t_start as q_start,
            t_end as q_end, q_start as t_start, q_end as t_end, ident_x100, same_strand from cmp_blocks""")
def _(fx):
    return cp.swap_blocks(fx.cmp_blocks.drop("doc_id", "k"))


@query("swap_detail", "read_ops read_blocks",
       "with " + RUNS + """ select okey, rn, translate(op, 'ID', 'DI') as kind, cast(q_start + qo as bigint) as t_pos,
         cast(case when same_strand then t_start + t_off else t_end - 1 - t_off end as bigint) as q_pos,
         case when op = 'D' then repeat('N', len) else '' end as alt_bases,
         case when op = 'I' then repeat('N', len) else '' end as ref_bases from runs where op <> 'M'""")
def _(fx):
    return cp.swap_variants(cp.block_variants(fx.read_blocks, fx.read_ops, ["okey", "rn"]))


@query("pair_blocks", "cmp_blocks",
       """select block_id, q_genome, t_genome, q_start, t_start from cmp_blocks where (doc_id // 8) % 2 = 1
          union all select block_id, t_genome, q_genome, t_start, q_start from cmp_blocks where (doc_id // 8) % 2 = 0""")
def _(fx):
    k = fx.cmp_base.select("blk").distinct()
    a, b = F.concat(F.lit("a"), F.col("blk").cast("string")), F.concat(F.lit("b"), F.col("blk").cast("string"))
    odd = F.col("blk") % 2 == 1
    wanted = k.select(F.when(odd, a).otherwise(b).alias("q_genome"), F.when(odd, b).otherwise(a).alias("t_genome"))
    return cp.pair_blocks(fx.cmp_blocks, wanted).select("block_id", "q_genome", "t_genome", "q_start", "t_start")


FILTERED = "with " + DISPLAY + """, v as (select distinct genome, 500 * (ord % 3) as v_start, 9000 as v_span from cmp_contigs),
          f as (select d.*, greatest(q_end - q_start, t_end - t_start) as span from disp d join v a on a.genome = d.q_genome
            join v b on b.genome = d.t_genome where ident_x100 between 5500 and 9800
            and ((q_end > a.v_start - 2250 and q_start < a.v_start + 11250) or (t_end > b.v_start - 2250 and t_start < b.v_start + 11250)))
          select block_id, span, rank from (select *, row_number() over (partition by q_genome, t_genome order by span desc,
            ident_x100 desc, q_start, q_end, t_start, t_end, q_chrom, t_chrom) as rank from f where span >= 60 and span <= 2000)"""


def filtered(fx, cap=None):
    v = fx.cmp_contigs.select("genome", F.expr("500 * (ord % 3)").alias("v_start"), F.lit(9000).alias("v_span")).distinct()
    return cp.filter_blocks(displayed(fx), v, min_length=60, max_length=2000, min_identity=55.0, max_identity=98.0,
                            cap=cap).select("block_id", "span", "rank")


@query("filter_blocks", "cmp_contigs cmp_blocks", FILTERED)
def _(fx):
    return filtered(fx)


@query("filter_blocks_first", "cmp_contigs cmp_blocks", FILTERED + " where rank <= 10")
def _(fx):
    return filtered(fx, cap=10)


@query("blocks_in_region", "cmp_contigs cmp_blocks",
       "with " + DISPLAY + """, r as (select distinct genome, genome as sel_id, 200 as r_start, 4200 as r_end from cmp_contigs),
          h as (select d.*, sel_id, 'below' as side, q_start as from_bp from disp d join r on r.genome = d.q_genome
              and d.q_start < r_end and d.q_end > r_start
            union all select d.*, sel_id, 'above', t_start from disp d join r on r.genome = d.t_genome
              and d.t_start < r_end and d.t_end > r_start)
          select h.sel_id, side, block_id, row_number() over (partition by sel_id, side order by from_bp, ident_x100 desc, block_id) as rank,
            q_chrom as q_contig, t_chrom as t_contig, cast(q_start - q.start_bp as bigint) as q_local_start,
            cast(t_end - t.start_bp as bigint) as t_local_end
          from h join segments q on q.genome = q_genome and q.chrom = q_chrom join segments t on t.genome = t_genome and t.chrom = t_chrom""")
def _(fx):
    r = fx.cmp_contigs.select("genome", F.col("genome").alias("sel_id"), F.lit(200).alias("r_start"),
                              F.lit(4200).alias("r_end")).distinct()
    return cp.blocks_in_region(displayed(fx), r, segments(fx)).select(
        "sel_id", "side", "block_id", "rank", "q_contig", "t_contig", "q_local_start", "t_local_end")


@query("orient_segments", "cmp_contigs cmp_blocks",
       "with " + SEGMENTS + ", turned as (select * replace (genome = 'a3' or reversed as reversed) from segments), " +
       DISP.format(seg="turned") + " select block_id, same_strand, q_start, q_end, t_start, t_end from disp")
def _(fx):
    seg = cp.orient_segments(segments(fx), genome="a3", reversed=True)
    return cp.display_blocks(fx.cmp_blocks, seg).select("block_id", "same_strand", "q_start", "q_end", "t_start", "t_end")
