"""F1-F31 over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import cigar as cg, coords as co
from strandlake.operators import reads as rd
from strandlake.plans.registry import query

ID = ["okey", "rn"]
AL = """al as (select *, case when (flags & 8) = 0 and mate_pos >= 0 then mate_pos end as mate_start,
  case when (flags & 8) = 0 and mate_pos >= 0 then mate_pos + (end_bp - start_bp) end as mate_end,
  case when (flags & 8) = 0 and mate_pos >= 0 and mate_chrom <> chrom then mate_chrom end as mate_ref,
  (flags & 16) <> 0 as reverse, okey * 1000 + rn as rid,
  case when cigar like '%S%M' then 'ACACACACAC' else '' end as clip_left,
  case when cigar like '%M%S' then 'TGTGTGTGTGTG' else '' end as clip_right from alignments)"""
OPS = """ops as (select okey, rn, chrom, read_seq, i, right(t, 1) as op, cast(left(t, length(t) - 1) as int) as len, start_bp
    from (select *, l[i] as t from (select *, unnest(generate_series(1, len(l))) as i from
      (select *, regexp_extract_all(cigar, '[0-9]+[^0-9]') as l from alignments)))),
  placed_ops as (select *, start_bp + coalesce(sum(case when op in ('M','D','N','=','X') then len else 0 end) over w, 0) as r0,
    coalesce(sum(case when op in ('M','I','S','=','X') then len else 0 end) over w, 0) as q0
    from ops window w as (partition by okey, rn order by i rows between unbounded preceding and 1 preceding))"""
MD = """tok as (select okey, rn, chrom, start_bp, i, l[i] as t from (select *, unnest(generate_series(1, len(l))) as i from
      (select *, regexp_extract_all(md, '[0-9]+|\\^[A-Za-z]+|[A-Za-z]') as l from alignments))),
  md_at as (select okey, rn, chrom, t, start_bp + coalesce(sum(case when regexp_matches(t, '^[0-9]') then cast(t as int)
      when t like '^%' then length(t) - 1 else 1 end) over (partition by okey, rn order by i
      rows between unbounded preceding and 1 preceding), 0) as pos from
      (select okey, rn, chrom, start_bp, i, t from tok)),
  md_snps as (select okey, rn, chrom, cast(pos as int) as pos from md_at where regexp_matches(t, '^[A-Za-z]$'))"""
SNPS = MD.replace("cast(t as int)", "try_cast(t as int)") + """,
  snps as (select s.okey, s.rn, s.chrom, s.pos, coalesce(upper(substr(o.read_seq, cast(o.q0 + s.pos - o.r0 + 1 as int), 1)), 'N')
    as base from md_snps s left join placed_ops o on o.okey = s.okey and o.rn = s.rn and o.op = 'M'
      and s.pos >= o.r0 and s.pos < o.r0 + o.len)"""


def with_mates(fx):
    a = rd.soft_clips(rd.mate_fields(fx.alignments))
    return a.withColumns({"reverse": rd.has_flag(16), "rid": F.expr("okey * 1000 + rn")})


@query("reference_span", "alignments", "select okey, rn, end_bp - start_bp as span from alignments")
def _(fx):
    return fx.alignments.select("okey", "rn", cg.reference_span("cigar", F.length("read_seq")).alias("span"))


@query("dedupe_exact", "alignments",
       """select name, chrom, start_bp, end_bp, flags, mapq, cigar, mate_pos, min(md) as md from
            (select *, 1 as c from alignments union all select * replace ('9' || md as md), 2 from alignments)
          group by 1, 2, 3, 4, 5, 6, 7, 8""")
def _(fx):
    a = fx.alignments
    twice = a.unionByName(a.withColumn("md", F.concat(F.lit("9"), "md")))
    return rd.dedupe_exact(twice, keep_first=["md"]).select(*rd.EXACT_KEY, "md")


@query("dedupe_best", "alignments",
       "with " + AL + """ select name, start_bp, end_bp, mate_start, mate_end, reverse, flags, score // 1000 as n_snps,
          score % 1000 as mapq from (select name, start_bp, end_bp, coalesce(mate_start, -1) as mate_start,
            coalesce(mate_end, -1) as mate_end, reverse, flags, max(n_snps * 1000 + mapq) as score from
            (select *, rn % 4 as n_snps from al union all select *, (rn + 2) % 4 from al) group by 1, 2, 3, 4, 5, 6, 7)""")
def _(fx):
    a = with_mates(fx)
    twice = a.withColumn("n_snps", F.expr("rn % 4")).unionByName(a.withColumn("n_snps", F.expr("(rn + 2) % 4")))
    return rd.dedupe_best(twice).select(*rd.BEST_KEY, "n_snps", "mapq")


@query("filter_reads", "alignments",
       """select okey, rn from alignments where mapq >= 20 and (flags & 3840) = 0 and (flags & 2) <> 0
            and (flags & 32) <> 0""")
def _(fx):
    return rd.filter_reads(fx.alignments, min_mapq=20, proper_pair_only=True, mate_reverse_only=True).select(*ID)


@query("fragment_len", "alignments",
       "with " + AL + """ select okey, rn, abs(tlen) as plain,
          case when mate_start is null then greatest(1, end_bp - start_bp) else abs(tlen) end as concat from al""")
def _(fx):
    return with_mates(fx).select("okey", "rn", rd.fragment_len().alias("plain"),
                                 rd.fragment_len(concat_view=True).alias("concat"))


@query("mismatches_md", "alignments", "with " + MD.replace("cast(t as int)", "try_cast(t as int)") +
       " select okey, rn, pos from md_snps")
def _(fx):
    return rd.mismatches_md(fx.alignments, ID).select("okey", "rn", "pos")


@query("mismatches_cigar", "alignments contigs",
       "with " + OPS + """, m as (select o.okey, o.rn, o.r0, substr(c.seq, cast(o.r0 + 1 as int), o.len) as rb,
            substr(o.read_seq, cast(o.q0 + 1 as int), o.len) as qb from placed_ops o join contigs c on c.chrom = o.chrom
            where o.op = 'M'),
          e as (select okey, rn, r0 + i - 1 as pos, substr(rb, i, 1) as r, substr(qb, i, 1) as base from
            (select *, unnest(generate_series(1, least(length(rb), length(qb)))) as i from m where rb <> qb))
          select okey, rn, cast(pos as int) as pos, base from e where r <> base""")
def _(fx):
    return rd.mismatches_cigar(fx.alignments.drop("md"), fx.contigs, ID).select("okey", "rn", "pos", "base")


@query("read_snps", "alignments", "with " + OPS + ", " + SNPS + " select okey, rn, pos, base from snps")
def _(fx):
    return rd.read_snps(fx.alignments, fx.contigs, ID).select("okey", "rn", "pos", "base")


@query("soft_clips", "alignments", "with " + AL + " select okey, rn, clip_left, clip_right from al")
def _(fx):
    return rd.soft_clips(fx.alignments).select("okey", "rn", "clip_left", "clip_right")


@query("indel_markers", "alignments",
       "with " + OPS + """ select okey, rn, case when op = 'I' then 'ins' else 'del' end as kind, cast(r0 as int) as start_bp,
          cast(r0 + case when op = 'I' then 0 else len end as int) as end_bp from placed_ops where op in ('I', 'D', 'N')""")
def _(fx):
    return rd.indel_markers(fx.alignments, ID).select("okey", "rn", "kind", "start_bp", "end_bp")


@query("mate_fields", "alignments", "with " + AL + """ select okey, rn, mate_start, mate_end, mate_ref from al""")
def _(fx):
    return rd.mate_fields(fx.alignments).select("okey", "rn", "mate_start", "mate_end", "mate_ref")


@query("same_ref_mate", "alignments", "with " + AL + """ select okey, rn, (flags & 1) <> 0 and mate_start is not null
         and mate_ref is null as same_ref_mate from al""")
def _(fx):
    return rd.mate_fields(fx.alignments).select("okey", "rn", "same_ref_mate")


KEYED = """k as (select *, case when mate_start < start_bp or (mate_start = start_bp and mate_end < end_bp) then mate_start
    else start_bp end as a0, case when mate_start < start_bp or (mate_start = start_bp and mate_end < end_bp)
    then mate_end else end_bp end as a1, case when mate_start < start_bp or (mate_start = start_bp and mate_end < end_bp)
    then start_bp else mate_start end as b0, case when mate_start < start_bp or (mate_start = start_bp and mate_end < end_bp)
    then end_bp else mate_end end as b1 from al where mate_start is not null)"""


@query("mate_lookup", "alignments",
       "with " + AL + ", " + KEYED + """ select a.rid, case when max(b.rid) <> a.rid then max(b.rid) end as mate_id
          from k a left join k b on b.chrom = a.chrom and b.name = a.name and b.a0 = a.a0 and b.a1 = a.a1 and b.b0 = a.b0
            and b.b1 = a.b1 and b.start_bp = a.mate_start and b.end_bp = a.mate_end group by a.rid""")
def _(fx):
    return rd.mate_lookup(with_mates(fx), "rid")


@query("infer_mate_contig", "alignments",
       """with o as (select a.okey, a.rn, min(struct_pack(s := b.start_bp, e := b.end_bp, c := b.chrom)).c as m
            from alignments a join alignments b on a.name = b.name and a.chrom <> b.chrom group by 1, 2)
          select a.okey, a.rn, o.m as inferred_mate from alignments a left join o on o.okey = a.okey and o.rn = a.rn""")
def _(fx):
    return rd.infer_mate_contig(fx.alignments, ["start_bp", "end_bp"]).select("okey", "rn", "inferred_mate")


@query("top_mate_contigs", "alignments",
       """with m as (select chrom, mate_chrom as mate, count(*) as n from alignments where mate_chrom <> chrom group by 1, 2),
          r as (select *, row_number() over (partition by chrom order by n desc, mate) as k from m)
          select chrom, least(k, 4) as slot, case when k <= 3 then mate else 'other' end as mate,
            cast(sum(n) as bigint) as n from r group by 1, 2, 3""")
def _(fx):
    return rd.top_mate_contigs(rd.mate_fields(fx.alignments), top=3)


MAPPED = """d as (select distinct name, chrom, start_bp, end_bp, flags, mapq, cigar, mate_pos, (flags & 16) <> 0 as reverse
    from reads where (flags & 4) = 0),
  bp as (select chrom, reverse, p, count(*) as depth from
    (select chrom, reverse, unnest(generate_series(start_bp, end_bp - 1)) as p from d) group by 1, 2, 3)"""
GRID = """tiles as (select chrom, t as tile, t * 4096 as t0, least((t + 1) * 4096, 100000) as t1 from
    (select chrom, unnest(generate_series(0, 99999 // 4096)) as t from ctg_lengths)),
  nb as (select *, case when t1 - t0 = 4096 then 256 else greatest(1, cast(round(256.0 * (t1 - t0) / 4096) as int)) end as nb from tiles),
  grid as (select *, t0 + b * (t1 - t0) // nb as b0, t0 + (b + 1) * (t1 - t0) // nb as b1 from
    (select *, unnest(generate_series(0, nb - 1)) as b from nb)),
  pos as (select chrom, tile, b, b1 - b0 as w, unnest(generate_series(b0, b1 - 1)) as p from grid)"""


def mean_sql(total: str) -> str:
    return f"greatest(cast(round({total} / w) as int), case when {total} > 0 then 1 else 0 end)"


BINNED = f"with {MAPPED}, {GRID}, s as (select pos.chrom, tile, b, w, coalesce(sum(depth), 0) as t, " \
    "coalesce(sum(depth) filter (where not reverse), 0) as f, coalesce(sum(depth) filter (where reverse), 0) as r " \
    "from pos left join bp on bp.chrom = pos.chrom and bp.p = pos.p group by 1, 2, 3, 4) "


@query("coverage_bins", "reads ctg_lengths", BINNED + f"select chrom, tile, b as bin, {mean_sql('t')} as depth from s")
def _(fx):
    return rd.coverage_bins(fx.reads, fx.ctg_lengths, zoom=2)


@query("strand_coverage_bins", "reads ctg_lengths",
       BINNED + f"select chrom, tile, b as bin, {mean_sql('f')} as forward, {mean_sql('r')} as reverse from s")
def _(fx):
    return rd.strand_coverage_bins(fx.reads, fx.ctg_lengths, zoom=2)


@query("coverage_runs", "reads",
       f"""with {MAPPED}, j as (select *, p - row_number() over (partition by chrom, reverse, depth order by p) as g from bp)
           select chrom, reverse, min(p) as start_bp, max(p) + 1 as end_bp, depth from j group by chrom, reverse, depth, g""")
def _(fx):
    return rd.coverage_runs(fx.reads)


@query("coverage_from_runs", "reads ctg_lengths",
       BINNED + f"""select chrom, tile, b as bin, {mean_sql('f')} as forward, {mean_sql('r')} as reverse,
         {mean_sql('t')} as depth from s""")
def _(fx):
    return rd.coverage_from_runs(rd.coverage_runs(fx.reads), fx.ctg_lengths, zoom=2)


@query("coverage_bin_count", "doc_lengths",
       """select chrom, t as tile, case when (t + 1) * 1024 <= length then 256
            else greatest(1, cast(round(256.0 * (length - t * 1024) / 1024) as int)) end as n_bins
          from (select chrom, length, unnest(generate_series(0, (length - 1) // 1024)) as t from doc_lengths where length > 0)""")
def _(fx):
    from strandlake.operators.sequence import contig_tiles

    return contig_tiles(fx.doc_lengths, 0).select(
        "chrom", "tile",
        co.coverage_bin_count(F.col("tile_start"), F.col("tile_start") + 1024, F.col("length")).alias("n_bins"))


READ_TILES = """with d as (select distinct name, chrom, start_bp, end_bp, flags, mapq, cigar, mate_pos from reads where (flags & 4) = 0),
          t as (select *, unnest(generate_series(start_bp // 8192, (end_bp - 1) // 8192)) as tile from d),
          b as (select *, least((greatest(start_bp, tile * 8192) + (least(end_bp, tile * 8192 + 8192)
              - greatest(start_bp, tile * 8192) - 1) // 2 - tile * 8192) * 256 // 8192, 255) as bin from t),
          r as (select *, row_number() over (partition by chrom, tile, bin order by start_bp, end_bp, name, flags, mapq, cigar)
            as rank from b)
          select chrom, tile, bin, name, start_bp, end_bp, flags, mapq, rank from r"""
TILE_COLUMNS = ["chrom", "tile", "bin", "name", "start_bp", "end_bp", "flags", "mapq", "rank"]


@query("read_tiles", "reads", READ_TILES)
def _(fx):
    return rd.read_tiles(fx.reads, zoom=3).select(*TILE_COLUMNS)


@query("read_tiles_limited", "reads", READ_TILES + " where rank <= 1 + case when bin < 300 % 256 then 1 else 0 end")
def _(fx):
    return rd.read_tiles(fx.reads, zoom=3, limit=300).select(*TILE_COLUMNS)


SAMPLE_KEY = "concat_ws('|', name, start_bp, end_bp, flags, mapq)"


@query("sample_reads", "reads",
       f"""with d as (select distinct name, chrom, start_bp, end_bp, flags, mapq from reads),
           b as (select *, least(greatest((cast(floor((start_bp + end_bp) * 0.5) as bigint)) * 128 // 100000, 0), 127) as bin,
             md5({SAMPLE_KEY}) as h from d),
           r as (select *, row_number() over (partition by chrom, bin order by h) as k from b)
           select name, chrom, start_bp, end_bp, flags, mapq from r where k <= 7 + case when bin < 1000 % 128 then 1 else 0 end""")
def _(fx):
    d = fx.reads.select("name", "chrom", "start_bp", "end_bp", "flags", "mapq").distinct()
    return rd.sample_reads(d, view_start=0, view_end=100000, bp_per_px=500.0, limit=1000, key=F.expr(SAMPLE_KEY))


@query("strand_summary", "reads ctg_lengths",
       BINNED + f""", v as (select s.chrom, s.b, {mean_sql('f')} as forward, {mean_sql('r')} as reverse, t0, t1, nb from s
            join nb on nb.chrom = s.chrom and nb.tile = s.tile where t1 > 10000 and t0 < 60000),
          m as (select *, cast(least(greatest(floor((t0 + (b + 0.5) * greatest(1.0, (t1 - t0) / nb::double) - 10000) * 100 / 50000),
            0), 99) as int) as bin from v)
          select c.chrom, c.bin, coalesce(avg(forward), 0.0) as forward, coalesce(avg(reverse), 0.0) as reverse
          from (select chrom, cast(unnest(generate_series(0, 99)) as int) as bin from ctg_lengths) c
          left join m on m.chrom = c.chrom and m.bin = c.bin group by 1, 2""")
def _(fx):
    bins = rd.strand_coverage_bins(fx.reads, fx.ctg_lengths, zoom=2)
    return rd.strand_summary(bins, fx.ctg_lengths, zoom=2, view_start=10000, view_end=60000, bins=100)


@query("fragment_summary", "alignments",
       """with b as (select chrom, least(greatest(cast(floor((start_bp + end_bp) * 0.5) as bigint) * 64 // 4000, 0), 63) as bin,
            list_sort(list(abs(tlen))) as l from alignments where tlen <> 0 group by 1, 2),
          g as (select chrom, cast(unnest(generate_series(0, 63)) as int) as bin from (select distinct chrom from alignments))
          select g.chrom, g.bin, coalesce(l[cast(floor((len(l) - 1) * 0.25) as int) + 1], -1) as p25,
            coalesce(l[cast(floor((len(l) - 1) * 0.5) as int) + 1], -1) as p50,
            coalesce(l[cast(floor((len(l) - 1) * 0.75) as int) + 1], -1) as p75
          from g left join b on b.chrom = g.chrom and b.bin = g.bin""")
def _(fx):
    r = fx.alignments.withColumn("fragment_len", rd.fragment_len())
    return rd.fragment_summary(r, view_start=0, view_end=4000, bins=64)


@query("fragment_scale", "alignments",
       """with f as (select okey, rn, greatest(1, abs(tlen))::double as f from alignments),
          m as (select max(f) as m from f)
          select okey, rn, round(f / m, 6) as lin, round(ln(f + 1) / ln(m + 1), 6) as logged from f, m""")
def _(fx):
    r = fx.alignments.withColumn("fragment_len", rd.fragment_len())
    both = rd.fragment_scale(rd.fragment_scale(r, out="lin"), log=True, out="logged")
    return both.select("okey", "rn", F.round("lin", 6).alias("lin"), F.round("logged", 6).alias("logged"))


def pile_sql(strand: str = "") -> str:
    """Counts per position, or with ``strand`` (a leading column name and comma) per position and strand."""
    return PILE.replace("a.start_bp, substr(c.seq", ("(a.flags & 16) <> 0 as reverse, " if strand else "") + "a.start_bp, substr(c.seq").replace(
        "select a.okey, a.rn, a.chrom, i as pos", f"select {strand}a.okey, a.rn, a.chrom, i as pos").replace(
        "select e.chrom, e.pos", f"select {strand}e.chrom, e.pos").replace(
        "n as (select chrom, pos, ref_base, base, count(*) as n from called where base in ('A','C','G','T','D') group by 1, 2, 3, 4)",
        f"n as (select {strand}chrom, pos, ref_base, base, count(*) as n from called where base in ('A','C','G','T','D') group by all)").replace(
        "select chrom, cast(pos as int)", f"select {strand}chrom, cast(pos as int)").replace(
        "partition by chrom, pos", f"partition by {strand}chrom, pos")


PILE = OPS + ", " + SNPS + """, del as (select okey, rn, unnest(generate_series(cast(r0 as int), cast(r0 + len - 1 as int))) as pos
    from placed_ops where op = 'D'),
  each_bp as (select a.okey, a.rn, a.chrom, i as pos, substr(frag, cast(i - start_bp + 1 as int), 1) as ref_base from
    (select a.okey, a.rn, a.chrom, a.start_bp, substr(c.seq, a.start_bp + 1, a.end_bp - a.start_bp) as frag,
       unnest(generate_series(a.start_bp, a.end_bp - 1)) as i from alignments a join contigs c on c.chrom = a.chrom) a),
  called as (select e.chrom, e.pos, e.ref_base, case when d.pos is not null then 'D' when s.base is not null then s.base
      else e.ref_base end as base from each_bp e
    left join del d on d.okey = e.okey and d.rn = e.rn and d.pos = e.pos
    left join snps s on s.okey = e.okey and s.rn = e.rn and s.pos = e.pos),
  n as (select chrom, pos, ref_base, base, count(*) as n from called where base in ('A','C','G','T','D') group by 1, 2, 3, 4)
  select chrom, cast(pos as int) as pos, ref_base, base, n, n / cast(sum(n) over (partition by chrom, pos) as double) as frac,
    row_number() over (partition by chrom, pos order by n, base) - 1 as ord from n"""


@query("pileup_counts", "alignments contigs", "with " + PILE)
def _(fx):
    return rd.pileup_counts(fx.alignments, fx.contigs, ID).select("chrom", "pos", "ref_base", "base", "n", "frac", "ord")


@query("pileup_counts_by_strand", "alignments contigs", "with " + pile_sql("reverse, "))
def _(fx):
    return rd.pileup_counts(fx.alignments, fx.contigs, ID, by_strand=True).select(
        "reverse", "chrom", "pos", "ref_base", "base", "n", "frac", "ord")


@query("stack_depth", "alignments",
       "with " + AL + """, e as (select chrom, start_bp - length(clip_left) as p, 1 as d from al
            union all select chrom, end_bp + length(clip_right) + 1, -1 from al),
          n as (select chrom, p, sum(d) as d from e group by 1, 2)
          select chrom, cast(max(s) as bigint) as rows_needed from
            (select chrom, sum(d) over (partition by chrom order by p) as s from n) group by chrom""")
def _(fx):
    return rd.stack_depth(rd.soft_clips(fx.alignments))


@query("pair_groups", "alignments",
       "with " + AL + ", " + KEYED.replace("from al where mate_start is not null)", "from al)") + """,
          c as (select *, coalesce(mate_end > mate_start and abs(cast(trunc((mate_start + mate_end) / 2.0) as bigint)
              - cast(trunc((start_bp + end_bp) / 2.0) as bigint)) <= 1000, false) as near,
            start_bp - length(clip_left) as s, end_bp + length(clip_right) as e from k)
          select chrom, case when near then concat_ws('|', name, a0, a1, b0, b1)
              else concat_ws('|', name, start_bp, end_bp, reverse::int, flags) end as group_key,
            min(case when near then least(s, mate_start) else s end) as start_bp,
            max(case when near then greatest(e, mate_end) else e end) as end_bp, count(*) as n_reads from c group by 1, 2""")
def _(fx):
    return rd.pair_groups(with_mates(fx), view_bp=500)


def _orientation(fx):
    return fx.doc_lengths.select("chrom", "length", F.expr("doc_id % 3 = 1").alias("reversed"))


ORI = "o as (select chrom, length, doc_id % 3 = 1 as reversed from doc_lengths)"
CUT = "array_to_string(list_reverse(regexp_extract_all(cigar, '[0-9]+[^0-9]')), '')"


@query("apply_orientation_reads", "alignments doc_lengths",
       f"""with {AL}, {ORI}, j as (select al.*, o.length, o.reversed, m.length as ml,
             m.reversed and mate_start is not null as mrev from al join o on o.chrom = al.chrom
             join o m on m.chrom = coalesce(al.mate_ref, al.chrom))
           select okey, rn, case when reversed then length - end_bp else start_bp end as start_bp,
             case when reversed then length - start_bp else end_bp end as end_bp,
             case when reversed then {CUT} else cigar end as cigar,
             case when reversed then xor(xor(flags, 16), case when mrev then 32 else 0 end) else flags end as flags,
             case when reversed and clip_right <> '' then 'CACACACACACA' when reversed then '' else clip_left end as clip_left,
             case when reversed and clip_left <> '' then 'GTGTGTGTGT' when reversed then '' else clip_right end as clip_right,
             case when reversed and mrev then ml - mate_end else mate_start end as mate_start,
             case when reversed and mrev then ml - mate_start else mate_end end as mate_end from j""")
def _(fx):
    return rd.apply_orientation_reads(with_mates(fx), _orientation(fx)).select(
        "okey", "rn", "start_bp", "end_bp", "cigar", "flags", "clip_left", "clip_right", "mate_start", "mate_end")


@query("apply_orientation_snps", "alignments doc_lengths",
       f"""with {OPS}, {SNPS}, {ORI} select okey, rn, case when reversed then length - 1 - pos else pos end as pos,
             case when reversed then translate(base, 'ACGT', 'TGCA') else base end as base
           from snps join o on o.chrom = snps.chrom""")
def _(fx):
    snps = rd.read_snps(fx.alignments, fx.contigs, ID)
    return rd.apply_orientation_snps(snps, _orientation(fx)).select("okey", "rn", "pos", "base")


@query("apply_orientation_coverage", "reads ctg_lengths",
       BINNED + f"""select s.chrom, s.tile, nb.nb - 1 - s.b as bin, {mean_sql('r')} as forward, {mean_sql('f')} as reverse
         from s join nb on nb.chrom = s.chrom and nb.tile = s.tile""")
def _(fx):
    bins = rd.strand_coverage_bins(fx.reads, fx.ctg_lengths, zoom=2)
    t0 = F.col("tile") * 4096
    n = co.coverage_bin_count(t0, t0 + 4096, F.lit(100000))
    return rd.apply_orientation_coverage(bins, n)


@query("depth_series", "reads ctg_lengths",
       f"""with d as (select distinct source, name, chrom, start_bp, end_bp, flags, mapq, cigar, mate_pos from reads
             where (flags & 4) = 0),
           bp as (select source, chrom, p, count(*) as depth from
             (select source, chrom, unnest(generate_series(start_bp, end_bp - 1)) as p from d) group by 1, 2, 3), {GRID},
           s as (select src.source, pos.chrom, tile, b, w, coalesce(sum(depth), 0) as t from pos
             join (select distinct source, chrom from reads) src on src.chrom = pos.chrom
             left join bp on bp.chrom = pos.chrom and bp.p = pos.p and bp.source = src.source group by 1, 2, 3, 4, 5)
           select source, chrom, tile, b as bin, {mean_sql('t')} as depth from s""")
def _(fx):
    return rd.depth_series(fx.reads, fx.ctg_lengths, zoom=2)
