"""B1-B11 over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import catalog as ct
from strandlake.plans.registry import query


@query("list_contigs", "doc_lengths",
       """select chrom, length, row_number() over (order by chrom) - 1 as contig_id, doc_id % 5 = 0 as reversed
          from doc_lengths""")
def _(fx):
    return ct.list_contigs(fx.doc_lengths, reversed_contigs=fx.doc_lengths.where("doc_id % 5 = 0")).select(
        "chrom", "length", "contig_id", "reversed")


ALL_LENGTHS = """(select chrom, length from doc_lengths union all select chrom, length from ctg_lengths)"""


@query("annotation_counts", "doc_lengths features",
       f"""select c.chrom, count(f.chrom) as n from {ALL_LENGTHS} c left join features f on c.chrom = f.chrom
           group by c.chrom""")
def _(fx):
    cat = fx.doc_lengths.select("chrom", "length").unionByName(fx.ctg_lengths)
    return ct.annotation_counts(cat, fx.features)


VERSIONED = """case when doc_id % 3 = 0 then concat(chrom, '.', cast(doc_id % 7 as varchar(3)))
  when doc_id % 3 = 1 then chrom else concat(chrom, '.v1') end"""


@query("normalize_chrom_alias", "doc_lengths",
       f"""select name, regexp_replace(name, '^(.+)\\.[0-9]+$', '\\1') as alias
           from (select {VERSIONED} as name from doc_lengths)""")
def _(fx):
    return fx.doc_lengths.select(F.expr(VERSIONED).alias("name")).withColumn("alias", ct.normalize_chrom_alias("name"))


# Every eleventh contig appears under two versions, so its alias is ambiguous.
CAT = """(select concat(chrom, '.1') as chrom, length from doc_lengths where doc_id % 11 <> 5
  union all select chrom, length + 1 from doc_lengths where doc_id % 11 = 3
  union all select concat(chrom, '.2'), length from doc_lengths where doc_id % 11 = 0)"""
RESOLVED = f"""n as (select chrom as name, length from doc_lengths),
 c as (select chrom, length, regexp_replace(chrom, '^(.+)\\.[0-9]+$', '\\1') as alias from {CAT}),
 a as (select n.name, n.length, count(*) as hits, min(c.chrom) as chrom from n join c on c.alias = n.name {{len}}
       group by 1, 2),
 x as (select n.name, c.chrom, c.length as c_len from n join c on c.chrom = n.name)"""


def _catalogue(fx):
    d = fx.doc_lengths
    return (
        d.where("doc_id % 11 <> 5").select(F.concat("chrom", F.lit(".1")).alias("chrom"), "length")
        .unionByName(d.where("doc_id % 11 = 3").select("chrom", (F.col("length") + 1).alias("length")))
        .unionByName(d.where("doc_id % 11 = 0").select(F.concat("chrom", F.lit(".2")).alias("chrom"), "length")))


@query("resolve_contigs", "doc_lengths",
       "with " + RESOLVED.format(len="and c.length = n.length") +
       """ select n.name, n.length, case when x.chrom is not null then
             case when x.c_len = n.length then x.chrom end when a.hits = 1 then a.chrom end as chrom
           from n left join x on x.name = n.name left join a on a.name = n.name and a.length = n.length""")
def _(fx):
    return ct.resolve_contigs(fx.doc_lengths.select(F.col("chrom").alias("name"), "length"), _catalogue(fx),
                              require_length=True)


@query("unmatched_contigs", "doc_lengths",
       "with " + RESOLVED.format(len="") +
       """ select n.name from n left join x on x.name = n.name left join a on a.name = n.name
           where x.chrom is null and coalesce(a.hits, 0) <> 1""")
def _(fx):
    return ct.unmatched_contigs(fx.doc_lengths.select(F.col("chrom").alias("name")), _catalogue(fx))


@query("same_sequence_set", "contigs",
       """select 'self' as label, true as same union all
          select 'edited', not exists (select 1 from contigs where doc_id % 10 = 1)""")
def _(fx):
    c = fx.contigs.select("chrom", "doc_id", "seq")
    edited = c.withColumn("seq", F.when(F.expr("doc_id % 10 = 1"), F.concat("seq", F.lit("A"))).otherwise(F.col("seq")))
    return ct.same_sequence_set(c, c).select(F.lit("self").alias("label"), "same").unionByName(
        ct.same_sequence_set(c, edited).select(F.lit("edited").alias("label"), "same"))


@query("check_coordinate_sorted", "variants",
       """with m as (select event_id, cast(substr(chrom, 4) as int) as ref_id, start_bp from variants
            where event_id % 9 <> 0)
          select event_id, prev_ref, prev_start from (select event_id, ref_id, start_bp,
            lag(ref_id) over (order by event_id) as prev_ref, lag(start_bp) over (order by event_id) as prev_start
            from m) where ref_id < prev_ref or (ref_id = prev_ref and start_bp < prev_start)""")
def _(fx):
    rows = fx.variants.select(
        "event_id", F.expr("case when event_id % 9 = 0 then 4 else 0 end").alias("flags"),
        F.expr("cast(substr(chrom, 4) as int)").alias("ref_id"), "start_bp")
    return ct.check_coordinate_sorted(rows, "event_id", step=1024).select("event_id", "prev_ref", "prev_start")


SEGMENTS = """lens as (select genome, ord, chrom, doc_id, cast(length(seq) as int) as length from cmp_contigs),
 seg as (select genome, ord, chrom, doc_id, length, row_number() over w - 1 as seg_idx,
   coalesce(sum(length + 50) over (partition by genome order by doc_id rows between unbounded preceding and 1 preceding), 0)
     as start_bp from lens window w as (partition by genome order by doc_id)),
 segments as (select *, start_bp + length as end_bp, doc_id % 4 = 2 as reversed, doc_id % 6 as feature_count from seg)"""


def segments(fx):
    """Concatenation layout of the comparison genomes, every fourth contig reversed."""
    lens = fx.cmp_contigs.select("genome", "ord", "chrom", "doc_id", F.length("seq").alias("length"))
    return ct.concat_layout(lens, "doc_id").withColumns(
        {"reversed": F.expr("doc_id % 4 = 2"), "feature_count": F.expr("doc_id % 6")})


@query("genome_info", "cmp_contigs",
       "with " + SEGMENTS + """ select genome, cast(max(end_bp) as bigint) as length, count(*) as n_segments,
         cast(sum(feature_count) as bigint) as n_features from segments group by genome""")
def _(fx):
    return ct.genome_info(segments(fx))


@query("concat_layout", "cmp_contigs",
       "with " + SEGMENTS + """ select genome, chrom, seg_idx, cast(start_bp as bigint) as start_bp,
         cast(end_bp as bigint) as end_bp from segments""")
def _(fx):
    return segments(fx).select("genome", "chrom", "seg_idx", "start_bp", "end_bp")


@query("reorder_contigs", "doc_lengths",
       """with r as (select chrom, row_number() over (order by chrom) - 1 as rank0 from doc_lengths),
            m as (select rank0 as f, (select count(*) - 1 from r) as l from r where chrom = 'doc7')
          select chrom, rank0 as contig_id, case when chrom = 'doc7' then l when rank0 > f then rank0 - 1 else rank0 end
            as rank from r, m""")
def _(fx):
    base = ct.list_contigs(fx.doc_lengths).select("chrom", "contig_id", F.col("contig_id").alias("rank"))
    return ct.reorder_contigs(base, "doc7", "end")


@query("adjacent_pairs", "cmp_contigs",
       """select * from (select genome as q_genome, lead(genome) over (order by ord) as t_genome,
            row_number() over (order by ord) - 1 as pair_id from (select distinct genome, ord from cmp_contigs))
          where t_genome is not null""")
def _(fx):
    return ct.adjacent_pairs(fx.cmp_contigs.select("genome", "ord").distinct(), "ord")
