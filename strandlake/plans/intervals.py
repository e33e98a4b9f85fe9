"""E1-E11 over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions.annotation import feature_name
from strandlake.operators import interval as iv
from strandlake.plans.catalog import SEGMENTS, segments
from strandlake.plans.registry import query
from strandlake.plans.scalar import NAME_SQL

ORD = "start_bp, end_bp, type, strand, attributes"


@query("overlap_join", "reads features",
       """select f.attributes, f.start_bp, count(*) as n, cast(sum(r.start_bp) as bigint) as start_sum
          from features f join reads r on f.chrom = r.chrom and f.start_bp < r.end_bp and f.end_bp > r.start_bp
          group by 1, 2""")
def _(fx):
    right = fx.reads.select("chrom", F.col("start_bp").alias("r_start"), F.col("end_bp").alias("r_end"))
    pairs = iv.overlap_join(fx.features, right)
    return pairs.groupBy("attributes", "start_bp").agg(F.count("*").alias("n"), F.sum("r_start").alias("start_sum"))


WINDOWS = "(select event_id as win_id, chrom, start_bp as r_start, start_bp + 700 as r_end from variants)"


IN_WINDOW = f"""select win_id, attributes, start_bp, rank from (select w.win_id, f.attributes, f.start_bp,
             row_number() over (partition by f.chrom, w.win_id order by {ORD}) as rank
           from features f join {WINDOWS} w on f.chrom = w.chrom and f.start_bp < w.r_end and f.end_bp > w.r_start
           where f.end_bp - f.start_bp >= {{least}})"""


def variant_windows(fx):
    return fx.variants.select(F.col("event_id").alias("win_id"), "chrom", F.col("start_bp").alias("r_start"),
                              (F.col("start_bp") + 700).alias("r_end"))


@query("features_in_window", "features variants", IN_WINDOW.format(least=1))
def _(fx):
    return iv.features_in_window(fx.features, variant_windows(fx)).select("win_id", "attributes", "start_bp", "rank")


@query("features_in_window_first", "features variants", IN_WINDOW.format(least=80) + " where rank <= 10")
def _(fx):
    first = iv.features_in_window(fx.features, variant_windows(fx), min_length=80, limit=10)
    return first.select("win_id", "attributes", "start_bp", "rank")


TILES = f"""select chrom, tile, attributes, start_bp, rank from (select *, row_number() over
             (partition by chrom, tile order by {ORD}) as rank from (select *, unnest(generate_series(start_bp // 4096,
               (end_bp - 1) // 4096)) as tile from features where end_bp - start_bp >= {{least}}))"""


@query("annotation_tiles", "features", TILES.format(least=1))
def _(fx):
    return iv.annotation_tiles(fx.features, zoom=2).select("chrom", "tile", "attributes", "start_bp", "rank")


@query("annotation_tiles_first", "features", TILES.format(least=60) + " where rank <= 50")
def _(fx):
    return iv.annotation_tiles(fx.features, zoom=2, min_length=60, limit=50).select(
        "chrom", "tile", "attributes", "start_bp", "rank")


@query("dedupe_features", "features",
       f"""select chrom, start_bp, end_bp, strand, type, name, min(attributes) as attributes from
           (select *, {NAME_SQL} as name from (select * from features union all
              select chrom, source, type, start_bp, end_bp, strand, phase, attributes || ';copy=1' from features))
           group by 1, 2, 3, 4, 5, 6, source""")
def _(fx):
    f = fx.features
    twice = f.unionByName(f.withColumn("attributes", F.concat("attributes", F.lit(";copy=1"))))
    named = twice.withColumn("name", feature_name("attributes", "type")).drop("phase")
    return iv.dedupe_features(named).select("chrom", "start_bp", "end_bp", "strand", "type", "name", "attributes")


@query("spread_sample", "features",
       f"""with b as (select *, (least(greatest(start_bp, 0), 99999)) // 200 as bin from features),
           r as (select *, row_number() over (partition by chrom, bin order by {ORD}) > 1 as overflow from b)
           select chrom, attributes, start_bp, overflow, rank from (select *, row_number() over
             (partition by chrom order by overflow, {ORD}) as rank from r) where rank <= 500""")
def _(fx):
    return iv.spread_sample(fx.features, cap=500, view_start=0, view_end=100000).select(
        "chrom", "attributes", "start_bp", "overflow", "rank")


COLLAPSE = """with f as (select *, trim(regexp_extract(attributes, '(?:^|;)ID=([^;]*)', 1)) as fid,
    trim(regexp_extract(attributes, '(?:^|;)Parent=([^;]*)', 1)) as parent, lower(type) as kind from features),
  g as (select * from f where kind = 'gene'),
  pk as (select chrom, strand, start_bp, end_bp, source, max(struct_pack(a := attributes, i := fid)).i as pg
         from g group by 1, 2, 3, 4, 5),
  par as (select fid, max(parent) as gp from f where fid <> '' group by 1),
  k as (select f.*, par.gp from f left join par on par.fid = f.parent where f.parent <> ''),
  c as (select k.*, coalesce(g1.fid, g2.fid, pk.pg) as gene from k left join g g1 on g1.fid = k.parent
        left join g g2 on g2.fid = k.gp
        left join pk on pk.chrom = k.chrom and pk.strand = k.strand and pk.start_bp = k.start_bp
          and pk.end_bp = k.end_bp and pk.source = k.source where k.kind = 'cds'),
  pg as (select gene, count(*) as n_parts from c where gene is not null group by 1),
  m as (select gene from pg where n_parts > 1)"""


@query("collapse_gene_cds", "features", COLLAPSE + """
  select g.attributes, g.start_bp, coalesce(n_parts, 0) as n_parts from g left join pg on pg.gene = g.fid
  union all select attributes, start_bp, 0 from c where gene is null
    and parent not in (select gene from m) and coalesce(gp, '') not in (select gene from m)
  union all select attributes, start_bp, 0 from k where kind not in ('gene', 'cds')
    and parent not in (select gene from m) and coalesce(gp, '') not in (select gene from m)
  union all select attributes, start_bp, 0 from f where kind <> 'gene' and parent = ''""")
def _(fx):
    return iv.collapse_gene_cds(fx.features).select("attributes", "start_bp", "n_parts")


@query("gene_cds_parts", "features", COLLAPSE + """ select gene, attributes, start_bp, row_number() over
  (partition by gene order by start_bp, end_bp, attributes) as part_no from c where gene is not null""")
def _(fx):
    return iv.gene_cds_parts(fx.features).select("gene", "attributes", "start_bp", "part_no")


@query("search_annotations", "features",
       f"""select attributes, start_bp from features where contains(lower(concat_ws(' ', {NAME_SQL},
             trim(regexp_extract(attributes, '(?:^|;)ID=([^;]*)', 1)), type, source, chrom)), 'urgent')
           """)
def _(fx):
    return iv.search_annotations(fx.features, "URGENT").select("attributes", "start_bp")


@query("hide_full_length_regions", "features",
       """select chrom, type, count(*) as n from features where not (lower(type) in ('region', 'source')
            and start_bp <= 0 and end_bp >= 100000) group by 1, 2""")
def _(fx):
    return iv.hide_full_length_regions(fx.features, fx.ctg_lengths).groupBy("chrom", "type").agg(F.count("*").alias("n"))


@query("to_concat_coords", "features",
       """with l as (select chrom, 100050 * (row_number() over (order by cast(substr(chrom, 4) as int)) - 1) as off
            from (select distinct chrom from features))
          select f.attributes, cast(f.start_bp + l.off as bigint) as start_bp, cast(f.end_bp + l.off as bigint) as end_bp
          from features f join l on l.chrom = f.chrom""")
def _(fx):
    from strandlake.operators.catalog import concat_layout

    lens = fx.ctg_lengths.withColumns({"genome": F.lit("g"), "ord": F.expr("cast(substr(chrom, 4) as int)")})
    return iv.to_concat_coords(fx.features, concat_layout(lens, "ord")).select("attributes", "start_bp", "end_bp")


WIN = """w as (select distinct genome, ord as win_id, cast(k * 1500 as bigint) as w_start,
  cast(k * 1500 + 2500 as bigint) as w_end from (select distinct genome, ord from cmp_contigs),
  (select unnest(generate_series(0, 3)) as k)
  union all select distinct genome, ord, cast(p as bigint), cast(p + d as bigint) from cmp_contigs,
  (select unnest([5, 1000, 100000000]) as p), (select unnest([0, -3]) as d))"""


def _windows(fx):
    g = fx.cmp_contigs.select("genome", "ord").distinct()
    k = g.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    wide = k.select("genome", F.col("ord").alias("win_id"), (F.col("k") * 1500).cast("bigint").alias("w_start"),
                    (F.col("k") * 1500 + 2500).cast("bigint").alias("w_end"))
    # Points and intervals given backwards.
    p = g.withColumn("p", F.explode(F.array(*map(F.lit, (5, 1000, 100000000))))).withColumn("d", F.explode(F.array(F.lit(0), F.lit(-3))))
    return wide.unionByName(p.select("genome", F.col("ord").alias("win_id"), F.col("p").cast("bigint").alias("w_start"),
                                     (F.col("p") + F.col("d")).cast("bigint").alias("w_end")))


@query("concat_windows_to_contigs", "cmp_contigs",
       "with " + SEGMENTS + ", " + WIN + """ select w.genome, w.w_start, s.chrom,
          cast(greatest(w_start, s.start_bp) - s.start_bp as bigint) as local_start,
          cast(least(w_end, s.end_bp) - s.start_bp as bigint) as local_end
          from w join segments s on s.genome = w.genome and s.start_bp < w.w_end and s.end_bp > w.w_start where w_end > w_start""")
def _(fx):
    return iv.concat_windows_to_contigs(_windows(fx).where("w_end > w_start"), segments(fx), bin_size=4096).select(
        "genome", "w_start", "chrom", "local_start", "local_end")


@query("to_contig_coords", "cmp_contigs",
       "with " + SEGMENTS + ", " + WIN + """, v as (select *, least(w_start, w_end) as a, greatest(w_start, w_end) as b from w),
          o as (select v.*, s.chrom, s.start_bp, s.length, row_number() over (partition by v.genome, v.w_start, v.w_end order by
              least(b, s.end_bp) - greatest(a, s.start_bp) desc, s.start_bp) as rk
          from v join segments s on s.genome = v.genome and s.start_bp <= v.b and s.end_bp >= v.a)
          select v.genome, v.w_start, v.w_end, o.chrom as contig,
            case when o.chrom is not null then cast(least(greatest(v.a - o.start_bp, 0), o.length) as bigint) end as local_start,
            case when o.chrom is not null then cast(least(greatest(v.b - o.start_bp, 0), o.length) as bigint) end as local_end
          from v left join o on o.genome = v.genome and o.w_start = v.w_start and o.w_end = v.w_end and rk = 1""")
def _(fx):
    return iv.to_contig_coords(_windows(fx), segments(fx), id_cols=("win_id", "w_start", "w_end"), bin_size=4096).select(
        "genome", "w_start", "w_end", "contig", "local_start", "local_end")


@query("apply_orientation_features", "features",
       """select attributes, case when chrom in ('ctg1', 'ctg4') then 100000 - end_bp else start_bp end as start_bp,
            case when chrom in ('ctg1', 'ctg4') then 100000 - start_bp else end_bp end as end_bp,
            case when chrom in ('ctg1', 'ctg4') then translate(strand, '+-', '-+') else strand end as strand
          from features""")
def _(fx):
    o = fx.ctg_lengths.withColumn("reversed", F.col("chrom").isin("ctg1", "ctg4"))
    return iv.apply_orientation_features(fx.features, o).select("attributes", "start_bp", "end_bp", "strand")
