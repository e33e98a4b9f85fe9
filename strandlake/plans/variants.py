"""G1-G13 over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import variants as va
from strandlake.plans.registry import query
from strandlake.plans.scalar import IUPAC_SQL

KIND = """case when ref = '' or alt = '' then 'unknown'
  when regexp_matches(alt, '(^|,)<') or regexp_matches(alt, '[\\[\\]]') then 'symbolic' when contains(alt, ',') then 'complex'
  when length(ref) = 1 and length(alt) = 1 then 'snp' when length(ref) = length(alt) then 'mnp'
  when length(ref) < length(alt) and starts_with(alt, ref) then 'insertion'
  when length(ref) > length(alt) and starts_with(ref, alt) then 'deletion' else 'complex' end"""
# Multi-ALT shapes that G2 can refine; the base table has only A,T.
MORE = """(select id, start_bp, case when sel = 1 then 'GTA' else ref end as ref, case when sel = 1 then 'G'
  when sel = 2 then concat(ref, 'A,', ref, 'CC') when sel = 3 then concat(ref, '[ctg1:5[') else alt end as alt from variants)"""
SHOWN = """case when kind <> 'complex' then kind
  when length(ref) = 1 and len(list_filter(string_split(alt, ','), lambda x: length(x) <> 1)) = 0 then 'snp'
  when len(list_filter(string_split(alt, ','), lambda x: not (length(x) > length(ref) and starts_with(x, ref)))) = 0 then 'insertion'
  when length(ref) > 1 and len(list_filter(string_split(alt, ','), lambda x: not (length(x) = 1 and starts_with(ref, x)))) = 0
    then 'deletion' else kind end"""


def _more(fx):
    return fx.variants.select(
        "id", "start_bp", F.expr("case when sel = 1 then 'GTA' else ref end").alias("ref"),
        F.expr("""case when sel = 1 then 'G' when sel = 2 then concat(ref, 'A,', ref, 'CC')
                  when sel = 3 then concat(ref, '[ctg1:5[') else alt end""").alias("alt"))


@query("classify_variant", "variants", f"select id, {KIND} as kind from {MORE}")
def _(fx):
    return _more(fx).select("id", va.classify_variant("ref", "alt").alias("kind"))


@query("display_kind", "variants", f"select id, {SHOWN} as shown from (select *, {KIND} as kind from {MORE})")
def _(fx):
    return _more(fx).select("id", va.display_kind(va.classify_variant("ref", "alt"), "ref", "alt").alias("shown"))


@query("variant_label", "variants",
       f"""with s as (select *, {SHOWN} as shown from (select *, {KIND} as kind from {MORE}))
           select id, case when not contains(alt, ',') and shown = 'insertion' and length(alt) > length(ref)
               then 'Insertion (' || (length(alt) - length(ref)) || 'bp)'
             when not contains(alt, ',') and shown = 'deletion' and length(ref) > length(alt)
               then 'Deletion (' || (length(ref) - length(alt)) || 'bp)'
             else case shown when 'snp' then 'SNP' when 'mnp' then 'MNP' when 'unknown' then 'Variant'
               else upper(left(shown, 1)) || substr(shown, 2) end end as label from s""")
def _(fx):
    return _more(fx).select("id", va.variant_label(va.classify_variant("ref", "alt"), "ref", "alt").alias("label"))


@query("indel_anchors", "variants",
       f"""with v as (select *, start_bp + length(ref) as end_bp from {MORE}),
           d as (select *, case when length(ref) > length(alt) and alt <> '' and not contains(alt, ',') then
             case when starts_with(ref, alt) then start_bp + length(alt) when ends_with(ref, alt) then start_bp end end as del_start,
             case when length(ref) > length(alt) and alt <> '' and not contains(alt, ',') then
             case when starts_with(ref, alt) then end_bp when ends_with(ref, alt) then end_bp - length(alt) end end as de,
             case when ref <> '' and length(alt) > length(ref) and not contains(alt, ',') then
             case when starts_with(alt, ref) then start_bp + length(ref) when ends_with(alt, ref) then start_bp end end as ins_point
             from v)
           select id, del_start, case when del_start is not null then greatest(del_start + 1, de) end as del_end, ins_point from d""")
def _(fx):
    v = _more(fx).withColumn("end_bp", F.col("start_bp") + F.length("ref"))
    s, e = va.deletion_span("ref", "alt", "start_bp", "end_bp")
    return v.select("id", s.alias("del_start"), e.alias("del_end"),
                    va.insertion_point("ref", "alt", "start_bp").alias("ins_point"))


GT = """gl as (select *, string_split(replace(gt, '|', '/'), '/') as p from genotypes),
  ga as (select *, case when regexp_full_match(gt, '[0-9]+([/|][0-9]+)*') then [cast(x as int) for x in p if x <> '.'] end as a,
    list_concat([ref], string_split(alt, ',')) as names from gl),
  gc as (select *, case when a is null or list_max(a) >= len(names) then 'missing' when list_min(a) = list_max(a) and a[1] = 0
      then 'ref' when list_min(a) = list_max(a) then 'hom_alt' else 'het' end as gt_class from ga),
  gx as (select *, case gt_class when 'missing' then '' when 'het' then array_to_string([names[i + 1] for i in a], '/')
      else names[a[1] + 1] end as gt_text, coalesce(list_max(a) > 0, false) as has_alt from gc)"""


@query("parse_gt", "genotypes", "with " + GT + " select id, sample, array_to_string(a, ',') as alleles from gx")
def _(fx):
    g = va.genotypes_long(fx.vcf)
    return g.select("id", "sample", F.array_join(va.parse_gt("gt").cast("array<string>"), ",").alias("alleles"))


@query("genotype_class", "genotypes", "with " + GT + " select id, sample, gt_class, gt_text from gx")
def _(fx):
    return va.genotypes_long(fx.vcf).select("id", "sample", "gt_class", "gt_text")


@query("sample_has_alt", "genotypes", "with " + GT + " select id, sample, has_alt from gx")
def _(fx):
    return va.genotypes_long(fx.vcf).select("id", "sample", "has_alt")


@query("genotypes_long", "genotypes",
       "with " + GT + """ select cast(right(source, 1) as int) * 3 + sample_idx as row_index, source, sample, id, chrom,
         start_bp, gt from gx""")
def _(fx):
    rows = va.sample_rows(va.list_variant_sources(fx.vcf)).select("row_index", "source", "sample")
    g = va.genotypes_long(fx.vcf)
    return g.join(rows, ["source", "sample"]).select("row_index", "source", "sample", "id", "chrom", "start_bp", "gt")


@query("variant_tiles", "variants",
       """select source, chrom, tile, id from (select *, unnest(generate_series(start_bp // 1024,
            (start_bp + length(ref) - 1) // 1024)) as tile from variants)""")
def _(fx):
    return va.variant_tiles(fx.vcf, zoom=0).select("source", "chrom", "tile", "id")


@query("variants_in_windows", "variants genes",
       """select v.id, g.gkey as win_id from variants v join genes g on g.chrom = v.chrom and v.start_bp < g.end_bp
          and v.start_bp + length(v.ref) > g.start_bp""")
def _(fx):
    w = fx.genes.select(F.col("gkey").alias("win_id"), "chrom", F.col("start_bp").alias("r_start"), F.col("end_bp").alias("r_end"))
    return va.variants_in_windows(fx.vcf, w).select("id", "win_id")


@query("variant_detail", "genotypes",
       "with " + GT + f""", k as (select distinct source, chrom, start_bp, ref, alt from gx where qual > 20)
         select gx.id, gx.info, {KIND.replace('ref', 'gx.ref').replace('alt', 'gx.alt')} as kind, sample,
           'GT=' || gt || '  DP=' || dp as sample_text, has_alt from gx join k using (source, chrom, start_bp, ref, alt)""")
def _(fx):
    return va.variant_detail(fx.vcf, fx.vcf.where("qual > 20")).select("id", "info", "kind", "sample", "sample_text", "has_alt")


@query("list_variant_sources", "variants",
       """select source, row_number() over (order by source) - 1 as source_id, 's0,s1,s2' as sample_names
          from (select distinct source from variants)""")
def _(fx):
    return va.list_variant_sources(fx.vcf).withColumn("sample_names", F.array_join("sample_names", ","))


@query("genotype_class_counts", "genotypes",
       "with " + GT + """ select chrom, sample, count(*) filter (where gt_class = 'missing') as n_missing,
         count(*) filter (where gt_class = 'ref') as n_ref, count(*) filter (where gt_class = 'het') as n_het,
         count(*) filter (where gt_class = 'hom_alt') as n_hom_alt from gx group by 1, 2""")
def _(fx):
    return va.genotype_class_counts(va.genotypes_long(fx.vcf), by=["chrom", "sample"])


@query("apply_orientation_variants", "genotypes",
       "with " + GT + f""" select id, sample, case when flip then 100000 - end_bp else start_bp end as start_bp,
           case when flip then 100000 - start_bp else end_bp end as end_bp, kind,
           case when flip then {IUPAC_SQL.format('ref')} else ref end as ref,
           case when flip then array_to_string([{IUPAC_SQL.format('a')} for a in string_split(alt, ',')], ',') else alt end as alt,
           case when flip and gt_text not in ('', '.') then array_to_string([{IUPAC_SQL.format('a')} for a in
             string_split(gt_text, '/')], '/') else gt_text end as gt_text
         from (select *, chrom in ('ctg2', 'ctg3') as flip, {KIND} as kind from (select * exclude (a) from gx))""")
def _(fx):
    o = fx.ctg_lengths.withColumn("reversed", F.col("chrom").isin("ctg2", "ctg3"))
    g = va.genotypes_long(fx.vcf).withColumn("kind", va.classify_variant("ref", "alt"))
    return va.apply_orientation_variants(g, o).select("id", "sample", "start_bp", "end_bp", "kind", "ref", "alt", "gt_text")
