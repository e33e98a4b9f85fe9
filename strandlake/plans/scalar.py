"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import annotation as an, cigar as cg, coords as co, dna

from strandlake.plans.registry import query

CODONS = """codons as (select chrom, substr(seq, 3 * i + 1, 3) as codon
  from (select chrom, seq, unnest(generate_series(0, length(seq) // 3 - 1)) as i from contigs))"""
AA_CASE = "case codon " + " ".join(
    f"when '{c}' then '{aa}'" for aa, cs in dna.STANDARD_CODE.items() for c in cs.split()) + " else 'X' end"


def codons(fx):
    """Non-overlapping codons of every contig; binary substring is constant time."""
    raw = fx.contigs.select("chrom", F.encode("seq", "UTF-8").alias("b"), F.length("seq").alias("n"))
    return raw.where("n >= 3").select(
        "b", F.explode(F.expr("sequence(0, n div 3 - 1)")).alias("i")
    ).select(F.decode(F.expr("substring(b, 3 * i + 1, 3)"), "UTF-8").alias("codon"))


@query("normalize_base", "documents",
       """select base, count(*) as n from (select case when upper(c) = 'U' then 'T'
            when upper(c) in ('A','C','G','T','N') then upper(c) end as base
          from (select unnest(string_split(text, '')) as c from documents)) group by base""")
def _(fx):
    chars = fx.documents.repartition(fx.spark.sparkContext.defaultParallelism).select(
        F.explode(F.split("text", "")).alias("c"))
    return chars.select(dna.normalize_base("c").alias("base")).groupBy("base").agg(F.count("*").alias("n"))


@query("normalize_dna", "documents",
       """select doc_id, md5(regexp_replace(translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'U', 'T'),
          '[^ACGT]', 'N', 'g')) as digest from documents""")
def _(fx):
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    return fx.documents.select("doc_id", F.md5(dna.normalize_dna(letters)).alias("digest"))


@query("revcomp_strict", "contigs",
       """select chrom, case when not contains(replace(seq, 'N', ''), 'N') and regexp_full_match(seq, '[ACGT]*')
            then md5(reverse(translate(seq, 'ACGT', 'TGCA'))) end as strict,
          md5(reverse(translate(replace(seq, 'N', ''), 'ACGT', 'TGCA'))) as clean from contigs""")
def _(fx):
    return fx.contigs.select(
        "chrom", F.md5(dna.revcomp_strict("seq")).alias("strict"),
        F.md5(dna.revcomp_strict(F.replace("seq", F.lit("N"), F.lit("")))).alias("clean"))


@query("revcomp", "documents",
       """select doc_id, md5(reverse(translate(regexp_replace(regexp_replace(text, '[^A-Za-z]', '', 'g'),
            '[^ACGT]', 'N', 'g'), 'ACGT', 'TGCA'))) as digest from documents""")
def _(fx):
    return fx.documents.select("doc_id", F.md5(dna.revcomp(F.regexp_replace("text", "[^A-Za-z]", ""))).alias("digest"))


IUPAC_SQL = ("case when regexp_full_match(upper({0}), '[ACGTURYSWKMBDHVN]*') then "
             "reverse(translate(upper({0}), 'ACGTURYSWKMBDHVN', 'TGCAAYRSWMKVHDBN')) else {0} end")


@query("revcomp_iupac", "documents",
       f"""with w as (select unnest(string_split_regex(text, '[^A-Za-z<>]+')) as word from documents)
           select word, rc, count(*) as n from (select word, {IUPAC_SQL.format('word')} as rc from w)
           group by word, rc""")
def _(fx):
    words = fx.documents.select(F.explode(F.split("text", "[^A-Za-z<>]+")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).select("word", dna.revcomp_iupac("word").alias("rc"), "n")


@query("revcomp_alts", "variants",
       f"""select id, alt, array_to_string([{IUPAC_SQL.format('a')} for a in string_split(alt, ',')], ',') as rc
           from variants""")
def _(fx):
    return fx.variants.select("id", "alt", dna.revcomp_alts("alt").alias("rc"))


@query("revcomp_genotype_text", "variants",
       f"""with t as (select id, case sel when 0 then '' when 1 then '.' else replace(alt, ',', '/') || '/' || ref end
             as txt from variants)
           select id, txt, case when txt in ('', '.') then txt else
             array_to_string([{IUPAC_SQL.format('a')} for a in string_split(txt, '/')], '/') end as rc from t""")
def _(fx):
    txt = F.expr("case sel when 0 then '' when 1 then '.' else concat(replace(alt, ',', '/'), '/', ref) end")
    return fx.variants.select("id", txt.alias("txt")).withColumn("rc", dna.revcomp_genotype_text("txt"))


@query("translate_codon", "contigs",
       f"with {CODONS} select codon, {AA_CASE} as aa, count(*) as n from codons group by codon")
def _(fx):
    return codons(fx).groupBy("codon").agg(F.count("*").alias("n")).select(
        "codon", dna.translate_codon("codon").alias("aa"), "n")


@query("is_stop_codon", "contigs",
       f"with {CODONS} select codon in ('TAA','TAG','TGA') as stop, count(*) as n from codons group by 1")
def _(fx):
    return codons(fx).groupBy(dna.is_stop_codon("codon").alias("stop")).agg(F.count("*").alias("n"))


PACKED = " + ".join(
    f"(strpos('ACGT', substr(k, {i}, 1)) - 1) * {4 ** (15 - i)}::bigint" for i in range(1, 16))


@query("kmer_key", "contigs",
       f"""with k as (select chrom, substr(seq, p + 1, 15) as k from
             (select chrom, seq, unnest(generate_series(0, length(seq) - 15)) as p from contigs))
           select chrom, count(*) as n, cast(sum({PACKED}) as bigint) as key_sum, max({PACKED}) as key_max
           from k where not contains(k, 'N') group by chrom""")
def _(fx):
    from strandlake.operators.sequence import kmers, seq_chunks

    ks = kmers(seq_chunks(fx.contigs, overlap=14), 15)
    return ks.where("key is not null").groupBy("chrom").agg(
        F.count("*").alias("n"), F.sum("key").alias("key_sum"), F.max("key").alias("key_max"))


BAD_CIGAR = "case when okey % 13 = 0 then concat(cigar, '7') else cigar end"


@query("parse_cigar", "alignments",
       f"""with c as (select {BAD_CIGAR} as c from alignments),
           o as (select unnest(regexp_extract_all(c, '[0-9]+[^0-9]')) as t from c
                 where regexp_full_match(c, '([0-9]+[^0-9])*'))
           select right(t, 1) as op, count(*) as n, cast(sum(cast(left(t, length(t) - 1) as int)) as bigint) as bases
           from o group by 1""")
def _(fx):
    ops = fx.alignments.select(F.explode(cg.parse_cigar(F.expr(BAD_CIGAR))).alias("o"))
    return ops.groupBy(F.col("o.op").alias("op")).agg(
        F.count("*").alias("n"), F.sum("o.len").alias("bases"))


@query("reverse_cigar", "alignments",
       f"""select okey, rn, case when regexp_full_match(c, '([0-9]+[^0-9])*')
             then array_to_string(list_reverse(regexp_extract_all(c, '[0-9]+[^0-9]')), '') else c end as rev
           from (select okey, rn, {BAD_CIGAR} as c from alignments)""")
def _(fx):
    return fx.alignments.select("okey", "rn", cg.reverse_cigar(F.expr(BAD_CIGAR)).alias("rev"))


@query("gff_attribute", "features",
       """select attributes, coalesce(
            case when regexp_matches(attributes, '(^|;)Parent=') then
              trim(regexp_extract(attributes, '(?:^|;)Parent=([^;]*)', 1)) end,
            case when regexp_matches(attributes, '(^|;)Name=') then
              trim(regexp_extract(attributes, '(?:^|;)Name=([^;]*)', 1)) end, '') as value from features""")
def _(fx):
    return fx.features.select("attributes", an.gff_attribute("attributes", "Parent", "Name").alias("value"))


NAME_SQL = "coalesce({}, type)".format(", ".join(
    f"nullif(trim(regexp_extract(attributes, '(?:^|;){k}=([^;]*)', 1)), '')" for k in an.NAME_KEYS))


@query("feature_name", "features", f"select attributes, type, {NAME_SQL} as name from features")
def _(fx):
    return fx.features.select("attributes", "type", an.feature_name("attributes", "type").alias("name"))


LOC_TEXT = """case cast(gkey % 4 as int) when 0 then concat(cast(start_bp + 1 as varchar(9)), '..', cast(end_bp as varchar(9)))
  when 1 then concat('complement(<', cast(start_bp + 1 as varchar(9)), '..>', cast(end_bp as varchar(9)), ')')
  when 2 then concat('join(', cast(start_bp + 1 as varchar(9)), '..', cast(start_bp + 20 as varchar(9)), ',',
    cast(end_bp - 5 as varchar(9)), '..', cast(end_bp as varchar(9)), ')')
  else 'unknown' end"""


@query("parse_location", "genes",
       f"""with l as (select gkey, {LOC_TEXT} as loc from genes),
           n as (select gkey, loc, [cast(x as int) for x in regexp_extract_all(loc, '[0-9]+')] as nums from l)
           select gkey, loc, coalesce(greatest(list_min(nums) - 1, 0), 0) as lo, coalesce(list_max(nums), 0) as hi from n""")
def _(fx):
    lo, hi = an.parse_location("loc")
    return fx.genes.select("gkey", F.expr(LOC_TEXT).alias("loc")).select("gkey", "loc", lo.alias("lo"), hi.alias("hi"))


QUAL_TEXT = """case when o_orderkey % 3 = 0 then '/pseudo' when o_orderkey % 3 = 1
  then concat('FT      /note="', o_orderpriority, '"') else concat('  /id=', cast(o_orderkey as varchar(20))) end"""


@query("parse_qualifier", "orders",
       """select o_orderkey, case when o_orderkey % 3 = 0 then 'pseudo'
            when o_orderkey % 3 = 1 then concat('note=', o_orderpriority)
            else concat('id=', cast(o_orderkey as varchar(20))) end as q from orders""")
def _(fx):
    return fx.orders.select("o_orderkey", an.parse_qualifier(F.expr(QUAL_TEXT)).alias("q"))


@query("mean_depth_bin", "lineitem",
       """with s as (select l_suppkey, l_linenumber, count(*) * 1000 as total, cast(max(l_quantity) as int) as width
            from lineitem group by 1, 2)
          select l_suppkey, l_linenumber, least(greatest(cast(round(total / width) as int),
            case when total > 0 then 1 else 0 end)) as depth,
            case when width > 0 then 1 else 0 end as tiny from s""")
def _(fx):
    s = fx.lineitem.groupBy("l_suppkey", "l_linenumber").agg(
        (F.count("*") * 1000).alias("total"), F.max("l_quantity").cast("int").alias("width"))
    return s.select("l_suppkey", "l_linenumber", co.mean_depth_bin("total", "width").alias("depth"),
                    co.mean_depth_bin(F.lit(1), F.col("width") * 100).alias("tiny"))


@query("entity_keys", "features reads cmp_blocks",
       f"""select concat_ws('|', chrom, start_bp, end_bp, {NAME_SQL}, type) as k from features
           union all select concat_ws('|', name, start_bp, end_bp, case when (flags & 16) <> 0 then 1 else 0 end, flags) from reads
           union all select concat_ws('|', q_genome, t_genome, q_start, q_end, t_start, t_end, same_strand::int) from cmp_blocks""")
def _(fx):
    f = fx.features.select(co.feature_key(an.feature_name("attributes", "type")).alias("k"))
    return f.unionByName(fx.reads.select(co.read_key().alias("k"))).unionByName(fx.cmp_blocks.select(co.block_key().alias("k")))


@query("tile_of", "reads",
       """select z, tile, tile * w as tile_start, (tile + 1) * w as tile_end, count(*) as n from
            (select z, 1024 << z as w, start_bp // (1024 << z) as tile from reads, (select unnest([0, 3, 6]) as z))
          group by z, tile, w""")
def _(fx):
    tiles = F.array(*[F.struct(F.lit(z).alias("z"), co.tile_of("start_bp", z).alias("tile")) for z in (0, 3, 6)])
    t = fx.reads.select(F.explode(tiles).alias("t")).groupBy("t.z", "t.tile").agg(F.count("*").alias("n"))
    width = F.expr("shiftleft(1024, z)")
    return t.select("z", "tile", (F.col("tile") * width).alias("tile_start"),
                    ((F.col("tile") + 1) * width).alias("tile_end"), "n")


@query("zoom_for", "orders",
       """select o_orderkey, least(greatest(cast(round(log2(greatest(o_totalprice / 1000, 0.001))) as int), 0), 16) as zoom
          from orders""")
def _(fx):
    return fx.orders.select("o_orderkey", co.zoom_for(F.col("o_totalprice") / 1000).alias("zoom"))


@query("flip_interval", "genes",
       """select gkey, 100000 - end_bp as start_bp, 100000 - start_bp as end_bp, 99999 - start_bp as point,
            translate(strand, '+-', '-+') as strand from genes""")
def _(fx):
    s, e = co.flip_interval("start_bp", "end_bp", F.lit(100000))
    return fx.genes.select("gkey", s.alias("start_bp"), e.alias("end_bp"),
                           co.flip_point("start_bp", F.lit(100000)).alias("point"),
                           co.flip_strand("strand").alias("strand"))


@query("clamp_window", "genes",
       """select gkey, least(greatest(start_bp - 500, 0), 50000) as s,
            greatest(least(greatest(start_bp - 500, 0), 50000), least(greatest(end_bp, 0), 50000)) as e from genes""")
def _(fx):
    s, e = co.clamp_window(F.col("start_bp") - 500, "end_bp", F.lit(50000))
    return fx.genes.select("gkey", s.alias("s"), e.alias("e"))


@query("feature_frame", "features",
       """select attributes, start_bp, case when lower(type) not in ('cds', 'gene') then -1
            when strand = '-' then ((end_bp - (case when phase between 0 and 2 then phase else 0 end) - 3) % 3 + 3) % 3 + 3
            else (start_bp + (case when phase between 0 and 2 then phase else 0 end)) % 3 end as frame from features""")
def _(fx):
    return fx.features.select("attributes", "start_bp",
                              co.feature_frame("type", "strand", "start_bp", "end_bp", "phase").alias("frame"))


@query("location_label", "features",
       "select attributes, concat(chrom, ':', start_bp + 1, '-', end_bp) as label from features")
def _(fx):
    return fx.features.select("attributes", co.location_label("chrom", "start_bp", "end_bp").alias("label"))
