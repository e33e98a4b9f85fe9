"""Genomic tables derived from the driver's tables, in Spark SQL and in DuckDB SQL.

Two coordinate spaces: ``ctg<n>`` (100 kb each, no bases; their number grows with the
data, so depth and overlap per contig stay the same at any scale) for interval work and
``doc<doc_id>`` (bases made from the document text) for everything that reads bases.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandlake.session import materialize

CTG_LENGTH = 100000

# name -> (tables and fixtures used, SQL). {x} is a reference to a table or fixture.
# RXG is a replace-all regexp_replace; IDIV(a, b) is integer division; EACH(a, b) makes a row of each number.
FIXTURES: dict[str, tuple[str, str]] = {
    "contigs": ("documents", """
        select concat('doc', cast(doc_id as varchar(12))) as chrom, doc_id,
          translate(upper(RXG(text, '[^A-Za-z]', '')),
                    'BDEFHIJKLMOPQRSUVWXYZ', 'ACGTACGTACGACGTACGTAC') as seq
        from {documents}"""),
    "doc_lengths": ("contigs", "select chrom, doc_id, cast(length(seq) as int) as length from {contigs}"),
    "li": ("lineitem", """
        select *, cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey,
          l_suppkey, l_extendedprice, l_quantity, l_shipdate) as int) as rn from {lineitem}"""),
    "reads": ("lineitem", """
        select concat('bam', cast(l_linenumber % 2 as varchar(2))) as source,
          concat('r', cast(l_orderkey as varchar(20))) as name,
          cast(case when l_returnflag = 'R' then 16 else 0 end
             + case when l_tax = 0.08 then 4 else 0 end
             + case when l_discount = 0.1 then 1024 else 0 end as int) as flags,
          concat('ctg', cast(IDIV(l_orderkey, 1500) as varchar(12))) as chrom,
          cast((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 99800 as int) as start_bp,
          cast((l_orderkey * 7919 + l_linenumber * 104729 + l_partkey * 31) % 99800 as int)
            + 50 + cast(l_quantity as int) as end_bp,
          cast(l_partkey % 61 as int) as mapq,
          concat(cast(50 + cast(l_quantity as int) as varchar(5)), 'M') as cigar,
          cast(-1 as int) as mate_pos
        from {lineitem}"""),
    "ctg_lengths": ("reads", f"select distinct chrom, cast({CTG_LENGTH} as int) as length from {{reads}}"),
    "genes": ("orders", """
        select o_orderkey as gkey, concat('ctg', cast(IDIV(o_orderkey, 1500) as varchar(12))) as chrom, 'ref' as source,
          'gene' as type,
          cast((o_orderkey * 6151 + o_custkey * 97) % 98700 as int) as start_bp,
          cast((o_orderkey * 6151 + o_custkey * 97) % 98700 + 30 + (o_orderkey * 37) % 1200 as int) as end_bp,
          case o_orderstatus when 'F' then '+' when 'O' then '-' else '.' end as strand,
          cast(-1 as int) as phase,
          concat('ID=g', cast(o_orderkey as varchar(20)), ';Name=', o_orderpriority) as attributes
        from {orders}"""),
    "cds": ("genes li", """
        select g.gkey, g.chrom, g.source, 'CDS' as type,
          cast(g.start_bp + (l.rn - 1) * 150 as int) as start_bp,
          cast(g.start_bp + (l.rn - 1) * 150 + 60 + cast(l.l_quantity as int) as int) as end_bp,
          g.strand, cast(l.rn % 3 as int) as phase,
          concat('ID=c', cast(g.gkey as varchar(20)), '.', cast(l.rn as varchar(8)), ';Parent=',
            case when g.gkey % 2 = 0 then 'm' else 'g' end, cast(g.gkey as varchar(20))) as attributes
        from {genes} g join {li} l on g.gkey = l.l_orderkey"""),
    "features": ("genes cds ctg_lengths", """
        select chrom, source, type, start_bp, end_bp, strand, phase, attributes from {genes}
        union all select chrom, source, type, start_bp, end_bp, strand, phase, attributes from {cds}
        union all select chrom, source, 'mRNA', start_bp, end_bp, strand, phase,
          concat('ID=m', cast(gkey as varchar(20)), ';Parent=g', cast(gkey as varchar(20)))
          from {genes} where gkey % 2 = 0
        union all select chrom, source, 'CDS', start_bp, end_bp, strand, cast(0 as int),
          concat('ID=f', cast(gkey as varchar(20)), ';Parent=zz', cast(gkey as varchar(20)))
          from {genes} where gkey % 7 = 0
        union all select chrom, source, 'exon', start_bp, end_bp - 5, strand, phase,
          concat('ID=e', cast(gkey as varchar(20)), ';Parent=',
            case when gkey % 2 = 0 then 'm' else 'g' end, cast(gkey as varchar(20)))
          from {genes} where gkey % 3 = 0
        union all select chrom, 'ref', 'region', cast(0 as int), length, '+', cast(-1 as int),
          concat('ID=', chrom) from {ctg_lengths}"""),
    "variants": ("events", """
        select event_id, concat('vcf', cast(event_id % 3 as varchar(2))) as source,
          concat('ctg', cast(IDIV(event_id, 1000) as varchar(12))) as chrom,
          cast((event_id * 7907 + user_id * 13) % 99000 as int) as start_bp,
          concat('v', cast(event_id as varchar(20))) as id,
          case cast(event_id % 5 as int) when 0 then 'A' when 1 then 'C' when 2 then 'GT' when 3 then 'GTA'
            else 'T' end as ref,
          case cast(event_id % 7 as int) when 0 then 'G' when 1 then 'CTT' when 2 then 'G' when 3 then 'A,T'
            when 4 then '<DEL>' when 5 then 'TC' else 'TGA' end as alt,
          value as qual, 'PASS' as filter, event_type as info,
          cast((event_id + user_id) % 7 as int) as sel, cast(event_id % 50 as int) as dp
        from {events}"""),
    "genotypes": ("variants", """
        select v.*, v.start_bp + cast(length(v.ref) as int) as end_bp, v.k as sample_idx,
          concat('s', cast(v.k as varchar(2))) as sample,
          case (v.sel + v.k) % 7 when 0 then '0/0' when 1 then '0/1' when 2 then '1/1' when 3 then '1/2'
            when 4 then './.' when 5 then '0|1' else '2' end as gt
        from (select *, EACH(0, 2) as k from {variants}) v"""),
    # Documents of 400 bases and more, numbered inside their thousand; every line item is dealt to one of them.
    "long_contigs": ("contigs", """
        select chrom, seq, IDIV(doc_id, 1000) as bk, row_number() over (partition by IDIV(doc_id, 1000) order by doc_id) - 1 as rk,
          count(*) over (partition by IDIV(doc_id, 1000)) as cnt
        from {contigs} where length(seq) >= 400"""),
    "placed": ("li long_contigs", """
        select l.l_orderkey as okey, l.rn, c.chrom, l.l_returnflag as rflag, l.l_partkey as pkey,
          50 + cast(l.l_quantity as int) as n,
          cast((l.l_orderkey * 7919 + l.rn * 311 + l.l_partkey * 31) % (length(c.seq) - 300) as int) as start_bp,
          c.seq
        from (select *, case when l_orderkey % 11 = 0 then l_orderkey + rn else l_orderkey end as deal from {li}) l
        join (select bk, max(cnt) as cnt, row_number() over (order by bk) - 1 as no, count(*) over () as n_bk from {long_contigs} group by bk) b
          on b.no = l.deal % b.n_bk
        join {long_contigs} c
          on c.bk = b.bk and c.rk = cast((l.deal - l.deal % b.n_bk) / b.n_bk as bigint) % b.cnt"""),
    "shaped": ("placed", """
        select *, substr(seq, start_bp + 1, 7) as h0, substr(seq, start_bp + 8, 1) as rb,
          translate(substr(seq, start_bp + 8, 1), 'ACGTN', 'CGTAA') as ab,
          substr(seq, start_bp + 9, 12) as h1, substr(seq, start_bp + 21, n - 20) as t0,
          substr(seq, start_bp + 21, 3) as gone, substr(seq, start_bp + 24, n - 20) as t3,
          cast(rn % 5 as int) as shape from {placed}"""),
    "bases": ("shaped", """
        select okey, rn, chrom, rflag, pkey, n, start_bp, shape,
          concat('t', cast(okey as varchar(20)), '.', cast(cast(floor((rn + 1) / 2.0) as int) as varchar(8))) as name,
          start_bp + n + case when shape = 3 then 3 else 0 end as end_bp,
          case shape when 0 then concat(cast(n as varchar(4)), 'M')
            when 1 then concat('10S', cast(n as varchar(4)), 'M')
            when 2 then concat('20M2I', cast(n - 20 as varchar(4)), 'M')
            when 3 then concat('20M3D', cast(n - 20 as varchar(4)), 'M')
            else concat(cast(n as varchar(4)), 'M12S') end as cigar,
          case shape when 0 then concat(h0, ab, h1, t0)
            when 1 then concat('ACACACACAC', h0, ab, h1, t0)
            when 2 then concat(h0, ab, h1, 'GT', t0)
            when 3 then concat(h0, ab, h1, t3)
            else concat(h0, ab, h1, t0, 'TGTGTGTGTGTG') end as read_seq,
          case shape when 3 then concat('7', rb, '12^', gone, cast(n - 20 as varchar(4)))
            else concat('7', rb, cast(n - 8 as varchar(4))) end as md
        from {shaped}"""),
    "mated": ("bases", """
        select b.*, row_number() over (partition by name order by rn) as k,
          count(*) over (partition by name) as paired,
          lead(chrom) over (partition by name order by rn) as nc, lag(chrom) over (partition by name order by rn) as pc,
          lead(start_bp) over (partition by name order by rn) as ns, lag(start_bp) over (partition by name order by rn) as ps,
          lead(end_bp) over (partition by name order by rn) as ne, lag(end_bp) over (partition by name order by rn) as pe,
          lead(rflag) over (partition by name order by rn) as nf, lag(rflag) over (partition by name order by rn) as pf
        from {bases} b"""),
    "alignments": ("mated", """
        select concat('bam', cast(okey % 2 as varchar(2))) as source, name,
          cast(1 + case when paired = 1 then 8 else 0 end
            + case when coalesce(nc, pc) = chrom then 2 else 0 end
            + case when rflag = 'R' then 16 else 0 end
            + case when coalesce(nf, pf) = 'R' then 32 else 0 end
            + case when rn % 2 = 1 then 64 else 128 end
            + case when pkey % 17 = 0 then 1024 else 0 end as int) as flags,
          chrom, start_bp, end_bp, cast(pkey % 61 as int) as mapq, cigar, read_seq, md,
          coalesce(nc, pc) as mate_chrom, cast(coalesce(ns, ps, -1) as int) as mate_pos,
          cast(case when coalesce(nc, pc) = chrom
            then greatest(end_bp, coalesce(ne, pe)) - least(start_bp, coalesce(ns, ps)) else 0 end
            * case when rflag = 'R' then -1 else 1 end as int) as tlen, okey, rn
        from {mated}"""),
    # Comparison space: contig pairs a<k>/b<k> of eight documents each; b is a mutated copy,
    # every third document reverse-complemented. Rare letters give natural N breaks.
    "cmp_base": ("documents", """
        select doc_id, IDIV(doc_id, 8) as blk, concat('doc', cast(doc_id as varchar(12))) as chrom,
          translate(upper(RXG(text, '[^A-Za-z]', '')),
            'BDEFHIJKLMNOPQRSUVWXYZ', 'ACGTACGTACTGACNTACGTAC') as seq from {documents}"""),
    "cmp_mut": ("cmp_base", """
        select doc_id, blk, chrom, replace(replace(replace(seq, 'CTAGA', 'CTCGA'), 'GATTC', 'GTC'),
            'AACGT', 'AACCGCGT') as seq from {cmp_base}"""),
    "cmp_contigs": ("cmp_base cmp_mut", """
        select concat('a', cast(blk as varchar(12))) as genome, cast(blk * 2 as int) as ord, chrom, doc_id, seq
          from {cmp_base}
        union all
        select concat('b', cast(blk as varchar(12))), cast(blk * 2 + 1 as int), chrom, doc_id,
          case when doc_id % 3 = 1
            then reverse(translate(RXG(seq, '[^ACGT]', 'N'), 'ACGT', 'TGCA')) else seq end
          from {cmp_mut}"""),
    # Four blocks per document between its two versions, with made-up identity.
    "cmp_blocks": ("cmp_base cmp_mut", """
        select concat('k', cast(doc_id as varchar(12)), '_', cast(k as varchar(2))) as block_id, doc_id, k,
          concat('a', cast(blk as varchar(12))) as q_genome, concat('b', cast(blk as varchar(12))) as t_genome,
          chrom as q_chrom, chrom as t_chrom, (doc_id + k) % 2 = 0 as same_strand,
          cast(floor(n * k / 6.0) as int) as q_start, cast(floor(n * k / 6.0) + floor(n / 8.0) + 20 as int) as q_end,
          cast(floor(n * k / 7.0) as int) as t_start, cast(floor(n * k / 7.0) + floor(n / 8.0) + 10 as int) as t_end,
          cast(5000 + (doc_id * 37 + k * 911) % 5001 as int) as ident_x100
        from (select a.doc_id, a.blk, a.chrom, EACH(0, 3) as k, least(length(a.seq), length(b.seq)) as n
              from {cmp_base} a join {cmp_mut} b on a.doc_id = b.doc_id) x
        where n > 0"""),
    # Alignments as blocks of a read (query) on its contig (target), with their op runs.
    "read_blocks": ("bases", """
        select okey, rn, cast(5 as int) as q_start, cast(45 as int) as q_end, start_bp as t_start, end_bp as t_end,
          rflag <> 'R' as same_strand from {bases}"""),
    "read_ops": ("bases", """
        select okey, rn, cast(0 as int) as run_no, 'M' as op, cast(7 as int) as len from {bases}
        union all select okey, rn, 1, 'X', 1 from {bases}
        union all select okey, rn, 2, 'M', case when shape in (2, 3) then 12 else n - 8 end from {bases}
        union all select okey, rn, 3, case when shape = 2 then 'I' else 'D' end, shape from {bases} where shape in (2, 3)
        union all select okey, rn, 4, 'M', n - 20 from {bases} where shape in (2, 3)"""),
}

# Spark's text of fixtures that its planner takes badly as written above; the rows are the same. A join on
# ``no = deal % n_bk`` with n_bk on the other side has no equal keys, so there it compares every line item with every thousand.
SPARK_TEXTS: dict[str, tuple[str, str]] = {
    "thousands": ("long_contigs", """
        select bk, max(cnt) as cnt, row_number() over (order by bk) - 1 as no from {long_contigs} group by bk"""),
    "placed": ("li long_contigs thousands", """
        select l.l_orderkey as okey, l.rn, c.chrom, l.l_returnflag as rflag, l.l_partkey as pkey,
          50 + cast(l.l_quantity as int) as n,
          cast((l.l_orderkey * 7919 + l.rn * 311 + l.l_partkey * 31) % (length(c.seq) - 300) as int) as start_bp,
          c.seq
        from (select *, deal % n_bk as no, (deal - deal % n_bk) div n_bk as turn
              from (select *, case when l_orderkey % 11 = 0 then l_orderkey + rn else l_orderkey end as deal from {li})
              cross join (select count(*) as n_bk from {thousands}) where n_bk > 0) l
        join {thousands} b on b.no = l.no
        join {long_contigs} c on c.bk = b.bk and c.rk = l.turn % b.cnt"""),
    # Line items with the other one of their pair beside them: the next of an odd one, the one before an even one.
    "paired_li": ("lineitem thousands", """
        select *, deal % n_bk as no, (deal - deal % n_bk) div n_bk as turn,
          m_deal % n_bk as m_no, (m_deal - m_deal % n_bk) div n_bk as m_turn
        from (select okey, rn, rflag, pkey, n, m_rn, m.*, case when okey % 11 = 0 then okey + rn else okey end as deal,
                case when okey % 11 = 0 and m is not null then okey + m_rn end as m_deal, m is not null as has_mate
              from (select *, case when rn % 2 = 1 then rn + 1 else rn - 1 end as m_rn,
                      case when rn % 2 = 1 then after else before end as m
                    from (select l_orderkey as okey, cast(row_number() over w as int) as rn, l_returnflag as rflag, l_partkey as pkey,
                            50 + cast(l_quantity as int) as n,
                            lead(struct(l_returnflag as m_rflag, l_partkey as m_pkey, 50 + cast(l_quantity as int) as m_n)) over w as after,
                            lag(struct(l_returnflag as m_rflag, l_partkey as m_pkey, 50 + cast(l_quantity as int) as m_n)) over w as before
                          from {lineitem}
                          window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity,
                            l_shipdate))))
        cross join (select count(*) as n_bk from {thousands}) where n_bk > 0"""),
    # Both of a pair lie on one contig, but for orders that are dealt line by line: only those look up the other's contig.
    "mated_li": ("paired_li long_contigs thousands", """
        select okey, rn, rflag, pkey, n, m_rn, m_rflag, m_pkey, m_n, no, turn, has_mate,
          cast(null as string) as m_chrom, cast(null as int) as m_length
          from {paired_li} where okey % 11 <> 0
        union all
        select l.okey, l.rn, l.rflag, l.pkey, l.n, l.m_rn, l.m_rflag, l.m_pkey, l.m_n, l.no, l.turn, c.chrom is not null, c.chrom, length(c.seq)
          from {paired_li} l left join {thousands} b on b.no = l.m_no
          left join {long_contigs} c on c.bk = b.bk and c.rk = l.m_turn % b.cnt where l.okey % 11 = 0"""),
    # One cut of the contig's bytes for each read; the letters before and after its mismatch are cut from that.
    "cut_reads": ("mated_li long_contigs thousands", """
        select *, start_bp + n + case when shape = 3 then 3 else 0 end as end_bp,
          m_start + m_n + case when m_rn % 5 = 3 then 3 else 0 end as m_end,
          cast(substring(b, start_bp + 1, greatest(n, 20) + 3) as string) as cut
        from (select *, cast(rn % 5 as int) as shape,
            cast((okey * 7919 + rn * 311 + pkey * 31) % (length - 300) as int) as start_bp,
            cast((okey * 7919 + m_rn * 311 + m_pkey * 31) % (m_len - 300) as int) as m_start
          from (select l.okey, l.rn, l.rflag, l.pkey, l.n, l.m_rn, l.m_rflag, l.m_pkey, l.m_n, c.chrom, c.length, c.b,
              case when l.okey % 11 = 0 then l.m_chrom when l.has_mate then c.chrom end as mate_chrom,
              case when l.okey % 11 = 0 then l.m_length when l.has_mate then c.length end as m_len, l.has_mate
            from {mated_li} l join {thousands} b on b.no = l.no
            join (select bk, rk, chrom, length(seq) as length, cast(seq as binary) as b from {long_contigs}) c
              on c.bk = b.bk and c.rk = l.turn % b.cnt))"""),
    "alignments": ("cut_reads", """
        select concat('bam', cast(okey % 2 as varchar(2))) as source,
          concat('t', cast(okey as varchar(20)), '.', cast((rn + 1) div 2 as varchar(8))) as name,
          cast(1 + case when has_mate then 0 else 8 end
            + case when mate_chrom = chrom then 2 else 0 end
            + case when rflag = 'R' then 16 else 0 end
            + case when has_mate and m_rflag = 'R' then 32 else 0 end
            + case when rn % 2 = 1 then 64 else 128 end
            + case when pkey % 17 = 0 then 1024 else 0 end as int) as flags,
          chrom, start_bp, end_bp, cast(pkey % 61 as int) as mapq,
          case shape when 0 then concat(cast(n as varchar(4)), 'M')
            when 1 then concat('10S', cast(n as varchar(4)), 'M')
            when 2 then concat('20M2I', cast(n - 20 as varchar(4)), 'M')
            when 3 then concat('20M3D', cast(n - 20 as varchar(4)), 'M')
            else concat(cast(n as varchar(4)), 'M12S') end as cigar,
          concat(case shape when 1 then 'ACACACACAC' else '' end, substr(cut, 1, 7), translate(substr(cut, 8, 1), 'ACGTN', 'CGTAA'),
            substr(cut, 9, 12), case shape when 2 then 'GT' else '' end,
            substr(cut, case shape when 3 then 24 else 21 end, n - 20), case shape when 4 then 'TGTGTGTGTGTG' else '' end) as read_seq,
          case shape when 3 then concat('7', substr(cut, 8, 1), '12^', substr(cut, 21, 3), cast(n - 20 as varchar(4)))
            else concat('7', substr(cut, 8, 1), cast(n - 8 as varchar(4))) end as md,
          mate_chrom, cast(coalesce(case when has_mate then m_start end, -1) as int) as mate_pos,
          cast(case when mate_chrom = chrom then greatest(end_bp, m_end) - least(start_bp, m_start) else 0 end
            * case when rflag = 'R' then -1 else 1 end as int) as tlen, okey, rn
        from {cut_reads}"""),
}

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def _spark_text(sql: str) -> str:
    out = re.sub(r"EACH\((\d+), (\d+)\)", r"explode(sequence(\1, \2))", sql)
    return re.sub(r"IDIV\((\w+), (\d+)\)", r"(\1 div \2)", out.replace("RXG(", "regexp_replace("))


def _duck_text(sql: str) -> str:
    out = re.sub(r"IDIV\((\w+), (\d+)\)", r"(\1 // \2)", sql)
    out = re.sub(r"EACH\((\d+), (\d+)\)", r"cast(unnest(generate_series(\1, \2)) as int)", out)
    out = out.replace("RXG(text, '[^A-Za-z]', '')", "regexp_replace(text, '[^A-Za-z]', '', 'g')")
    return out.replace("RXG(seq, '[^ACGT]', 'N')", "regexp_replace(seq, '[^ACGT]', 'N', 'g')")


def with_ctes(names: str, body: str) -> str:
    """DuckDB text: the named fixtures and all they use as CTEs, then ``body``."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in DRIVER_TABLES or name in order:
            return
        for dep in FIXTURES[name][0].split():
            visit(dep)
        order.append(name)

    for n in names.split():
        visit(n)
    parts = []
    for n in order:
        deps, sql = FIXTURES[n]
        parts.append(f"{n} as ({_duck_text(sql).format(**{d: d for d in deps.split()})})")
    body = body.strip()
    if not parts:
        return body
    if body.lower().startswith("with recursive "):
        return "with recursive " + ",\n".join(parts) + ",\n" + body[len("with recursive "):]
    if body.lower().startswith("with "):
        return "with " + ",\n".join(parts) + ",\n" + body[len("with "):]
    return "with " + ",\n".join(parts) + "\n" + body


# Kept as Parquet in the shared folder once per application, as stored genomic tables
# would be; the value is the column the rows are spread by (the source files are one split).
STORED = {"contigs": "chrom", "cmp_contigs": "chrom", "features": None, "alignments": None}
_STORED: dict[tuple[str, str, str], DataFrame] = {}


class Fixtures:
    """Spark side of the fixtures; attribute access gives the DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in DRIVER_TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            elif name in FIXTURES or name in SPARK_TEXTS:
                deps, sql = SPARK_TEXTS.get(name) or FIXTURES[name]
                make = lambda: self.spark.sql(
                    _spark_text(sql), **{d: getattr(self, d) for d in deps.split()})
                self._made[name] = self._stored(name, make) if name in STORED else make()
            else:
                raise AttributeError(name)
        return self._made[name]

    def stored(self, name: str, make, *, written: bool = False) -> DataFrame:
        """A derived table kept once per application (comparison results shared by queries); ``written``: ``make`` stores it itself."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir, f"kept:{name}")
        if key not in _STORED:
            _STORED[key] = make() if written else materialize(make(), name)
        return _STORED[key]

    def _stored(self, name: str, make) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.sf_dir, name)
        if key not in _STORED:
            df, by = make(), STORED[name]
            if by:
                df = df.repartition(self.spark.sparkContext.defaultParallelism, by)
            _STORED[key] = materialize(df, name)
        return _STORED[key]

    @cached_property
    def vcf(self) -> DataFrame:
        """Canonical variant records: format keys and one value per sample."""
        selector = lambda k: F.expr(
            f"case (sel + {k}) % 7 when 0 then '0/0' when 1 then '0/1' when 2 then '1/1' when 3 then '1/2' "
            "when 4 then './.' when 5 then '0|1' else '2' end")
        samples = F.array(*[
            F.struct(F.lit(f"s{k}").alias("sample"),
                     F.concat(selector(k), F.lit(":"), F.col("dp").cast("string")).alias("value"))
            for k in range(3)])
        return self.variants.select(
            "source", "chrom", "start_bp", (F.col("start_bp") + F.length("ref")).alias("end_bp"), "id", "ref",
            "alt", "qual", "filter", "info", F.array(F.lit("GT"), F.lit("DP")).alias("format"),
            samples.alias("samples"))
