"""D1-D9 over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import sequence as sq
from strandlake.plans.registry import CTES, FUNCTIONS, query
from strandlake.plans.scalar import AA_CASE


@query("reference_slices", "alignments contigs",
       """select a.okey, a.rn, substr(c.seq, greatest(a.start_bp - 20, 0) + 1,
            greatest(least(a.end_bp + 40, length(c.seq)) - greatest(a.start_bp - 20, 0), 0)) as seq
          from alignments a join contigs c on c.chrom = a.chrom""")
def _(fx):
    regions = fx.alignments.select("okey", "rn", "chrom", (F.col("start_bp") - 20).alias("start_bp"),
                                   (F.col("end_bp") + 40).alias("end_bp"))
    return sq.reference_slices(fx.contigs, regions, id_cols=("okey", "rn"), step=512).select("okey", "rn", "seq")


@query("gc_prefix", "contigs",
       """select chrom, i as chunk, length(regexp_replace(left(seq, i * 512), '[^GC]', '', 'g')) as gc,
            length(regexp_replace(left(seq, i * 512), '[^ACGT]', '', 'g')) as acgt
          from (select *, unnest(generate_series(0, (length(seq) - 1) // 512)) as i from contigs where length(seq) > 0)""")
def _(fx):
    return sq.gc_prefix(fx.contigs, step=512).select("chrom", "chunk", "gc", "acgt")


@query("gc_plot", "contigs",
       """with t as (select chrom, seq, length(seq) as n, t as tile, t * 4096 as t0, least((t + 1) * 4096, length(seq)) as t1
            from (select *, unnest(generate_series(0, (length(seq) - 1) // 4096)) as t from contigs where length(seq) > 0)),
          b as (select *, t0 + cast(floor((b + 0.5) * (t1 - t0) / 256.0::double) as int) - 100 as w0
            from (select *, unnest(generate_series(0, 255)) as b from t)),
          s as (select chrom, tile, b, substr(seq, greatest(w0, 0) + 1, least(w0 + 200, n) - greatest(w0, 0)) as win from b)
          select chrom, tile, b as bin, case when length(translate(win, 'N', '')) > 0 then
            length(translate(win, 'ATN', '')) / cast(length(translate(win, 'N', '')) as double) else -1.0 end as gc from s""")
def _(fx):
    return sq.gc_plot(fx.contigs, zoom=2)


@query("stop_codon_bins", "contigs",
       """with t as (select chrom, tile, t0, substr(seq, t0 + 1, t1 - t0) as part, t1 - t0 as span from
            (select chrom, seq, t as tile, t * 2048 as t0, least((t + 1) * 2048, length(seq)) as t1 from
              (select *, unnest(generate_series(0, (length(seq) - 1) // 2048)) as t from contigs where length(seq) > 0))),
          p as (select chrom, tile, t0, span, i, substr(part, i + 1, 3) as codon from
            (select *, unnest(generate_series(0, span - 3)) as i from t where span >= 3)),
          f as (select *, (t0 + i) % 3 as frame from p where codon in ('TAA', 'TAG', 'TGA')
            union all select *, (t0 + i) % 3 + 3 from p where codon in ('TTA', 'CTA', 'TCA'))
          select distinct chrom, tile, frame, least((i + 1) * 512 // span, 511) as bin from f""")
def _(fx):
    return sq.stop_codon_bins(fx.contigs, zoom=1)


@query("six_frame_translation", "contigs",
       f"""with c as (select chrom, f, i, substr(seq, f + 3 * i + 1, 3) as codon from
             (select chrom, seq, f, unnest(generate_series(0, (length(seq) - f) // 3 - 1)) as i from contigs,
               (select unnest([0, 1, 2]) as f))),
           b as (select chrom, f as frame, i, codon from c union all
             select chrom, f + 3, i, reverse(translate(codon, 'ACGTN', 'TGCAN')) from c)
           select chrom, frame, i // 1365 as piece, md5(string_agg({AA_CASE}, '' order by i)) as aa from b group by 1, 2, 3""")
def _(fx):
    return sq.six_frame_translation(fx.contigs).withColumn("aa", F.md5("aa"))


PATTERNS = """pat as (select distinct upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) as w from benchmark),
  pats as (select distinct substr(w, 10 * i + 1, 10) as pattern from
      (select w, unnest(generate_series(0, length(w) // 10 - 1)) as i from pat where length(w) >= 10)
    union select distinct right(w, 10) from pat where w <> '' union select 'ACGTNN' union select 'GGGCCC' union select 'TAGTAGTAG')"""
HITS = """words as (select pattern, pattern as word, '+' as strand from pats union all
    select pattern, rc, '-' from (select pattern, reverse(translate(pattern, 'ACGT', 'TGCA')) as rc from pats
      where not contains(pattern, 'N')) where rc <> pattern),
  pos as (select genome, chrom, p, k, substr(seq, p + 1, k) as word from (select genome, chrom, seq, k,
    unnest(generate_series(0, length(seq) - k)) as p from src, (select distinct length(pattern) as k from pats))),
  hits as (select genome, chrom, pattern, strand, p as start_bp, p + k as end_bp from pos join words using (word)),
  ranked as (select *, row_number() over (partition by genome, chrom, pattern order by strand, start_bp) as rk,
    count(*) over (partition by genome, chrom, pattern) as n from hits)"""
ALL_HITS = " select {cols}, pattern, strand, start_bp, end_bp, false as truncated from hits"
FIRST_HITS = " select {cols}, pattern, strand, start_bp, end_bp, n >= 2 as truncated from ranked where rk <= 2"
CONTIG_SRC = "with src as (select '' as genome, chrom, seq from contigs), "


def _patterns(fx):
    w = fx.benchmark.select(F.upper(F.regexp_replace("text", "[^ACGTacgt]", "")).alias("w")).where("w <> ''")
    tens = w.where("length(w) >= 10").withColumn("i", F.explode(F.expr("sequence(0, length(w) div 10 - 1)")))
    words = tens.select(F.expr("substring(w, cast(10 * i as int) + 1, 10)").alias("pattern")).unionByName(w.select(F.expr("right(w, 10)").alias("pattern")))
    extra = fx.spark.createDataFrame([("ACGTNN",), ("GGGCCC",), ("TAGTAGTAG",)], "pattern string")
    return words.unionByName(extra).distinct()


@query("dna_search", "contigs", CONTIG_SRC + PATTERNS + ", " + HITS + ALL_HITS.format(cols="chrom"))
def _(fx):
    return sq.dna_search(fx.contigs, _patterns(fx))


@query("dna_search_first", "contigs", CONTIG_SRC + PATTERNS + ", " + HITS + FIRST_HITS.format(cols="chrom"))
def _(fx):
    return sq.dna_search(fx.contigs, _patterns(fx), max_hits=2)


@query("dna_search_genomes", "cmp_contigs",
       "with src as (select genome, chrom, seq from cmp_contigs), " + PATTERNS + ", " + HITS + ALL_HITS.format(cols="genome, chrom"))
def _(fx):
    return sq.dna_search(fx.cmp_contigs, _patterns(fx), keys=("genome", "chrom"))


MINIMIZER_SQL = """{out} as (select distinct {keys}, length, key, pos from (select {keys}, length,
    min(struct_pack(k := {k}, p := -p)) over w as m, count(*) filter (where ok) over w as n_ok from
      (select *, length(replace(word, 'N', '')) = 15 as ok from (select {keys}, length, p, substr(seq, p + 1, 15) as word
        from (select {keys}, length(seq) as length, seq, unnest(generate_series(0, length(seq) - 15)) as p from {src})))
    window w as (partition by {keys} order by p rows between 9 preceding and current row)
    qualify n_ok = 10), lateral (select m.k as key, -m.p as pos))"""


def minimizer_cte(src: str, keys: str, out: str, reverse: bool) -> str:
    k = "reverse(translate(word, 'ACGT', 'TGCA'))" if reverse else "word"
    return MINIMIZER_SQL.format(src=src, keys=keys, out=out, k=k)


def packed_sql(word: str) -> str:
    return " + ".join(f"(strpos('ACGT', substr({word}, {i}, 1)) - 1) * {4 ** (15 - i)}::bigint" for i in range(1, 16))


@query("minimizers", "cmp_contigs",
       "with " + minimizer_cte("cmp_contigs", "genome, chrom", "f", False) + ", " +
       minimizer_cte("cmp_contigs", "genome, chrom", "r", True) +
       f""" select genome, chrom, pos, {packed_sql('key')} as key, false as reverse from f
           union all select genome, chrom, pos, {packed_sql('key')}, true from r""")
def _(fx):
    keys = ("genome", "chrom")
    f = sq.minimizers(fx.cmp_contigs, keys=keys).withColumn("reverse", F.lit(False))
    r = sq.minimizers(fx.cmp_contigs, keys=keys, reverse=True).withColumn("reverse", F.lit(True))
    return f.unionByName(r).drop("length")


@query("apply_orientation_sequence", "contigs",
       """select chrom, md5(case when doc_id % 3 = 1 then reverse(translate(seq, 'ACGT', 'TGCA')) else seq end) as digest
          from contigs""")
def _(fx):
    o = fx.doc_lengths.select("chrom", F.expr("doc_id % 3 = 1").alias("reversed"))
    return sq.apply_orientation_sequence(fx.contigs, o).select("chrom", F.md5("seq").alias("digest"))


# The same operators on chunk tables, as the chunked FASTA reader gives them.
CHUNKED_BY = 4096


class Chunked:
    """Fixtures whose contigs are chunk tables, read from FASTA files of all contigs."""

    def __init__(self, fx):
        self.fx = fx

    def __getattr__(self, name):
        return getattr(self.fx, name)

    @property
    def contigs(self):
        from strandlake.plans.files import fasta_lines, write_text
        from strandlake.sources import read_fasta_chunks

        return self.fx.stored("contig_chunks", lambda: read_fasta_chunks(
            self.fx.spark, write_text(self.fx, "fasta", {"a": fasta_lines(self.fx)}), chunk=CHUNKED_BY).drop("file"))


# Search and minimizers on chunks are compared with their row forms in the tests: a second run of their SQL would cost a minute.
for _name in ("reference_slices", "gc_prefix", "gc_plot", "stop_codon_bins", "six_frame_translation"):
    query(f"{_name}_chunks", *CTES[_name])(lambda fx, fn=FUNCTIONS[_name]: fn(Chunked(fx)))


@query("slice_pieces", "alignments contigs",
       """select okey, rn, k - lo // 512 as piece_no, greatest(lo, k * 512) as at, md5(substr(seq, greatest(lo, k * 512) + 1,
            least(hi, k * 512 + 512) - greatest(lo, k * 512))) as bases
          from (select *, unnest(generate_series(lo // 512, (hi - 1) // 512)) as k from (select a.okey, a.rn, c.seq,
            greatest(a.start_bp - 200, 0) as lo, least(a.end_bp + 2000, length(c.seq)) as hi
            from alignments a join contigs c on c.chrom = a.chrom))""")
def _(fx):
    regions = fx.alignments.select("okey", "rn", "chrom", (F.col("start_bp") - 200).alias("start_bp"), (F.col("end_bp") + 2000).alias("end_bp"))
    return sq.slice_pieces(Chunked(fx).contigs, regions, id_cols=("okey", "rn"), step=512).select("okey", "rn", "piece_no", "at", F.md5("bases").alias("bases"))


@query("apply_orientation_sequence_chunks", "contigs",
       f"""select chrom, c as chunk, length, md5(substr(s, c * {CHUNKED_BY} + 1, {CHUNKED_BY})) as digest
          from (select *, unnest(generate_series(0, (length - 1) // {CHUNKED_BY})) as c from (select chrom, length(seq) as length,
            case when doc_id % 3 = 1 then reverse(translate(seq, 'ACGT', 'TGCA')) else seq end as s from contigs where length(seq) > 0))""")
def _(fx):
    o = fx.doc_lengths.select("chrom", F.expr("doc_id % 3 = 1").alias("reversed"))
    turned = sq.apply_orientation_sequence(Chunked(fx).contigs, o)
    return turned.select("chrom", "chunk", "length", F.md5("bases").alias("digest"))
