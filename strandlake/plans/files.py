"""Files that Spark writes from the driver's tables, read back by the sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake import sources as src
from strandlake.plans.catalog import segments
from strandlake.plans.registry import query
from strandlake.session import scratch_path

WRAP = r"(.{1,70})"
FEATURE = "chrom, source, type, start_bp, end_bp, strand, phase, attributes"


def write_text(fx, name: str, frames, *, compression: str | None = None) -> str:
    """Write frames of a column ``value`` under one folder, one sub-folder each, once per session. Tasks that sort lines into their files
    grow with the rows, so that none has more than its memory takes."""
    keep = _PATHS.setdefault((fx.spark.sparkContext.applicationId, fx.sf_dir, name), None)
    if keep:
        return keep
    path = scratch_path(fx.spark, name)
    for sub, df in frames.items():
        if "slice" in df.columns:  # a file of its own for each slice, its lines in their order
            most = LINES_A_TASK if sub in SHORT_LINES else DOCS_A_TASK
            many = df.repartition(max(fx.spark.sparkContext.defaultParallelism, -(-df.count() // most)), "slice")
            many.sortWithinPartitions("slice", *[c for c in ("o", "at") if c in df.columns]).select("slice", "value").write.partitionBy("slice").text(
                f"{path}/{sub}", compression=compression)
        else:
            df.write.text(f"{path}/{sub}", compression=compression)
    _PATHS[(fx.spark.sparkContext.applicationId, fx.sf_dir, name)] = path
    return path


_PATHS: dict = {}
#: Rows of a task that sorts lines into files: those that hold a document, and those of the folders of short ones.
DOCS_A_TASK, LINES_A_TASK, SHORT_LINES = 10_000, 250_000, ("annotation.gff3", "calls.vcf", "vcf")


def wrapped(seq="seq"):
    return F.regexp_replace(F.lower(seq), WRAP, "$1\n")


def fasta_lines(fx):
    return fx.contigs.where("length(seq) > 0").select(
        F.concat(F.lit(">"), F.col("chrom"), F.lit(" from document\n"), wrapped()).alias("value"))


def gff_lines(fx):
    line = F.concat_ws("\t", "chrom", "source", "type", F.col("start_bp") + 1, "end_bp", F.lit("."), "strand",
                       F.when(F.col("phase") < 0, ".").otherwise(F.col("phase").cast("string")), "attributes")
    return fx.features.select(line.alias("value"))


#: Documents and events of a file in folders of many files.
DOCS_A_FILE, EVENTS_A_FILE = 250, 1000


def doc_slice():
    return F.expr(f"cast(doc_id div {DOCS_A_FILE} as int)").alias("slice")


def gff_with_fasta(fx):
    """Files of some contigs each: an annotation line for each, then their sequence as the embedded FASTA part."""
    c = fx.contigs.where("length(seq) > 0")
    ann = F.concat_ws("\t", "chrom", F.lit("ref"), F.lit("region"), F.lit("1"), F.length("seq").cast("string"), F.lit("."),
                      F.lit("+"), F.lit("."), F.concat(F.lit("ID="), F.col("chrom")))
    rows = c.select(doc_slice(), F.lit(1).alias("o"), F.col("doc_id").alias("at"), ann.alias("value")).unionByName(
        c.select(doc_slice(), F.lit(3).alias("o"), F.col("doc_id").alias("at"), F.concat(F.lit(">"), F.col("chrom"), F.lit("\n"), wrapped()).alias("value")))
    return rows.unionByName(c.select(doc_slice()).distinct().select(
        "slice", F.lit(2).alias("o"), F.lit(0).cast("bigint").alias("at"), F.lit("##FASTA").alias("value")))


def _source(key, n, organism):
    """The source feature of a record; a record without sequence has no place for one."""
    return F.when(n > 0, F.concat(F.lit(key), n.cast("string"), F.lit(organism))).otherwise("")


def _flat_contigs(fx):
    """Contigs as records; a document without text is a record without sequence."""
    return fx.contigs.withColumn("seq", F.coalesce("seq", F.lit("")))


def genbank_lines(fx):
    n = F.length("seq")
    rec = F.concat(
        F.lit("LOCUS       "), F.col("chrom"), F.lit("   "), n.cast("string"), F.lit(" bp    DNA\nDEFINITION  made from a document\n"),
        F.lit("FEATURES             Location/Qualifiers\n"), _source("     source          1..", n, '\n                     /organism="none"\n'),
        F.lit('     gene            complement(11..50)\n                     /gene="g'),
        F.col("doc_id").cast("string"), F.lit('"\n                     /pseudo\n     CDS             join(<5..10,20..>30)\n'),
        F.lit("ORIGIN\n"), F.when(n > 0, F.concat(F.lit("        1 "), wrapped())).otherwise(""), F.lit("//"))
    return _flat_contigs(fx).select(doc_slice(), rec.alias("value"))


def embl_lines(fx):
    n = F.length("seq")
    rec = F.concat(
        F.lit("ID   "), F.col("chrom"), F.lit("; SV 1; linear; DNA\nXX\nFH   Key             Location/Qualifiers\n"),
        _source("FT   source          1..", n, '\nFT                   /organism="none"\n'),
        F.lit('FT   gene            complement(11..50)\nFT                   /gene="g'),
        F.col("doc_id").cast("string"), F.lit('"\nFT                   /pseudo\nFT   CDS             join(<5..10,20..>30)\nXX\nSQ   Sequence\n'),
        F.when(n > 0, F.concat(F.lit("     "), wrapped())).otherwise(""), F.lit("//"))
    return _flat_contigs(fx).select(doc_slice(), rec.alias("value"))


def vcf_lines(fx):
    v = fx.vcf.withColumn("at", F.expr("cast(substring(id, 2) as bigint)")).withColumn("slice", F.expr(f"cast(at div {EVENTS_A_FILE} as int)"))
    head = v.select("slice").distinct().select("slice", F.lit(0).alias("o"), F.lit(0).cast("bigint").alias("at"), F.lit(
        "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts0\ts1\ts2").alias("value"))
    line = F.concat_ws("\t", "chrom", (F.col("start_bp") + 1).cast("string"), "id", "ref", "alt", F.round("qual", 2).cast("string"),
                       "filter", F.concat(F.lit("T="), F.col("info")), F.array_join("format", ":"),
                       F.array_join(F.transform("samples", lambda s: s["value"]), "\t"))
    return head.unionByName(v.select("slice", F.lit(1).alias("o"), "at", line.alias("value")))


def sam_lines(fx):
    a = fx.alignments
    mate = F.when(F.col("mate_chrom") == F.col("chrom"), "=").otherwise(F.coalesce("mate_chrom", F.lit("*")))
    line = F.concat_ws("\t", "name", F.col("flags").cast("string"), "chrom", (F.col("start_bp") + 1).cast("string"),
                       F.col("mapq").cast("string"), "cigar", mate, (F.col("mate_pos") + 1).cast("string"),
                       F.col("tlen").cast("string"), "read_seq", F.lit("*"), F.concat(F.lit("MD:Z:"), F.col("md")))
    return a.select(line.alias("value"))


CHUNK_SQL = """select chrom, length, c as chunk, c * 4096 as start_bp, md5(substr(seq, c * 4096 + 1, 4096)) as digest
  from (select chrom, seq, length(seq) as length, unnest(generate_series(0, (length(seq) - 1) // 4096)) as c from contigs where length(seq) > 0)"""


def _chunk_digests(chunks):
    return chunks.select("chrom", "length", "chunk", "start_bp", F.md5("bases").alias("digest"))


@query("read_fasta", "contigs", "select chrom, length(seq) as length, md5(seq) as digest from contigs where length(seq) > 0")
def _(fx):
    p = write_text(fx, "fasta", {"a": fasta_lines(fx)})
    return src.read_fasta(fx.spark, p).select("chrom", "length", F.md5("seq").alias("digest"))


@query("read_fasta_chunks", "contigs", CHUNK_SQL)
def _(fx):
    """The table's contigs again, read in splits of 64 KB: lines, headers and chunks over borders."""
    p = write_text(fx, "fasta", {"a": fasta_lines(fx)})
    return _chunk_digests(src.read_fasta_chunks(fx.spark, p, chunk=4096, split=1 << 16))


@query("read_gff3", "features", f"select {FEATURE} from features")
def _(fx):
    p = write_text(fx, "gff3", {"a": gff_lines(fx)})
    return src.read_gff3(fx.spark, p).drop("file")


@query("read_gff3_sequences", "contigs", "select chrom, length(seq) as length, md5(seq) as digest from contigs where length(seq) > 0")
def _(fx):
    p = write_text(fx, "gff3seq", {"a": gff_with_fasta(fx)})
    return src.read_gff3_sequences(fx.spark, p).select("chrom", "length", F.md5("seq").alias("digest"))


@query("read_gff3_chunks", "contigs", CHUNK_SQL)
def _(fx):
    p = write_text(fx, "gff3seq", {"a": gff_with_fasta(fx)})
    return _chunk_digests(src.read_gff3_chunks(fx.spark, p, chunk=4096, split=1 << 16))


FLAT_SQL = """with f as (select chrom, length(seq) as n, case when length(seq) > 0 then md5(seq) end as digest, doc_id from contigs)
  select chrom, 'source' as type, 0 as start_bp, n as end_bp, '+' as strand, 'organism=none' as attributes, digest from f where n > 0
  union all select chrom, 'gene', 10, 50, '-', 'gene=g' || doc_id || ';pseudo', digest from f
  union all select chrom, 'CDS', 4, 30, '+', '', digest from f"""


def _flat(contigs, features):
    return features.join(contigs.select("chrom", F.md5("seq").alias("digest")), "chrom", "left").select(
        "chrom", "type", "start_bp", "end_bp", "strand", "attributes", "digest")


@query("read_genbank", "contigs", FLAT_SQL)
def _(fx):
    return _flat(*src.read_genbank(fx.spark, write_text(fx, "genbank", {"a": genbank_lines(fx)})))


@query("read_embl", "contigs", FLAT_SQL)
def _(fx):
    return _flat(*src.read_embl(fx.spark, write_text(fx, "embl", {"a": embl_lines(fx)})))


@query("read_vcf", "genotypes",
       """select chrom, start_bp, end_bp, id, ref, alt, filter, 'T=' || info as info, cast(round(qual, 2) as double) as qual, sample,
            gt || ':' || dp as value from genotypes""")
def _(fx):
    p = write_text(fx, "vcf", {"vcf": vcf_lines(fx)})
    v = src.read_vcf(fx.spark, p, contigs=fx.ctg_lengths)
    return v.select("chrom", "start_bp", "end_bp", "id", "ref", "alt", "filter", "info",
                    F.round(F.col("qual").cast("double"), 2).alias("qual"), F.explode("samples").alias("s")).select(
        "chrom", "start_bp", "end_bp", "id", "ref", "alt", "filter", "info", "qual", "s.sample", "s.value")


@query("vcf_sample_names", "genotypes", f"select distinct event_id // {EVENTS_A_FILE} as slice, sample from genotypes")
def _(fx):
    return src.vcf_sample_names(fx.spark, write_text(fx, "vcf", {"vcf": vcf_lines(fx)})).select(
        F.regexp_extract("file", r"slice=(\d+)/", 1).cast("bigint").alias("slice"), F.explode("sample_names").alias("sample"))


@query("read_alignments", "alignments",
       """select name, flags, chrom, start_bp, end_bp, mapq, cigar, mate_chrom, mate_pos, tlen, read_seq, md from alignments""")
def _(fx):
    p = write_text(fx, "sam", {"a": sam_lines(fx)})
    return src.read_alignments(fx.spark, p).drop("source")


def _mixed(fx):
    """Many small gzip files of all kinds; as plain text they take four times the disk."""
    contigs = fx.contigs.where("length(seq) > 0")
    return write_text(fx, "mixed", {
        "reference.fasta": contigs.select(doc_slice(), F.concat(F.lit(">"), F.col("chrom"), F.lit("\n"), wrapped()).alias("value")),
        "notes.txt": fx.documents.select(doc_slice(), F.lit("plain text").alias("value")),
        "annotation.gff3": gff_lines(fx).select(F.expr("cast(substring(split(value, '\t')[0], 4) as int)").alias("slice"), "value"),
        "embedded.gff3": gff_with_fasta(fx), "calls.vcf": vcf_lines(fx), "records.gb": genbank_lines(fx)},
        compression="gzip")


def _folder(c="file"):
    return F.regexp_extract(c, r"/([^/]+)/slice=\d+/[^/]+$", 1)


#: (folder, files) of the mixed input, counted from the tables.
MIXED = f"""with f as (select 'reference.fasta' as folder, 'fasta' as kind, doc_id // {DOCS_A_FILE} as slice from contigs where length(seq) > 0
  union select 'embedded.gff3', 'gff3', doc_id // {DOCS_A_FILE} from contigs where length(seq) > 0
  union select 'notes.txt', 'unknown', doc_id // {DOCS_A_FILE} from documents
  union select 'records.gb', 'flatfile', doc_id // {DOCS_A_FILE} from contigs
  union select 'annotation.gff3', 'gff3', cast(substr(chrom, 4) as bigint) from features
  union select 'calls.vcf', 'vcf', event_id // {EVENTS_A_FILE} from variants)"""


@query("detect_input_kinds", "contigs features variants", MIXED + " select folder, kind, count(*) as files from f group by 1, 2")
def _(fx):
    kinds = src.detect_input_kinds(fx.spark, _mixed(fx))
    return kinds.groupBy(_folder().alias("folder"), "kind").agg(F.count("*").alias("files"))


@query("inspect_inputs", "contigs features variants",
       MIXED + """ select folder, kind in ('fasta', 'flatfile') or folder like 'embedded%' as has_sequence, kind = 'gff3' as has_annotation,
         folder like 'embedded%' as has_embedded_sequence, kind = 'vcf' as has_variants, count(*) as files from f group by all""")
def _(fx):
    flags = ["has_sequence", "has_annotation", "has_embedded_sequence", "has_variants"]
    return src.inspect_inputs(fx.spark, _mixed(fx)).groupBy(_folder().alias("folder"), *flags).agg(F.count("*").alias("files"))


@query("gather_inputs", "contigs features variants", MIXED + " select folder, slice from f where kind <> 'unknown'")
def _(fx):
    return src.gather_inputs(fx.spark, _mixed(fx)).select(
        _folder().alias("folder"), F.regexp_extract("file", r"slice=(\d+)/", 1).cast("bigint").alias("slice"))


@query("load_genome", "contigs",
       """select chrom, cast(greatest(length(seq), length(seq) + doc_id % 3 * 10 - 10) as int) as length, md5(seq) as digest,
            1 as n_features from contigs where length(seq) > 0""")
def _(fx):
    seqs = fx.contigs.where("length(seq) > 0")
    # One feature a contig, under a versioned name and partly beyond its end.
    feats = seqs.select(
        F.concat("chrom", F.lit(".1")).alias("chrom"), F.lit("ref").alias("source"), F.lit("gene").alias("type"), F.lit(0).alias("start_bp"),
        F.expr("cast(length(seq) + doc_id % 3 * 10 - 10 as int)").alias("end_bp"), F.lit("+").alias("strand"),
        F.lit(-1).cast("tinyint").alias("phase"), F.lit("").alias("attributes"))
    seqs = seqs.select("chrom", "seq")
    contigs, placed = src.load_genome([seqs, seqs.where("length(seq) % 2 = 0")], [feats])
    per = placed.groupBy("chrom").agg(F.count("*").cast("int").alias("n_features"))
    return contigs.join(per, "chrom").select("chrom", "length", F.md5("seq").alias("digest"), "n_features")


@query("workspace", "cmp_contigs cmp_blocks",
       """select genome, count(*) as n, cast(sum(length(seq)) as bigint) as bases, cast(sum(case when doc_id % 4 = 2 then 1 else 0 end)
            as bigint) as n_reversed, cast(max(n_blocks) as bigint) as n_blocks from cmp_contigs left join (select q_genome,
            count(*) as n_blocks from cmp_blocks group by 1) b on b.q_genome = genome group by genome""")
def _(fx):
    path = scratch_path(fx.spark, "workspace")
    src.save_workspace(path, contigs=fx.cmp_contigs, segments=segments(fx), blocks=fx.cmp_blocks)
    t = src.load_workspace(fx.spark, path, "contigs", "segments", "blocks")
    seg = t["segments"].select("genome", "chrom", "reversed")
    blocks = t["blocks"].groupBy(F.col("q_genome").alias("genome")).agg(F.count("*").alias("n_blocks"))
    per = t["contigs"].join(seg, ["genome", "chrom"]).groupBy("genome").agg(
        F.count("*").alias("n"), F.sum(F.length("seq")).alias("bases"), F.sum(F.col("reversed").cast("int")).alias("n_reversed"))
    return per.join(blocks, "genome", "left")


@query("block_details_store")
def _(fx):
    """Details of all found blocks, computed in two runs of which the second finds the first one's stored."""
    from strandlake.operators import compare as cp
    from strandlake.plans.comparison import found

    path = scratch_path(fx.spark, "details")
    blocks = found(fx)[0].withColumn("block_id", F.md5(F.concat_ws("|", *cp.MERGED)))
    detail = lambda flag: lambda rows: cp.block_detail(rows, fx.cmp_contigs)[0].withColumn("early", F.lit(flag))
    early = blocks.where("block_id < '8'")
    src.save_block_details(fx.spark, path, early, detail(True))
    stored = src.save_block_details(fx.spark, path, blocks, detail(False))
    return stored.select("block_id", "q_start", "q_end", "t_start", "t_end", "ident_x100", "status", "early")
