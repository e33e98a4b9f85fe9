"""Readers on small literal files."""

import pytest

from strandlake import sources as src


def put(path, text):
    path.write_text(text)
    return str(path)


def test_fasta(spark, tmp_path):
    p = put(tmp_path / "a.fa", "\n>c1 first one\nac gt12\nN-*\n\n>c2\r\nTTTT\r\n>c1 again\nGG\n")
    assert sorted((r.chrom, r.length, r.seq) for r in src.read_fasta(spark, p).collect()) == [("c1", 2, "GG"), ("c2", 4, "TTTT")]
    with pytest.raises(ValueError, match="before header"):
        src.read_fasta(spark, put(tmp_path / "b.fa", "ACGT\n>c1\nAC\n"))
    with pytest.raises(ValueError, match="no sequences"):
        src.read_fasta(spark, put(tmp_path / "c.fa", "\n\n"))


GFF = "##gff-version 3\nc1\ts\tCDS\t5\t10\t.\t-\t2\tID=a\nc1\ts\tgene\tx\t10\t.\t+\t.\tID=b\nshort\tline\nc1\ts\tgene\t1\t9\t.\t\t7\tID=c\n"


def test_gff3_and_embedded_sequences(spark, tmp_path):
    p = put(tmp_path / "a.gff3", GFF + "##FASTA\n>c1 d\nAC\nGT\n>c2\nTT\n")
    rows = src.read_gff3(spark, p).orderBy("attributes").collect()
    assert [(r.start_bp, r.end_bp, r.strand, r.phase, r.attributes) for r in rows] == [(4, 10, "-", 2, "ID=a"), (0, 9, ".", -1, "ID=c")]
    assert sorted((r.chrom, r.seq) for r in src.read_gff3_sequences(spark, p).collect()) == [("c1", "ACGT"), ("c2", "TT")]
    bad = put(tmp_path / "b.gff3", GFF + "##FASTA\n>c1\n>c2\nTT\n")
    with pytest.raises(Exception, match="empty FASTA sequence"):
        src.read_gff3_sequences(spark, bad).collect()


def test_flat_files(spark, tmp_path):
    gb = put(tmp_path / "a.gb", (
        "LOCUS       rec1   12 bp\nFEATURES             Location/Qualifiers\n     source          1..12\n"
        '                     /organism="x y"\n     CDS             complement(join(2..4,\n                     6..9))\n'
        "                     /gene=\"g\"\n                     /pseudo\n     gap             9..3\nORIGIN\n"
        "        1 acgtac gtacgt\n//\nLOCUS       rec2   4 bp\nORIGIN\n 1 tttt\n//\n"))
    contigs, feats = src.read_genbank(spark, gb)
    assert sorted((r.chrom, r.seq) for r in contigs.collect()) == [("rec1", "ACGTACGTACGT"), ("rec2", "TTTT")]
    assert sorted((r.type, r.start_bp, r.end_bp, r.strand, r.phase, r.attributes) for r in feats.collect()) == [
        ("CDS", 1, 4, "-", 0, "gene=g;pseudo"), ("gap", 2, 9, "+", 0, ""), ("source", 0, 12, "+", 0, "organism=x y")]
    em = put(tmp_path / "a.embl", (
        "ID   rec1; SV 1;\nFH   Key\nFT   gene            3..8\nFT                   /gene=\"g\"\nSQ   Sequence 8 BP;\n     acgt acgt 8\n//\n"))
    contigs, feats = src.read_embl(spark, em)
    assert [(r.chrom, r.seq) for r in contigs.collect()] == [("rec1", "ACGTACGT")]
    assert [(r.type, r.start_bp, r.end_bp, r.attributes) for r in feats.collect()] == [("gene", 2, 8, "gene=g")]


VCF = ("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\n"
       "c1\t3\t.\tC\tT\t50\tPASS\tDP=3\tGT:DP\t0/1:3\t1/1:4\nc1\t9\td\tN\t<DEL>\t.\tq\tEND=40\tGT\t0/0\t./.\n")


def test_vcf(spark, tmp_path):
    p = put(tmp_path / "a.vcf", VCF)
    rows = src.read_vcf(spark, p).orderBy("start_bp").collect()
    assert [(r.start_bp, r.end_bp, r.qual) for r in rows] == [(2, 3, 50.0), (8, 40, None)]
    assert [tuple(s) for s in rows[0].samples] == [("a", "0/1:3"), ("b", "1/1:4")]
    assert src.vcf_sample_names(spark, p).first().sample_names == ["a", "b"]
    contigs = spark.createDataFrame([("c1.2", 100)], "chrom string, length int")
    assert src.read_vcf(spark, p, contigs=contigs).first().chrom == "c1.2"
    with pytest.raises(ValueError, match="do not match"):
        src.read_vcf(spark, p, contigs=spark.createDataFrame([("z", 1)], "chrom string, length int"))


def test_sam_detection_and_listing(spark, tmp_path):
    p = put(tmp_path / "r.sam", "@HD\tVN:1\nr1\t99\tc1\t201\t60\t5M\t=\t421\t225\tACGTA\t*\tMD:Z:2A2\nr2\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n")
    a = {r.name: r for r in src.read_alignments(spark, p).collect()}
    assert (a["r1"].start_bp, a["r1"].end_bp, a["r1"].mate_chrom, a["r1"].mate_pos, a["r1"].md) == (200, 205, "c1", 420, "2A2")
    assert a["r2"].chrom is None and a["r2"].mate_pos == -1
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    put(d / "x.txt", "\n\n>c1\nAC\n")
    put(d / "empty.gff3", "\n")
    put(d / "sub" / "v.txt", VCF)
    put(d / "sub" / "e.txt", GFF + "##FASTA\n>c1\nAC\n")
    put(d / "n.md", "hello\n")
    kinds = {r.file.rsplit("/", 1)[1]: r.kind for r in src.detect_input_kinds(spark, str(d)).collect()}
    assert kinds == {"x.txt": "fasta", "empty.gff3": "gff3", "v.txt": "vcf", "e.txt": "gff3", "n.md": "unknown"}
    assert [r.file.rsplit("/", 1)[1] for r in src.gather_inputs(spark, str(d)).collect()] == ["empty.gff3", "e.txt", "v.txt", "x.txt"]
    flags = {r.file.rsplit("/", 1)[1]: r for r in src.inspect_inputs(spark, str(d)).collect()}
    assert flags["e.txt"].has_embedded_sequence and flags["e.txt"].has_sequence and not flags["empty.gff3"].has_sequence


def test_workspace_round_trip(spark, tmp_path):
    seg = spark.createDataFrame([("01", "c1", 0, 10, True), ("2", "c2", 0, 5, False)],
                                "genome string, chrom string, start_bp int, end_bp int, reversed boolean")
    src.save_workspace(str(tmp_path / "w"), segments=seg)
    back = src.load_workspace(spark, str(tmp_path / "w"), "segments")["segments"].select(*seg.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, seg.collect()))
