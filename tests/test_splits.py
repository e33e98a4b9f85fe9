"""Byte splits and the readers on them: borders anywhere, lines and contigs of any length, every codec."""

import bz2
import gzip
import io
import lzma
import random
import struct
import zlib

import pytest

from strandlake import sources as src
from strandlake.sources import splits as sp
from strandlake.sources.chunked import read_fasta_chunks, read_gff3_chunks


def bgzf(data: bytes, sizes=(700,)) -> bytes:
    """Blocks of the given sizes in turn, and the empty block at the end."""
    out, at, k = b"", 0, 0
    parts = []
    while at < len(data):
        n = sizes[k % len(sizes)]
        parts.append(data[at:at + n])
        at, k = at + n, k + 1
    for part in [*parts, b""]:
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25)
        out += head + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def all_pieces(make, size, split, longest):
    rows = []
    for start in range(0, size, split):
        for places, heads, values in sp.pieces(make(), start, start + split if start + split < size else None, longest):
            rows += zip(places.tolist(), heads.tolist(), values)
    return rows


@pytest.mark.parametrize("seed", range(12))
def test_pieces_give_every_line_once(seed):
    rng = random.Random(seed)
    lines = [bytes(rng.choice(b"acgt") for _ in range(rng.choice([0, 0, 1, 5, 30, 63, 64, 65, 200, 3000]))) for _ in range(rng.choice([1, 40, 120]))]
    data = b"\n".join(lines) + (b"\n" if rng.random() < 0.5 else b"")
    packed = bgzf(data, rng.choice([(700,), (1,), (90, 3, 500), (65280,)]))
    kinds = {"plain": (lambda: sp.Plain(io.BytesIO(data)), len(data)), "bgzf": (lambda: sp.Bgzf(io.BytesIO(packed), len(packed)), len(packed))}
    want = data.split(b"\n")
    want = want[:-1] if want[-1] == b"" else want
    for kind, (make, size) in kinds.items():
        for split in (7, 64, 501, 10_000):
            rows = all_pieces(make, size, split, 64)
            places = [r[0] for r in rows]
            assert places == sorted(places), (kind, split)
            got = []
            for _, head, value in rows:
                assert len(value) <= 64 or (kind == "bgzf" and len(value) <= 64)
                if head:
                    got.append(value)
                else:
                    got[-1] += value
            assert got == want, (kind, split)
            whole = {r[2] for r in rows if r[1]}
            assert {x for x in want if len(x) <= 64} <= whole  # short lines are never cut


def plain_fasta(text):
    seqs, name = {}, None
    for line in text.split("\n"):
        line = line.strip()
        if line.startswith(">"):
            name = line[1:].split()[0]
            seqs.pop(name, None)
            seqs[name] = ""
        elif line:
            seqs[name] += "".join(c for c in line if c.isalpha() or c in "*-").upper()
    return seqs


def some_fasta(rng):
    out = ["", "  ", ">first of all"]
    for i in range(rng.choice([3, 12])):
        width = rng.choice([1, 60, 70, 5000])
        seq = "".join(rng.choice("acgtnACGT*-") for _ in range(rng.choice([0, 1, 64, 640, 5000, 20_000])))
        out += [seq[k:k + width] + rng.choice(["", "\r", " 12"]) for k in range(0, len(seq), width)]
        out += [rng.choice([">", "  >", "> "]) + f"c{rng.randrange(8)} text {i}"]
    return "\n".join(out) + "\nAC GT\n"


def contigs_of(df):
    """Contigs put together, with every chunk where it belongs."""
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.chrom, r.chunk)):
        assert r.start_bp == len(got.setdefault(r.chrom, "")) == r.chunk * 64 and len(r.bases) <= 64
        got[r.chrom] += bytes(r.bases).decode()
        assert r.length >= len(got[r.chrom])
        got[r.chrom, "n"] = r.length
    assert all(got[c, "n"] == len(got[c]) for c in [k for k in got if isinstance(k, str)])
    return {k: v for k, v in got.items() if isinstance(k, str)}


@pytest.mark.parametrize("seed", range(3))
def test_fasta_chunks_equal_a_plain_reader(spark, tmp_path, seed):
    text = some_fasta(random.Random(seed))
    (tmp_path / "a.fa").write_bytes(text.encode())
    (tmp_path / "b.fa.bgz").write_bytes(bgzf(text.encode(), (600, 20)))
    want = plain_fasta(text)
    for name in ("a.fa", "b.fa.bgz"):
        assert contigs_of(read_fasta_chunks(spark, str(tmp_path / name), chunk=64, split=2000)) == want, name
    assert {r.chrom: r.seq for r in src.read_fasta(spark, str(tmp_path / "a.fa")).collect()} == want


@pytest.mark.parametrize("name,pack", [("a.fa.gz", gzip.compress), ("a.fa.bz2", bz2.compress), ("a.fa.xz", lzma.compress), ("a.fa.zst", None)])
def test_fasta_of_every_codec(spark, tmp_path, name, pack):
    if pack is None:
        pack = pytest.importorskip("zstandard").ZstdCompressor().compress
    text = some_fasta(random.Random(9))
    (tmp_path / name).write_bytes(pack(text.encode()))
    assert contigs_of(read_fasta_chunks(spark, str(tmp_path / name), chunk=64, split=2000)) == plain_fasta(text)


def test_a_contig_on_one_line_is_read_by_several_tasks(spark, tmp_path):
    rng = random.Random(5)
    seq = "".join(rng.choices("ACGT", k=1 << 16)) * 80
    (tmp_path / "one.fa").write_text(">c one line\n" + seq + "\n>d\nAC\n")
    at = sp.splits(sp.listing(spark, str(tmp_path / "one.fa")), 1 << 20)
    assert at.count() == 6
    df = read_fasta_chunks(spark, str(tmp_path / "one.fa"), split=1 << 20)
    rows = {(r.chrom, r.chunk): r for r in df.collect()}
    assert max(len(r.bases) for r in rows.values()) == 1 << 16 and len(rows) == 81
    assert all(bytes(rows["c", k].bases).decode() == seq[:1 << 16] for k in range(80)) and rows["c", 3].length == len(seq)


def test_embedded_fasta_over_splits(spark, tmp_path):
    rng = random.Random(6)
    fasta = some_fasta(rng).split("\n", 2)[2].replace(">first of all", ">first of all\nA")
    want = {k: v for k, v in plain_fasta(fasta).items()}
    ann = "".join(f"c1\ts\tgene\t{i}\t{i + 9}\t.\t+\t.\tID=g{i}\n" for i in range(1, 200))
    for i in range(3):  # one table of many files
        (tmp_path / f"{i}.gff3").write_text("##gff-version 3\n" + ann * (i + 1) + " ##FASTA \n" + fasta)
    (tmp_path / "none.gff3").write_text("##gff-version 3\n" + ann)
    df = read_gff3_chunks(spark, str(tmp_path), strict=False, chunk=64, split=1500)
    for i in range(3):
        assert contigs_of(df.where(f"file like '%/{i}.gff3'")) == want
    flags = {r.file.rsplit("/", 1)[1]: r.has_embedded_sequence for r in src.inspect_inputs(spark, str(tmp_path)).collect()}
    assert flags == {"0.gff3": True, "1.gff3": True, "2.gff3": True, "none.gff3": False}
    assert src.read_gff3(spark, str(tmp_path)).count() == 199 * 7


def flat_text(form, records):
    out = ""
    for name, feats, seq in records:
        if form == "genbank":
            out += f"LOCUS       {name}   {len(seq)} bp    DNA\nDEFINITION  some\nFEATURES             Location/Qualifiers\n"
            margin, cont = "     {:<16}{}\n", "                     {}\n"
        else:
            out += f"ID   {name}; SV 1; linear\nXX\nFH   Key             Location\n"
            margin, cont = "FT   {:<16}{}\n", "FT                   {}\n"
        for kind, loc, quals in feats:
            out += margin.format(kind, loc) + "".join(cont.format(q) for q in quals)
        if seq is not None:
            out += "ORIGIN\n" if form == "genbank" else "SQ   Sequence\n"
            out += "".join(f"{k:>9} {seq[k:k + 60]}\n" for k in range(0, len(seq), 60))
        out += "//\n"
    return out


@pytest.mark.parametrize("form", ["genbank", "embl"])
@pytest.mark.parametrize("split", [150, 1000, 1 << 20])
def test_flat_files_over_splits(spark, tmp_path, form, split):
    rng = random.Random(7)
    records, want = [], {}
    for i in range(14):
        feats = [(rng.choice(["gene", "CDS", "exon"]), rng.choice([f"{a}..{a + 30}", f"complement({a}..{a + 7})", "9..3", "0..0"]),
                  [rng.choice([f'/gene="g{a}"', "/pseudo", f'/note="n {a} x"']) for _ in range(rng.randrange(9))])
                 for a in (rng.randrange(1, 900) for _ in range(rng.randrange(12)))]
        seq = "".join(rng.choices("acgtn", k=rng.choice([0, 5, 64, 128, 3000])))
        records.append((f"r{rng.randrange(10)}", feats, seq))
    ends = []
    for name, feats, seq in records:
        if seq:
            want[name] = seq.upper()
        for kind, loc, quals in feats:
            lo, hi = map(int, loc.removeprefix("complement(").removesuffix(")").split(".."))
            if max(lo, hi):
                ends.append((name, kind, min(lo, hi) - 1, max(lo, hi), "-" if "(" in loc else "+", ";".join(q[1:].replace('"', "") for q in quals)))
    (tmp_path / "a.txt").write_text(flat_text(form, records))
    from strandlake.sources.genome import read_embl_chunks, read_genbank_chunks

    chunks, feats = (read_genbank_chunks if form == "genbank" else read_embl_chunks)(spark, str(tmp_path / "a.txt"), chunk=64, split=split)
    assert contigs_of(chunks) == want
    got = sorted((r.chrom, r.type, r.start_bp, r.end_bp, r.strand, r.attributes) for r in feats.collect())
    assert got == sorted(ends)


def test_vcf_in_bgzf_is_read_by_several_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    samples = [f"sample{i}" for i in range(3000)]
    head = "##fileformat=VCFv4.2\n" + "##INFO=x\n" * 50 + "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t" + "\t".join(samples) + "\n"
    body = "".join(f"c1\t{i}\tv{i}\tA\tC\t.\tPASS\t.\tGT\t" + "\t".join("0/1" for _ in samples) + "\n" for i in range(1, 60))
    (tmp_path / "a.vcf.bgz").write_bytes(bgzf((head + body).encode(), (65000,)))
    (tmp_path / "b.vcf.gz").write_bytes(gzip.compress((head + body).encode()))
    (tmp_path / "c.vcf").write_text(head + body)
    for name in ("a.vcf.bgz", "b.vcf.gz", "c.vcf"):
        v = src.read_vcf(spark, str(tmp_path / name))
        assert sorted(r.id for r in v.select("id").collect()) == sorted(f"v{i}" for i in range(1, 60)), name
        assert [tuple(x) for x in v.select("samples").first().samples[-1:]] == [("sample2999", "0/1")]
    assert src.read_vcf(spark, str(tmp_path)).count() == 177
    names = {r.file.rsplit("/", 1)[1]: len(r.sample_names) for r in src.vcf_sample_names(spark, str(tmp_path)).collect()}
    assert names == {"a.vcf.bgz": 3000, "b.vcf.gz": 3000, "c.vcf": 3000}
    kinds = {r.file.rsplit("/", 1)[1]: r.kind for r in src.detect_input_kinds(spark, str(tmp_path)).collect()}
    assert set(kinds.values()) == {"vcf"}
    lines = sp.split_lines(spark, sp.listing(spark, str(tmp_path / "a.vcf.bgz")), split=2000)
    assert lines.select(F.count_distinct("block")).first()[0] > 1 and lines.count() == 111


class Counted(io.BytesIO):
    n = 0

    def read(self, k=-1):
        out = super().read(k)
        Counted.n += len(out)
        return out


def test_heads_read_no_more_than_the_first_lines(monkeypatch):
    from strandlake.sources.lines import _first

    data = b"\n\n>c1 x\n" + b"ACGT" * 5_000_000
    Counted.n = 0
    assert _first(sp.Plain(Counted(data)), lambda x: True, lambda x: x.strip() or None, sp.LONGEST) == b">c1 x"
    assert Counted.n <= sp.STEP


def test_sequence_operators_give_the_same_on_chunks(spark, tmp_path):
    from pyspark.sql import functions as F

    from strandlake.operators import sequence as sq

    rng = random.Random(8)
    seqs = {f"c{n}": "".join(rng.choices("ACGTN", (30, 30, 30, 30, 1), k=n)) for n in (1, 24, 63, 64, 65, 200, 1000)}
    (tmp_path / "a.fa").write_text("".join(f">{c}\n{s}\n" for c, s in seqs.items()))
    chunks = read_fasta_chunks(spark, str(tmp_path / "a.fa"), chunk=64, split=300).drop("file")
    rows = spark.createDataFrame([(c, s) for c, s in seqs.items()], "chrom string, seq string")
    flip = spark.createDataFrame([(c, i % 2 == 0) for i, c in enumerate(seqs)], "chrom string, reversed boolean")
    words = spark.createDataFrame([("ACG",), ("GGA",), (seqs["c1000"][30:250],), (seqs["c200"][60:68],)], "pattern string")
    regions = spark.createDataFrame([(i, c, a, a + n) for i, (c, a, n) in enumerate((c, a, n) for c in seqs for a in (-5, 0, 63, 500) for n in (0, 1, 200))],
                                    "id int, chrom string, start_bp int, end_bp int")
    same = {
        "cuts": lambda t: sq.seq_chunks(t, step=50, overlap=150),
        "cuts of a part": lambda t: sq.seq_chunks(t, step=16, overlap=3),
        "search": lambda t: sq.dna_search(t, words, step=16),
        "minimizers": lambda t: sq.minimizers(t, k=5, w=4, step=64),
        "reverse minimizers": lambda t: sq.minimizers(t, k=5, w=4, reverse=True, step=64),
        "gc": lambda t: sq.gc_plot(t, window=30, bins=32, step=32),
        "slices": lambda t: sq.reference_slices(t, regions, id_cols=("id",), step=16),
        "frames": lambda t: sq.six_frame_translation(t, piece=7),
    }
    for name, run in same.items():
        a, b = ([tuple(r) for r in run(t).collect()] for t in (rows, chunks))
        assert sorted(map(str, a)) == sorted(map(str, b)) and a, name
    turned = sq.apply_orientation_sequence(chunks, flip)
    want = {r.chrom: r.seq for r in sq.apply_orientation_sequence(rows, flip).collect()}
    assert contigs_of(turned) == want
    assert turned.where(F.length("bases") > 64).count() == 0
