"""Sequence tables in chunks, and FASTA and flat files read into them split by split (A1, A3-A5).

Two passes over the bytes: the first gives a row or two for each split (what is open at its end, how many bases lie before
its first and after its last mark); windows over those rows tell every split the state it begins in, and the second pass
cuts its bases along the contig's own grid. Only the chunks that a split border goes through are put together by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from strandlake.operators.sequence import SEQ_CHUNK, assemble
from strandlake.session import materialize
from strandlake.sources.splits import LONGEST, Pieces, listing, parsed, splits

_BOM = "﻿".encode()
_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
_UPPER = bytes.maketrans(bytes(range(97, 123)), bytes(range(65, 91)))
_NOT_FASTA = bytes(c for c in range(128) if c not in _LETTERS + b"*-")
_NOT_FLAT = bytes(c for c in range(128) if c not in _LETTERS)


def bases_of(line: bytes, drop: bytes) -> bytes:
    """The letters of a sequence line in upper case, without the bytes of ``drop``; other scripts' letters stay too."""
    out = line.translate(_UPPER, drop)
    return out if out.isascii() else "".join(c for c in out.decode("utf-8", "ignore") if c.isalpha() or c in "*-").upper().encode()


class Cutter:
    """Bases of one contig after the other, cut along the grid: (.., chunk, start_bp, bases, whole) for each chunk."""

    def __init__(self, chunk: int):
        self.chunk, self.key, self.at, self.held, self.size = chunk, None, 0, [], 0
        self.from_grid = True

    def begin(self, key: tuple, at: int = 0) -> None:
        self.key, self.at, self.from_grid = key, at, at % self.chunk == 0

    def add(self, bases: bytes) -> Iterator[tuple]:
        while bases:
            room = self.chunk - (self.at + self.size) % self.chunk
            part, bases = bases[:room], bases[room:]
            self.held.append(part)
            self.size += len(part)
            if len(part) == room:
                yield from self.end(True)

    def end(self, whole: bool) -> Iterator[tuple]:
        """What is held as a chunk; ``whole`` if nothing can follow in it."""
        if self.size:
            yield (*self.key, self.at // self.chunk, self.at, self.size, b"".join(self.held), whole and self.from_grid)
            self.at += self.size
            self.held, self.size, self.from_grid = [], 0, self.at % self.chunk == 0


# FASTA

_PARTS = pa.schema([("file", pa.string()), ("pos", pa.int64()), ("chrom", pa.string()), ("chunk", pa.int32()), ("start_bp", pa.int32()),
                    ("n", pa.int32()), ("bases", pa.binary()), ("whole", pa.bool_())])
_PARTS_DDL = "file string, pos long, chrom string, chunk int, start_bp int, n int, bases binary, whole boolean"
#: Contigs whose names and lengths are sent to every task at most; above that they meet the chunks by a shuffle.
SENT = 200_000


def _fasta_lines(found: Pieces, row: dict) -> Iterator[tuple[int, str | None, bytes]]:
    """(place, contig name, b'') for headers and (place, None, line) for all other lines with something in them."""
    after = row.get("after")
    for places, heads, values in found:
        marks = [i for i, v in enumerate(values) if v[:1] <= b">"]  # headers, and lines that begin with a space or a digit
        if after is not None or places[0] == 0:
            marks = range(len(values))
        at = 0
        for i in marks:
            if i > at:
                yield int(places[at]), None, b"".join(values[at:i])
            at = i + 1
            p, v = int(places[i]), values[i]
            if after is not None and p <= after:
                continue
            if p == 0 and v.startswith(_BOM):
                v = v[len(_BOM):]
            if heads[i] and (s := v.strip()).startswith(b">"):
                name = s[1:].split(None, 1)
                if not name:
                    raise ValueError(f"invalid FASTA header in {row['file']}")
                yield p, name[0].decode("utf-8", "replace"), b""
            elif v and not v.isspace():
                yield p, None, v
        if at < len(values):
            yield int(places[at]), None, b"".join(values[at:])


def fasta_chunks(at: DataFrame, *, chunk: int = SEQ_CHUNK) -> tuple[DataFrame, DataFrame]:
    """(contigs, chunks) of FASTA splits: (file, pos, chrom, length) and (file, pos, chrom, chunk, start_bp, bases).

    ``pos`` is the place of the header. Text before the first header is a contig without name and pos. ``at`` may have a column
    ``after``: the place of the line after which FASTA text begins.
    """
    fields = pa.schema([("file", pa.string()), ("start", pa.int64()), ("pos", pa.int64()), ("chrom", pa.string()), ("n", pa.int64())])

    def summary(found: Pieces, row: dict) -> Iterator[tuple]:
        last, n = (None, None), 0
        for p, name, line in _fasta_lines(found, row):
            if name is not None:
                last, n = (p, name), 0
            else:
                n += len(bases_of(line, _NOT_FASTA))
        yield row["file"], row["start"], *last, n

    ends = materialize(parsed(at, summary, fields, "file string, start long, pos long, chrom string, n long"), "fasta-splits")
    order = W.partitionBy("file").orderBy("start")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    run = ends.withColumns({"p": F.last("pos", True).over(upto), "c": F.last("chrom", True).over(upto)})
    same = W.partitionBy("file", "p").orderBy("start").rowsBetween(W.unboundedPreceding, 0)
    run = run.withColumn("so_far", F.sum("n").over(same))
    opened = run.select("file", "start", *(F.lag(c).over(order).alias(f"open_{c}") for c in ("p", "c", "so_far")))

    def cut(found: Pieces, row: dict) -> Iterator[tuple]:
        cutter = Cutter(chunk)
        cutter.begin((row["file"], row["open_p"], row["open_c"]), row["open_so_far"] or 0)
        for p, name, line in _fasta_lines(found, row):
            if name is not None:
                yield from cutter.end(True)
                cutter.begin((row["file"], p, name))
                yield row["file"], p, name, None, 0, 0, b"", True  # a contig, also without bases
            else:
                if cutter.key[1] is None:
                    yield row["file"], None, None, None, 0, 0, b"", True
                yield from cutter.add(bases_of(line, _NOT_FASTA))
        yield from cutter.end(row["stop"] is None)

    known = at.join(opened, ["file", "start"])
    parts = materialize(parsed(known, cut, _PARTS, _PARTS_DDL), "fasta-chunks")
    contigs = parts.groupBy("file", "pos", "chrom").agg(F.sum("n").cast("int").alias("length"))
    return contigs, assemble(parts.where("chunk is not null"), ["file", "pos", "chrom"])


def last_named(contigs: DataFrame) -> DataFrame:
    """Of contigs of equal names in a file the last one."""
    return contigs.groupBy("file", "chrom").agg(F.max_by("length", "pos").alias("length"), F.max("pos").alias("pos"))


def named_chunks(contigs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file, chrom, chunk, start_bp, length, bases) of the contigs that stay; one without bases is one empty chunk."""
    keep = materialize(last_named(contigs.where("pos is not null")), "contigs")
    out = chunks.drop("chrom").join(F.broadcast(keep) if keep.count() <= SENT else keep, ["file", "pos"]).select("file", "chrom", "chunk", "start_bp", "length", "bases")
    none = keep.where("length = 0").select("file", "chrom", F.lit(0).alias("chunk"), F.lit(0).alias("start_bp"), "length", F.lit(b"").alias("bases"))
    return out.unionByName(none)


def whole(chunks: DataFrame, *keys: str) -> DataFrame:
    """(keys, length, seq): contigs put together, for contigs that fit into a row."""
    bases = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", F.decode("bases", "UTF-8").alias("s")))), lambda x: x["s"]), "")
    return chunks.groupBy(*keys).agg(bases.alias("seq")).select(*keys, F.length("seq").cast("int").alias("length"), "seq")


def read_fasta_chunks(spark: SparkSession, path: str | list[str], *, strict: bool = True, chunk: int = SEQ_CHUNK, split: int | None = None) -> DataFrame:
    """A1 for contigs of any length: (file, chrom, chunk, start_bp, length, bases), ``chunk`` bases a row.

    A contig on one line is read by as many tasks as its file has splits. Sequence before the first header is an error when strict,
    else left out; of equal names in a file the last stays; no sequence at all is an error when strict. Letters beyond ASCII stay and count as
    their UTF-8 bytes.
    """
    contigs, chunks = fasta_chunks(splits(listing(spark, path), *([split] if split else [])), chunk=chunk)
    if strict:
        early = contigs.where("pos is null").limit(1).collect()
        if early:
            raise ValueError(f"FASTA sequence before header in {early[0]['file']}")
        if contigs.isEmpty():
            raise ValueError(f"no sequences found in {path}")
    return named_chunks(contigs, chunks)


def fasta_marks(at: DataFrame) -> DataFrame:
    """(file, after): the place of the first ``##FASTA`` line of each file that has one."""
    def mark(found: Pieces, row: dict) -> Iterator[tuple]:
        for places, heads, values in found:
            for i, v in enumerate(values):
                if b"##FASTA" in v and heads[i] and v.strip() == b"##FASTA":
                    yield row["file"], int(places[i])
                    return

    fields = pa.schema([("file", pa.string()), ("after", pa.int64())])
    return parsed(at, mark, fields, "file string, after long").groupBy("file").agg(F.min("after").alias("after"))


def read_gff3_chunks(spark: SparkSession, path: str | list[str], *, strict: bool = True, chunk: int = SEQ_CHUNK, split: int | None = None) -> DataFrame:
    """A3 for contigs of any length: the sequence after the first ``##FASTA`` line of GFF3 files, as ``read_fasta_chunks``.

    One pass looks for that line; splits before it are not read again. A contig without sequence is an error when strict.
    """
    at = splits(listing(spark, path), *([split] if split else []))
    marks = materialize(fasta_marks(at), "fasta-marks")
    key = F.when(F.col("codec") == "bgzf", F.shiftright("after", 16)).otherwise(F.col("after"))
    inside = at.join(marks, "file").where(F.col("stop").isNull() | (F.col("stop") > key))
    contigs, chunks = fasta_chunks(inside, chunk=chunk)
    if strict:
        bad = contigs.where("pos is null or length = 0").limit(1).collect()
        if bad:
            raise ValueError(f"{'sequence before FASTA header' if bad[0]['pos'] is None else 'empty FASTA sequence'} in {bad[0]['file']}")
    return named_chunks(contigs, chunks)


# Flat files

#: Fixed values of the two formats: what begins a record, a feature table and a sequence, and the place of a location.
GENBANK = {"record": re.compile(rb"LOCUS"), "features": re.compile(rb"\s*FEATURES"), "origin": re.compile(rb"\s*ORIGIN")}
EMBL = {"record": re.compile(rb"ID\s"), "features": re.compile(rb"FH"), "origin": re.compile(rb"SQ")}
LOCATION_AT = 21


class FlatFile:
    """The states of a flat file line by line: which record, which section, which feature."""

    def __init__(self, form: dict, row: dict):
        self.form = form
        self.name, self.pos = row.get("name"), row.get("pos")
        self.section, self.feature = row.get("section"), row.get("feature")

    def mark(self, place: int, head: bool, line: bytes) -> str | None:
        """What the line begins: record, end, features, origin; the state follows it. None for all other lines."""
        if not head or line[:1] > b"Z":
            return None
        if self.form["record"].match(line):
            words = line.split(None, 2)
            name = words[1].decode("utf-8", "replace").removesuffix(";") if len(words) > 1 else ""
            self.name, self.pos, self.section, self.feature = name, place, "", None
            return "record"
        if line.strip() == b"//":
            self.name, self.pos, self.section, self.feature = "", place, "", None
            return "end"
        if self.form["features"].match(line):
            self.section = "features"
            return "features"
        if self.form["origin"].match(line):
            self.section, self.feature = "sequence", None
            return "origin"
        return None


def qualifier(line: bytes) -> bool:
    return line.removeprefix(b"FT").lstrip()[:1] == b"/"


def feature_line(line: bytes) -> tuple[str, str] | None:
    """(type, location) of a line that begins a feature."""
    if line.startswith(b"FT"):
        words = line[2:].split()
        if len(words) < 2 or words[0].startswith(b"/"):
            return None
        return words[0].decode("utf-8", "replace"), b" ".join(words[1:]).decode("utf-8", "replace")
    key, location = line[:LOCATION_AT].strip(), line[LOCATION_AT:].strip()
    if not line.startswith(b"     ") or not key or not location or qualifier(line):
        return None
    return key.decode("utf-8", "replace"), location.decode("utf-8", "replace")


def flat_chunks(at: DataFrame, form: dict, *, chunk: int = SEQ_CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(contigs, chunks, features) of flat-file splits; features are (file, pos, chrom, fpos, type, loc, quals).

    ``pos`` is the place of the record's first line, ``fpos`` that of the feature's; ``quals`` are its qualifier lines.
    """
    summaries = pa.schema([
        ("file", pa.string()), ("start", pa.int64()), ("name", pa.string()), ("pos", pa.int64()), ("section", pa.string()),
        ("feature", pa.int64()), ("lead_feature", pa.int64()), ("lead", pa.int64()), ("inner", pa.int64())])

    def summary(found: Pieces, row: dict) -> Iterator[tuple]:
        state = FlatFile(form, {})
        lead_feature, lead, inner = None, 0, 0
        for places, heads, values in found:
            for p, h, v in zip(places.tolist(), heads.tolist(), values):
                if what := state.mark(p, h, v):
                    if what in ("record", "end"):
                        inner = 0
                elif state.section is None:  # before any mark: a feature or bases, as the section before says
                    lead += len(bases_of(v, _NOT_FLAT))
                    if h and feature_line(v):
                        lead_feature = p
                elif state.section == "sequence":
                    inner += len(bases_of(v, _NOT_FLAT))
                elif state.section == "features" and h and feature_line(v):
                    state.feature = p
        yield row["file"], row["start"], state.name, state.pos, state.section, state.feature, lead_feature, lead, inner

    ddl = "file string, start long, name string, pos long, section string, feature long, lead_feature long, lead long, inner long"
    ends = materialize(parsed(at, summary, summaries, ddl), "flat-splits")
    order = W.partitionBy("file").orderBy("start")
    past, upto = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(W.unboundedPreceding, 0)
    # The section that a split begins in decides what its leading lines are.
    run = ends.withColumns({"in_section": F.last("section", True).over(past), "in_name": F.last("name", True).over(past),
                            "in_pos": F.last("pos", True).over(past), "record": F.last("pos", True).over(upto),
                            "marks": F.count("section").over(upto)})
    own = F.col("inner") + F.when((F.col("in_section") == "sequence") & F.col("pos").isNull(), F.col("lead")).otherwise(0)
    run = run.withColumn("so_far", F.sum(own).over(W.partitionBy("file", "record").orderBy("start").rowsBetween(W.unboundedPreceding, 0)))
    seen = F.when(F.col("section").isNull(), F.when(F.col("in_section") == "features", F.col("lead_feature"))).otherwise(F.col("feature"))
    run = run.withColumn("last_feature", F.last(seen, True).over(W.partitionBy("file", "marks").orderBy("start").rowsBetween(W.unboundedPreceding, 0)))
    opened = run.select("file", "start", F.col("in_section").alias("section"), F.col("in_name").alias("name"), F.col("in_pos").alias("pos"),
                        F.lag("so_far").over(order).alias("so_far"), F.lag("last_feature").over(order).alias("feature"))
    rows = pa.schema([*_PARTS, ("fpos", pa.int64()), ("type", pa.string()), ("loc", pa.string()), ("quals", pa.list_(pa.string())),
                      ("split", pa.int64())])

    def cut(found: Pieces, row: dict) -> Iterator[tuple]:
        state, cutter = FlatFile(form, row), Cutter(chunk)
        cutter.begin((row["file"], row["pos"], row["name"]), row["so_far"] or 0)
        open_feature, quals = None, []

        def close() -> Iterator[tuple]:
            nonlocal open_feature, quals
            if state_feature is not None and (open_feature or quals) and state_name:
                kind, loc = open_feature or (None, None)
                yield row["file"], state_pos, state_name, None, 0, 0, b"", True, state_feature, kind, loc, quals, row["start"]
            open_feature, quals = None, []

        state_name, state_pos, state_feature = state.name, state.pos, state.feature
        for places, heads, values in found:
            for p, h, v in zip(places.tolist(), heads.tolist(), values):
                if what := state.mark(p, h, v):
                    if what != "features":
                        yield from close()
                        state_feature = None
                    if what in ("record", "end"):
                        for part in cutter.end(True):
                            yield (*part, None, None, None, None, None)
                        cutter.begin((row["file"], state.pos, state.name))
                    state_name, state_pos = state.name, state.pos
                elif state.section == "sequence":
                    if state.name:
                        for part in cutter.add(bases_of(v, _NOT_FLAT)):
                            yield (*part, None, None, None, None, None)
                elif state.section == "features" and state.name:
                    if not h:  # the rest of a line above the limit
                        if not quals:
                            raise ValueError(f"feature line of more than {LONGEST} bytes over a split border in {row['file']}")
                        quals[-1] += v.decode("utf-8", "replace")
                    elif state_feature is not None and qualifier(v):
                        quals.append(v.decode("utf-8", "replace").rstrip("\r"))
                    elif new := feature_line(v):
                        yield from close()
                        open_feature, state_feature = new, p
        yield from close()
        for part in cutter.end(row["stop"] is None):
            yield (*part, None, None, None, None, None)

    known = at.join(opened, ["file", "start"])
    parts = materialize(parsed(known, cut, rows, _PARTS_DDL + ", fpos long, type string, loc string, quals array<string>, split long"), "flat-chunks")
    bases = parts.where("fpos is null")
    contigs = bases.groupBy("file", "pos", "chrom").agg(F.sum("n").cast("int").alias("length")).where("chrom <> ''")
    # Qualifiers behind a border go to the feature before it, in order of their splits.
    lines = parts.where("fpos is not null").select("file", "pos", "chrom", "fpos", "type", "loc", "quals", "split")
    more = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("split", "quals"))), lambda x: x["quals"]))
    later = lines.where("type is null").groupBy("file", "fpos").agg(more.alias("more"))
    features = lines.where("type is not null").join(later, ["file", "fpos"], "left").withColumn(
        "quals", F.concat("quals", F.coalesce("more", F.array().cast("array<string>")))).drop("more", "split")
    return contigs, assemble(bases.where("chunk is not null and chrom <> ''"), ["file", "pos", "chrom"]), features
