"""Files as byte splits, read by tasks of their own whatever the lines and records in them.

Plain files are cut at byte offsets, BGZF files (bgzip) at their compressed blocks; gz, bz2, xz and zst are one split, read
as a stream. A line belongs to the split that it begins in, which reads on over its end to complete it; the next one skips
that rest. Lines above a limit (a contig on one line) are not completed but come in pieces, each from the split that holds
its bytes. Nothing longer than the limit is ever held.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandlake.session import materialize

#: Bytes of a split, the longest line that is kept whole, and bytes read at once.
SPLIT, LONGEST, STEP = 32 << 20, 64 << 10, 1 << 20
#: Tasks for each core at least, as far as there are splits; beyond that a task takes splits of SPLIT bytes together, and there are
#: never more tasks than that. A task for every split would cost more than a small split's work, and leave a file each behind.
TASKS_A_CORE, TASKS = 4, 20_000
SUFFIXES = {"gz": "gz", "bgz": "gz", "bz2": "bz2", "xz": "xz", "zst": "zst", "zstd": "zst"}


def open_bytes(uri: str):
    """A seekable byte file: local paths by open(), other stores by pyarrow's file systems."""
    u = urlparse(uri)
    if u.scheme in ("", "file"):
        return open(u.path if u.scheme else uri, "rb")
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return store.open_input_file(path)


class Plain:
    """Bytes as they are; places are byte offsets."""

    def __init__(self, f):
        self.f = f

    def after(self, at: int, stop: int | None) -> Iterator[tuple[int, bytes]]:
        while stop is None or at < stop:
            self.f.seek(at)
            data = self.f.read(STEP if stop is None else min(STEP, stop - at))
            if not data:
                return
            yield at, data
            at += len(data)

    def before(self, at: int, enough: Callable[[bytes], bool]) -> bytes:
        """The bytes before a place: as many as it takes, or all."""
        back = 4096
        while True:
            lo = max(0, at - back)
            self.f.seek(lo)
            data = self.f.read(at - lo)
            if lo == 0 or enough(data):
                return data
            back *= 4


class Bgzf:
    """Gzip members of at most 64 KB that name their size; places are (member offset << 16 | offset inside)."""

    MOST = 1 << 16

    def __init__(self, f, size: int):
        self.f, self.size = f, size

    @staticmethod
    def member(head: bytes) -> int | None:
        """The size of the member that begins here, None if none does."""
        if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
            return None
        extra = head[12:12 + struct.unpack("<H", head[10:12])[0]]
        while len(extra) >= 4:
            n = struct.unpack("<H", extra[2:4])[0]
            if extra[:2] == b"BC" and n == 2 and len(extra) >= 6:
                return struct.unpack("<H", extra[4:6])[0] + 1
            extra = extra[4 + n:]
        return None

    def _head(self, at: int) -> int | None:
        self.f.seek(at)
        return self.member(self.f.read(64))

    def first(self, at: int) -> int:
        """The first member at or after a place: three in a row, or all up to the end, have to follow each other."""
        if at == 0 or at >= self.size:
            return min(at, self.size)
        self.f.seek(at)
        window = self.f.read(2 * self.MOST)
        i = window.find(b"\x1f\x8b\x08\x04")
        while i >= 0:
            here, sound = at + i, True
            for _ in range(3):
                n = self._head(here)
                if not n or here + n > self.size:
                    sound = False
                    break
                here += n
                if here == self.size:
                    break
            if sound:
                return at + i
            i = window.find(b"\x1f\x8b\x08\x04", i + 1)
        return self.size

    def after(self, at: int, stop: int | None) -> Iterator[tuple[int, bytes]]:
        here = self.first(at)
        stop = self.size if stop is None else stop
        while here < stop:
            n = self._head(here)
            if not n:
                raise ValueError(f"broken BGZF block at byte {here}")
            self.f.seek(here)
            data = zlib.decompress(self.f.read(n), 31)
            if data:
                yield here << 16, data
            here += n

    def before(self, at: int, enough: Callable[[bytes], bool]) -> bytes:
        back = 4 * self.MOST
        while True:
            lo = max(0, at - back)
            data = b"".join(x for _, x in self.after(lo, self.first(at)))
            if lo == 0 or enough(data):
                return data
            back *= 4


class Stream:
    """A compressed file that can only be read from its begin; places are offsets in the text."""

    def __init__(self, f):
        self.f = f

    def after(self, at: int, stop: int | None) -> Iterator[tuple[int, bytes]]:
        while data := self.f.read(STEP):
            yield at, data
            at += len(data)


def codec_of(file: str, head: bytes) -> str:
    """plain, bgzf, gz, bz2, xz or zst, told by the suffix and the first bytes."""
    kind = SUFFIXES.get(file.rsplit(".", 1)[-1].lower(), "plain")
    return "bgzf" if kind == "gz" and Bgzf.member(head) else kind


def source(file: str, codec: str):
    f = open_bytes(file)
    if codec == "plain":
        return Plain(f)
    if codec == "bgzf":
        f.seek(0, 2)
        return Bgzf(f, f.tell())
    if codec == "gz":
        import gzip

        return Stream(gzip.GzipFile(fileobj=f))
    if codec == "bz2":
        import bz2

        return Stream(bz2.BZ2File(f))
    if codec == "xz":
        import lzma

        return Stream(lzma.LZMAFile(f))
    import zstandard

    return Stream(zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True))


def listing(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, bytes) of the files under a path, contents not read. Files without bytes are left out by Spark."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.col("path").alias("file"), F.col("length").alias("bytes"))


def splits(files: DataFrame, split: int = SPLIT) -> DataFrame:
    """(file, codec, start, stop) of all splits; ``stop`` is NULL for the last of a file."""
    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for file, n in zip(b.column("file").to_pylist(), b.column("bytes").to_pylist()):
                with open_bytes(file) as f:
                    codec = codec_of(file, f.read(64))
                starts = range(0, n, split) if codec in ("plain", "bgzf") else range(1)
                rows += [(file, codec, s, s + split if s + split < n and len(starts) > 1 else None) for s in starts]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64(), pa.int64()))],
                                                 names=["file", "codec", "start", "stop"])

    return materialize(files.select("file", "bytes").mapInArrow(plan, "file string, codec string, start long, stop long"), "splits")


Pieces = Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]


def _rest(stretches: Iterator[tuple[int, bytes]], most: int) -> bytes | None:
    """What comes up to the next line end or the end of the file, if that is at most ``most`` bytes."""
    out = b""
    for _, data in stretches:
        cut = data.find(b"\n", 0, most - len(out) + 1)
        if cut >= 0:
            return out + data[:cut]
        out += data
        if len(out) > most:
            return None
    return out


def _cut(places: np.ndarray, heads: np.ndarray, values: list[bytes], longest: int) -> Pieces:
    """A batch with its long lines cut."""
    if max(map(len, values)) <= longest:
        yield places, heads, values
        return
    rows = [(p + i, h and i == 0, v[i:i + longest]) for p, h, v in zip(places.tolist(), heads.tolist(), values)
            for i in range(0, max(len(v), 1), longest)]
    p, h, v = zip(*rows)
    yield np.array(p, np.int64), np.array(h, bool), list(v)


def pieces(src, start: int, stop: int | None, longest: int = LONGEST) -> Pieces:
    """Batches of (place, whether a line begins there, bytes without line end) of one split, in order."""
    skip, head, held, place = False, True, b"", -1
    if start:
        past = src.before(start, lambda x: b"\n" in x or len(x) > longest)
        tail = past[past.rfind(b"\n") + 1:]
        if tail:
            rest = _rest(src.after(start, None), longest - len(tail)) if len(tail) <= longest else None
            skip, head = rest is not None, rest is not None
    for at, data in src.after(start, stop):
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
        begin = 0
        if skip:
            if not len(ends):
                continue
            begin, skip = int(ends[0]) + 1, False
            ends = ends[1:]
        if len(ends):
            values = data[begin:ends[-1]].split(b"\n")
            places, heads = np.concatenate([[begin], ends[:-1] + 1]) + at, np.ones(len(values), bool)
            if held:
                values[0], places[0] = held + values[0], place
            heads[0] = head
            held, head, begin = b"", True, int(ends[-1]) + 1
            yield from _cut(places, heads, values, longest)
        if begin < len(data):
            place = place if held else at + begin
            held += data[begin:]
            if not head or len(held) > longest:
                yield from _cut(np.array([place]), np.array([head]), [held], longest)
                held, head = b"", False
    if held:
        rest = _rest(src.after(stop, None), longest - len(held)) if stop is not None else b""
        yield np.array([place]), np.array([head]), [held + (rest or b"")]


def parsed(at: DataFrame, parse: Callable[[Pieces, dict], Iterator[tuple]], fields: pa.Schema, schema: str, longest: int = LONGEST) -> DataFrame:
    """Rows that ``parse`` makes of the pieces of each split, dealt over as many tasks; its second argument is the split's row in ``at``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                src = source(row["file"], row["codec"])
                try:
                    rows, size = [], 0
                    for r in parse(pieces(src, row["start"], row["stop"], longest), row):
                        rows.append(r)
                        size += sum(len(x) for x in r if isinstance(x, (bytes, str)))
                        if len(rows) >= 20_000 or size > 16 << 20:
                            yield _batch(rows, fields)
                            rows, size = [], 0
                    if rows:
                        yield _batch(rows, fields)
                finally:
                    src.f.close()

    return at.repartition(tasks_for(at)).mapInArrow(run, schema)


def tasks_for(at: DataFrame) -> int:
    """Tasks that splits are dealt over, by their bytes. A split without end that begins its file counts as SPLIT bytes, as it may be a long
    stream; any other last split of a file as the largest of all."""
    size = F.coalesce(F.col("stop") - F.col("start"), F.when(F.col("start") == 0, F.lit(SPLIT)))
    n, known, largest, last = at.select(size.alias("size")).agg(
        F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(SPLIT)), F.count_if(F.col("size").isNull())).first()
    wide = TASKS_A_CORE * at.sparkSession.sparkContext.defaultParallelism
    return max(1, min(n, TASKS, max(wide, -(-(known + largest * last) // SPLIT))))


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields)


def split_lines(spark: SparkSession, files: DataFrame, split: int = SPLIT, longest: int = SPLIT) -> DataFrame:
    """(file, block, id, value): the lines of files of any codec, like ``lines.text_records``. A line above ``longest`` bytes is an error."""
    fields = pa.schema([("file", pa.string()), ("block", pa.int64()), ("id", pa.int64()), ("value", pa.string())])

    def parse(found: Pieces, row: dict) -> Iterator[tuple]:
        for places, heads, values in found:
            if not heads.all():
                raise ValueError(f"line of more than {longest} bytes in {row['file']}")
            for p, v in zip(places.tolist(), values):
                yield row["file"], row["start"], p, v.decode("utf-8", "replace")

    return parsed(splits(files, split), parse, fields, "file string, block long, id long, value string", longest)
