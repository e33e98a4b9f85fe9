"""Text records with their file and place in it, and the first lines of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandlake.sources.splits import LONGEST, SPLIT, codec_of, listing, open_bytes, pieces, source, split_lines

BOM = "﻿"
#: Suffixes of files that Spark's text source can't open, or can't split though their blocks allow it.
OWN_CODECS = r"(?i)\.(gz|bgz|xz|zst|zstd)$"


def text_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, id, value): ``block`` is the split's offset, ``id`` grows inside it.

    Plain and bz2 files are read by Spark's text source; BGZF files are read in splits at their blocks, gz, xz and zst as streams.
    """
    own = listing(spark, path).where(F.col("file").rlike(OWN_CODECS))
    file = F.col("_metadata.file_path")
    plain = spark.read.option("recursiveFileLookup", "true").text(path).where(~file.rlike(OWN_CODECS)).select(
        file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    return plain if own.isEmpty() else plain.unionByName(split_lines(spark, own))


def file_heads(files: DataFrame, goes_on: Callable[[bytes], bool], keep: Callable[[bytes], bytes | None],
               longest: int = SPLIT) -> DataFrame:
    """(file, line): the first line of each file that ``keep`` gives something for, as long as ``goes_on`` says so for the lines
    before it. No more of a file is read than those lines, whatever its size; of a line above ``longest`` only so much."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, lines = [], []
            for file in b.column("file").to_pylist():
                with open_bytes(file) as f:
                    codec = codec_of(file, f.read(64))
                src = source(file, codec)
                line = _first(src, goes_on, keep, longest)
                src.f.close()
                if line is not None:
                    names.append(file)
                    lines.append(line.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(lines, pa.string())], names=["file", "line"])

    return files.select("file").mapInArrow(run, "file string, line string")


def _first(src, goes_on: Callable[[bytes], bool], keep: Callable[[bytes], bytes | None], longest: int) -> bytes | None:
    for _, heads, values in pieces(src, 0, None, longest):
        for h, v in zip(heads.tolist(), values):
            if h and (line := keep(v)) is not None:
                return line
            if h and not goes_on(v):
                return None
    return None


def first_lines(files: DataFrame) -> DataFrame:
    """(file, line): first non-blank line of each file, trimmed, byte-order mark removed."""
    def keep(line: bytes) -> bytes | None:
        return line.strip().removeprefix(BOM.encode()).strip() or None

    return file_heads(files, lambda line: True, keep, LONGEST)
