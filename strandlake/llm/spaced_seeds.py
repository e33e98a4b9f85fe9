"""Benchmark decontamination by spaced seeds.

A mask fixes which words of a window count. Its hash is the same for two windows that agree on those words, whatever
stands between, so a passage with some words replaced still shares hashes with the test item. The hashes of the test
items and of the documents are joined, and the words around each hit are compared: an overlap counts from ``OVERLAP``
words (or four fifths of a shorter item) of which at least ``SHARE`` are equal. The masks are such that every overlap that
counts holds a hit of one of them: ``MASKS`` for items of ``LEAST`` words or more, ``short_masks`` for shorter ones.

Seeds and hits carry ``REACH`` words to each side, so a row never grows with its item or document. What the windows of
all hits on a diagonal say is put together there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandlake.llm.batches import by_bytes, one, split_words, strings, word_hashes
from strandlake.session import materialize

#: Words under 1 are compared, words under 0 are not.
MASKS = ("111011", "11001011", "11111")
OVERLAP, SHARE, LEAST = 13, 0.8, 9
#: Words to each side of a hit that are compared. Words farther than that from every hit on their diagonal count as different;
#: an overlap that counts is never lost by it, since one of at most 25 words around a hit counts already.
REACH = 32
#: Rows of one batch of hits, and of seeds.
HIT_ROWS = 16_000
#: Bits of the filter for each test hash, and the largest filter (32 MB). Beyond it more document hashes reach the join.
BITS_PER_SEED, MOST_BITS = 4096, 1 << 28
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SEEDS = "seed long, item_id long, n int, item_at int, words binary"
#: What stands for no word at the edge of a document and of an item: never the same.
_NO_DOC, _NO_ITEM = np.uint64(0), np.uint64(1)


def normal_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, lower-cased and without ASCII punctuation at its ends, and the offsets of the texts."""
    codes, names, offsets = split_words(texts)
    return word_hashes([x.lower().strip(_EDGE) for x in names])[codes], offsets


def seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The mask's hash at every start; the mask itself is part of it."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, int(mask, 2), np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            out = (out ^ (out >> np.uint64(29))) * _MIX + words[i:i + n]
    out = (out ^ (out >> np.uint64(32))) * _MIX
    return out ^ (out >> np.uint64(29))


def short_masks(n: int) -> list[str]:
    """The masks for items of fewer than ``LEAST`` words: no overlap that counts has more than one word changed, so a hole at
    each inner place of the shortest overlap that allows one, and whole windows for shorter overlaps."""
    out = []
    for length in range(math.ceil(SHARE * n - 1e-9), n + 1):
        if length - math.ceil(SHARE * length - 1e-9) == 0:
            out.append("1" * length)
        else:
            return out + ["1" * i + "0" + "1" * (length - 1 - i) for i in range(1, length - 1)]
    return out


def masks_of(n: int) -> list[str]:
    return list(MASKS) if n >= LEAST else short_masks(n) if n else []


def windows(words: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, none: np.uint64) -> np.ndarray:
    """[place, word]: ``REACH`` words to each side of every place, ``none`` outside of [low, high)."""
    idx = at[:, None] + np.arange(-REACH, REACH)
    ok = (idx >= low[:, None]) & (idx < high[:, None])
    return np.where(ok, words[np.clip(idx, 0, max(len(words) - 1, 0))] if len(words) else none, none)


def _rows_of(matrix: np.ndarray) -> pa.Array:
    size = matrix.shape[1] * 8
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(matrix), [None, pa.py_buffer(matrix.astype("<u8").tobytes())]).cast(pa.binary())


def item_seeds(benchmark: DataFrame) -> DataFrame:
    """All seeds of all items with the words around them; an item without words has none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_bytes(batches, limit=1 << 20):
            hashes, offsets = normal_hashes(strings(t.column("text")))
            for item, a, b in zip(t.column("item_id").to_pylist(), offsets, offsets[1:]):
                words = hashes[a:b]
                for m in masks_of(int(b - a)):
                    seeds = seed_hashes(words, m).view(np.int64)
                    for lo in range(0, len(seeds), HIT_ROWS):
                        at = np.arange(lo, min(lo + HIT_ROWS, len(seeds)))
                        n = len(at)
                        around = windows(words, at, np.zeros(n, np.int64), np.full(n, b - a), _NO_ITEM)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(seeds[lo:lo + n]), pa.array([item] * n, pa.int64()), pa.array(np.full(n, b - a, np.int32)),
                             pa.array(at.astype(np.int32)), _rows_of(around)], names=["seed", "item_id", "n", "item_at", "words"])

    return benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).mapInArrow(run, SEEDS)


def seed_filter(seeds: DataFrame) -> np.ndarray:
    """Bits of all test hashes: a document hash whose bit is not set cannot join. Its size is bounded by ``MOST_BITS``, and comes
    to the driver as at most one row for each 64 bits."""
    count = max(1, seeds.count())
    bits = min(MOST_BITS, max(1 << 16, 1 << (count * BITS_PER_SEED - 1).bit_length()))
    at = F.col("seed").bitwiseAND(F.lit(bits - 1))
    held = seeds.groupBy(F.shiftright(at, 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast((seed & {bits - 1}L) & 63 as int))")).alias("bit")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[held.column("word").to_numpy()] = held.column("bit").to_numpy().view(np.uint64)
    return out.view(np.uint8)


def best_overlap(equal: np.ndarray, share: Fraction) -> tuple[int, int, int]:
    """The longest stretch that starts and ends with an equal word and has ``share`` of them: start, length, equal words."""
    sums = np.concatenate([[0], np.cumsum(equal)])
    level = share.denominator * sums - share.numerator * np.arange(len(sums))  # a stretch is good if it doesn't end lower
    starts = np.flatnonzero(equal)
    if not len(starts):
        return 0, 0, 0
    lowest = np.minimum.accumulate(level[starts])
    ends = starts + 1
    first = starts[np.searchsorted(-lowest, -level[ends])]  # a stretch of one word is always good
    k = int((ends - first).argmax())
    a, b = int(first[k]), int(ends[k])
    return a, b - a, int(sums[b] - sums[a])


def leaks(docs: DataFrame, benchmark: DataFrame, overlap: int = OVERLAP, share: float = SHARE) -> DataFrame:
    """(doc_id, node, item_id, start, length, equal) of the longest overlap of each document with each test item.

    start and length are words of the document, along the item as far as hits reach (``REACH``); the masks are made for the given ``overlap`` and
    ``share``, or larger ones. node stands for the document's text (16 bytes of its SHA-256), so rows that share a null or repeated doc_id are told apart. Null and empty texts overlap with
    nothing. Repeated rows give one row. Other columns of either table are not read. An empty table on either side gives
    no rows.
    """
    spark = docs.sparkSession
    seeds = materialize(item_seeds(benchmark), "item-seeds")
    bitmap = spark.sparkContext.broadcast(seed_filter(seeds))
    lengths = [r.n for r in seeds.select(F.least("n", F.lit(LEAST)).alias("n")).distinct().collect()]
    masks = sorted({m for n in lengths for m in masks_of(n)})
    exact = Fraction(share).limit_denominator(1000)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        last = np.uint64(len(bits) * 8 - 1)
        for t in by_bytes(batches):
            hashes, offsets = normal_hashes(strings(t.column("text")))
            ends = offsets[1:]
            for m in masks:
                s = seed_hashes(hashes, m)
                at = s & last
                p = np.flatnonzero(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                doc = np.searchsorted(ends, p, side="right")
                inside = p + len(m) <= ends[doc]
                p, doc = p[inside], doc[inside]
                for lo in range(0, len(p), HIT_ROWS):
                    q, d = p[lo:lo + HIT_ROWS], doc[lo:lo + HIT_ROWS]
                    rows = pa.array(d)
                    yield pa.RecordBatch.from_arrays(
                        [one(t.column("doc_id")).take(rows), one(t.column("node")).take(rows), pa.array(s[q].view(np.int64)),
                         pa.array((q - offsets[d]).astype(np.int32)), _rows_of(windows(hashes, q, offsets[d], ends[d], _NO_DOC))],
                        names=["doc_id", "node", "seed", "at", "context"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                doc, item = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u8").reshape(b.num_rows, -1) for c in ("context", "words"))
                bits = np.packbits(doc == item, axis=1)
                at = b.column("item_at").to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in ("doc_id", "node", "item_id", "n")), pa.array(b.column("at").to_numpy() - at), pa.array(at - REACH),
                     pa.array([x.tobytes() for x in bits], pa.binary())], names=["doc_id", "node", "item_id", "n", "shift", "item_from", "bits"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, found = [], []
            for i, (n, shift, views) in enumerate(zip(b.column("n").to_pylist(), b.column("shift").to_pylist(), b.column("views").to_pylist())):
                first = min(v["item_from"] for v in views)
                equal = np.zeros(max(v["item_from"] for v in views) - first + 2 * REACH, bool)
                for v in views:
                    lo = v["item_from"] - first
                    equal[lo:lo + 2 * REACH] |= np.unpackbits(np.frombuffer(v["bits"], np.uint8)).view(bool)
                start, length, same = best_overlap(equal, exact)
                if length and length >= min(overlap, math.ceil(share * n - 1e-9)):
                    keep.append(i)
                    found.append((first + start + shift, length, same))
            starts, sizes, same = zip(*found) if found else ((), (), ())
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id").take(at), b.column("node").take(at), b.column("item_id").take(at), pa.array(starts, pa.int32()),
                pa.array(sizes, pa.int32()), pa.array(same, pa.int32())],
                names=["doc_id", "node", "item_id", "start", "length", "equal"])

    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), text_node(text).alias("node"))
    near = keyed.mapInArrow(hits, "doc_id long, node binary, seed long, at int, context binary")
    pairs = near.join(seeds, "seed").select("doc_id", "node", "item_id", "n", "at", "item_at", "context", "words")
    seen = pairs.mapInArrow(compare, "doc_id long, node binary, item_id long, n int, shift int, item_from int, bits binary")
    # As many views of a diagonal at most as its item has seeds; those of repeated rows are the same.
    diagonals = seen.groupBy("doc_id", "node", "item_id", "n", "shift").agg(F.collect_set(F.struct("item_from", "bits")).alias("views"))
    checked = diagonals.mapInArrow(verify, "doc_id long, node binary, item_id long, start int, length int, equal int")
    best = F.max(F.struct("length", "equal", (-F.col("start")).alias("back"))).alias("best")
    return checked.groupBy("doc_id", "node", "item_id").agg(best).select(
        "doc_id", "node", "item_id", (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"), F.col("best.equal").alias("equal"))


def text_node(text):
    """16 bytes of SHA-256 that stand for a text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text overlaps with a test item; all columns stay. Rows with a null or empty text stay, all rows of
    a text that overlaps go, and an empty table on either side takes nothing away."""
    found = materialize(leaks(docs, benchmark).select("node").distinct(), "leaks").withColumnRenamed("node", "_leak_node")
    return docs.join(found, text_node(docs["text"].cast("string")) == found["_leak_node"], "left_anti")
