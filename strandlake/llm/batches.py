"""Arrow batches inside tasks: regrouped by bytes, so that long texts never pile up in one batch."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once by one task.
BATCH_BYTES = 8 << 20


def text_bytes(column: pa.Array) -> int:
    return int(pc.sum(pc.binary_length(column)).as_py() or 0)


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.Table]:
    """Tables of whole rows in their order; each but a single longer row has at most ``limit`` bytes of ``column``."""
    held, size = [], 0
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = int(np.searchsorted(ends, base + limit - size, side="right"))
            if to <= at and not held:
                to = at + 1  # one row above the limit goes alone
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1] - base)
                at = to
            if at < batch.num_rows:
                full, held, size = pa.Table.from_batches(held), [], 0
                yield full
                del full
                give_back()
    if held:
        yield pa.Table.from_batches(held)
    held.clear()
    give_back()


def give_back() -> None:
    """Return freed memory to the system: a worker lives on after its task, beside those of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def one(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def strings(column: pa.ChunkedArray) -> pa.Array:
    """A text column as one array, null texts as empty ones."""
    return pc.fill_null(one(column), "")


def slices(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of ``arange(s, s + n)`` for all pairs, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def split_words(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words between ASCII white space: number of each word's name, the distinct names, and offsets of the texts."""
    lists = pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    if "" in names:  # from white space at an end
        keep = codes != names.index("")
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return codes, names, offsets


def word_hashes(names: list[str]) -> np.ndarray:
    """64-bit hashes, the same in every process."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names), np.uint64, len(names))
