"""Order-preserving packing: window cuts chosen by dynamic programming over document and sentence ends.

A window runs between two ends and fills one or a few sequences of ``context`` ids. Its cost is the padding of its
last sequence, ``cut_cost`` for each place where it has to be cut inside a sentence, and ``sentence_cost`` if it ends
inside a document. The cheapest start of a window lies in a sliding range of earlier ends, of which one monotone
queue for each number of sequences keeps the candidates, so every end is handled once.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from strandlake.llm.batches import by_bytes, one, strings
from strandlake.llm.tokens import default_tokenizer, encoder

CONTEXT, CUT_COST, SENTENCE_COST, WINDOW_SEQUENCES = 1024, 12.0, 1.0, 3
#: Ids planned at once; a plan ends with a document, so a longer document is planned whole.
PLAN_IDS = 1 << 20
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def ends_sentence(names: list[str]) -> np.ndarray:
    """For each id whether its token closes a sentence or a line."""
    return np.array([bool(re.search(r"[.!?][\"')\]]*$|Ċ", x)) for x in names], bool)


def candidate_cuts(ids: np.ndarray, doc_ends: np.ndarray, closing: np.ndarray, context: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions a window may end at, whether each is a document's end and whether it lies inside a sentence.

    A sentence longer than a quarter of ``context`` gets a position after every sixteenth of it.
    """
    at = np.union1d(np.flatnonzero(closing[ids]) + 1, doc_ends)
    gaps = np.diff(at, prepend=0)
    wide, step = np.flatnonzero(gaps > context // 4), max(1, context // 16)
    forced = [np.arange(at[w] - gaps[w] + step, at[w], step) for w in wide]
    inside = np.concatenate(forced) if forced else np.empty(0, np.int64)
    cuts = np.union1d(at, inside)
    return cuts, np.isin(cuts, doc_ends), np.isin(cuts, inside)


def tail_cost(length: int, context: int, cut_cost: float) -> float:
    """Of the last window: padding, or cuts into powers of two, which need none."""
    return min(context - length, (length.bit_count() - 1) * cut_cost)


def plan_windows(cuts: list[int], end_cost: list[float], context: int, cut_cost: float, most: int) -> list[int]:
    """The ends of the cheapest windows, as positions in ``cuts``; ``end_cost`` is what ending at each costs."""
    n = len(cuts)
    best, came = [0.0] * (n + 1), [0] * (n + 1)
    place = [0, *cuts]
    key = [0.0] * (n + 1)  # cost so far plus position: what a window's padding is counted from
    queues: list[deque[int]] = [deque() for _ in range(most)]
    enter = [0] * most  # the next end to enter each queue
    fixed = [(k + 1) * context + k * cut_cost for k in range(most)]
    spans = [(k, queues[k], k * context, (k + 1) * context, fixed[k]) for k in range(most)]
    for j in range(1, n + 1):
        p = place[j]
        low, source = float("inf"), 0
        for k, queue, near, far, cost in spans:
            e, limit = enter[k], p - near
            while e < j and place[e] < limit:  # ends at more than `near` ids before p
                x = key[e]
                while queue and key[queue[-1]] >= x:
                    queue.pop()
                queue.append(e)
                e += 1
            enter[k] = e
            while queue and place[queue[0]] < p - far:
                queue.popleft()
            if queue and (v := key[queue[0]] + cost) < low:
                low, source = v, queue[0]
        best[j] = low - p + end_cost[j - 1]
        came[j] = source
        key[j] = best[j] + p
    i, j = n - 1, n  # the last window may also be cut into powers of two
    low = best[n]
    while i >= 0 and place[n] - place[i] <= context:
        if (v := best[i] + tail_cost(place[n] - place[i], context, cut_cost)) < low:
            low, came[n] = v, i
        i -= 1
    ends = []
    while j:
        ends.append(j - 1)
        j = came[j]
    return ends[::-1]


def sequences(ids: np.ndarray, doc_ends: np.ndarray, closing: np.ndarray, context: int = CONTEXT, cut_cost: float = CUT_COST,
              sentence_cost: float = SENTENCE_COST, most: int = WINDOW_SEQUENCES) -> np.ndarray:
    """The ends of all sequences, ascending; each holds 1 to ``context`` ids."""
    cuts, whole, inside = candidate_cuts(ids, doc_ends, closing, context)
    cost = np.where(whole, 0.0, np.where(inside, cut_cost, sentence_cost))
    at = [0, *(int(cuts[i]) for i in plan_windows(cuts.tolist(), cost.tolist(), context, cut_cost, most))]
    out: list[int] = []
    for a, b in zip(at, at[1:]):
        out += range(a + context, b, context)
        out.append(b)
    a = out[-2] if len(out) > 1 else 0
    length = out[-1] - a
    if tail_cost(length, context, cut_cost) < context - length:
        bits = [1 << k for k in range(length.bit_length() - 1, -1, -1) if length >> k & 1]
        out[-1:] = (a + np.cumsum(bits)).tolist()
    return np.array(out, np.int64)


def padding(length: int, context: int = CONTEXT) -> int:
    """What a sequence is padded by: up to ``context``, except at a power of two."""
    return 0 if length.bit_count() == 1 else context - length


def pack(docs: DataFrame, tokenizer_path: str | None = None, context: int = CONTEXT, cut_cost: float = CUT_COST,
         sentence_cost: float = SENTENCE_COST, window_sequences: int = WINDOW_SEQUENCES, end_id: int = 0) -> DataFrame:
    """One row per piece of a document in a sequence, with the piece's ids (little-endian unsigned 32-bit).

    Documents keep the order of the table's partitions; no row is shuffled, and a task holds one plan (``PLAN_IDS`` ids)
    or one longer document at a time. A null or empty text has its end id only. A null doc_id is carried along. Repeated
    rows are packed as often as they come. Other columns are not read. An empty table gives no pieces. The number of the
    partition is the high part of a sequence_id, so ids are unique and the same again when a task is repeated.
    """
    path = tokenizer_path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        closing = ends_sentence(enc.names)
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            keys = [k for x in held for k in x[0]]
            ids = np.concatenate([x[1] for x in held])
            counts = np.concatenate([x[2] for x in held])
            doc_ends = np.cumsum(counts)
            ends = sequences(ids, doc_ends, closing, context, cut_cost, sentence_cost, window_sequences)
            stops = np.union1d(ends, doc_ends)
            starts = np.concatenate([[0], stops[:-1]])
            doc = np.searchsorted(doc_ends, starts, side="right")
            seq = np.searchsorted(ends, starts, side="right")
            seq_start = np.concatenate([[0], ends[:-1]])
            data = pa.Array.from_buffers(pa.large_binary(), len(starts), [
                None, pa.py_buffer(np.append(starts, stops[-1]).astype(np.int64) * 4), pa.py_buffer(ids.astype("<u4"))])
            out = pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int64()).take(pa.array(doc)), pa.array(starts - (doc_ends - counts)[doc]),
                pa.array(stops - starts), data.cast(pa.binary()), pa.array(counts[doc]), pa.array(sequence + seq),
                pa.array(starts - seq_start[seq])],
                names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            sequence += len(ends)
            held.clear()
            return out

        for table in by_bytes(batches, limit=6 << 20):
            ids, counts = enc.encode(strings(table.column("text")))
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id).astype(np.uint32)
            held.append((one(table.column("doc_id")).to_pylist(), ids, counts + 1))
            size += len(ids)
            if size >= PLAN_IDS:
                yield flush()
                size = 0
        if held:
            yield flush()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, PIECES)
