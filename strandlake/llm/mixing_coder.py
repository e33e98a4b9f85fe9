"""Token-id files: blocks of ids, range coded under a mixed order-0 to order-2 model that starts anew in every block.

A block's ids are dealt to lanes of ``STEPS`` consecutive ids, and all lanes are coded in step, so that one array operation
codes thousands of ids; the model learns from a whole step before the next. For each id the ids last seen after the same
two ids (order 2), then those seen after the same one (order 1) are candidates, and the coder says which candidate it is, or
that it is none and then which id by the order-0 counts of such ids. The chances of the candidates are a mix of three
counts (by how well order 2 did here before, by how often the order-1 context was seen, and over all), whose weights follow
what each would have given the ids so far. All of the model is integer arithmetic, so any machine decodes what another wrote.

A block: ``HEADER``, documents (ids, null flags, counts), alphabet, words of each lane, words. The checksum covers the
decoded ids and all bytes behind the header; a block that doesn't match it is refused. A document with more than
``MOST_SYMBOLS`` different ids is a block whose body is two blocks, one of each half of its ids.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from strandlake.llm.batches import by_bytes, one, strings
from strandlake.llm.tokens import default_tokenizer, encoder

BLOCK_IDS, STEPS, MOST_SYMBOLS = 1 << 21, 256, 1 << 15
HEADER = struct.Struct("<4sIIIIII")
MAGIC, HALVES = b"IDM1", b"IDM2"
NEAR2, NEAR1 = 2, 24  # candidates of the two contexts
SLOTS = NEAR2 + NEAR1 + 1
NONE = SLOTS - 1
CONTEXTS2 = 1 << 16
STATES2, STATES1 = 9, 8
MOST_SEEN = 1 << (STATES1 - 2)  # times an order-1 context was seen: more count as this, the highest level
SLOT_BITS, ORDER0_BITS, WEIGHT_BITS = 12, 16, 10
FULL, WORD = (1 << 32) - 1, (1 << 16) - 1


class Coder:
    """The arithmetic both directions share: per-lane ranges of 32 bits that give or take 16 bits at a time."""

    def __init__(self, lanes: int):
        self.range = np.full(lanes, FULL, np.int64)


class Encoder(Coder):
    def __init__(self, lanes: int, most_words: int):
        super().__init__(lanes)
        self.low = np.zeros(lanes, np.int64)
        self.count = np.zeros(lanes, np.int64)
        self.lanes = lanes
        self.words = np.zeros((most_words, lanes), np.int32)
        self.flat = self.words.reshape(-1)
        self.next = np.arange(lanes)  # where the next word of each lane goes in ``flat``

    def put(self, at: np.ndarray | None, start: np.ndarray, freq: np.ndarray, bits: int) -> None:
        """Code a value for the lanes ``at``, or for all."""
        part = (self.range if at is None else self.range.take(at)) >> bits
        low = (self.low if at is None else self.low.take(at)) + part * start
        width = part * freq
        carry = np.flatnonzero(low > FULL)
        if len(carry):
            lane = carry if at is None else at.take(carry)
            self.flat[self.next.take(lane) - self.lanes] += 1
            low[carry] &= FULL
        short = np.flatnonzero(width <= WORD)
        if len(short):
            lane = short if at is None else at.take(short)
            x = low.take(short)
            place = self.next.take(lane)
            self.flat[place] = x >> 16
            self.next[lane] = place + self.lanes
            low[short] = (x & WORD) << 16
            width[short] = width.take(short) << 16
        if at is None:
            self.low, self.range = low, width
        else:
            self.low[at] = low
            self.range[at] = width

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of each lane, and all words lane by lane."""
        for x in (self.low >> 16, self.low & WORD):
            self.flat[self.next] = x
            self.next += self.lanes
        count = self.next // self.lanes
        for row in range(int(count.max()) - 1, 0, -1):  # carries that were left standing
            over = self.words[row] >> 16
            if over.any():
                self.words[row] &= WORD
                self.words[row - 1] += over
        used = np.arange(len(self.words))[None, :] < count[:, None]
        return count.astype("<u2"), self.words.T[used].astype("<u2")


class Decoder(Coder):
    def __init__(self, counts: np.ndarray, words: np.ndarray):
        super().__init__(len(counts))
        self.words = np.concatenate([words.astype(np.int64), np.zeros(2, np.int64)])
        self.next = np.cumsum(counts.astype(np.int64)) - counts + 2
        self.code = (self.words[self.next - 2] << 16) | self.words[self.next - 1]

    def look(self, at: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
        part = (self.range if at is None else self.range.take(at)) >> bits
        code = self.code if at is None else self.code.take(at)
        # both are below 2**32 and the quotient is small, so that doubles round down to the same integer, in less time
        return part, np.minimum((code / part).astype(np.int64), (1 << bits) - 1)

    def take(self, at: np.ndarray | None, part: np.ndarray, start: np.ndarray, freq: np.ndarray) -> None:
        code = (self.code if at is None else self.code.take(at)) - part * start
        width = part * freq
        short = np.flatnonzero(width <= WORD)
        if len(short):
            lane = short if at is None else at.take(short)
            place = self.next.take(lane)
            code[short] = (code.take(short) << 16) | self.words.take(place)
            self.next[lane] = place + 1
            width[short] = width.take(short) << 16
        if at is None:
            self.code, self.range = code, width
        else:
            self.code[at] = code
            self.range[at] = width


def spread(counts: np.ndarray, bits: int) -> np.ndarray:
    """Positive frequencies in proportion to the counts, along the last axis, that add up to a power of two."""
    room = (1 << bits) - counts.shape[-1]
    freq = counts * room // counts.sum(axis=-1, keepdims=True) + 1
    rest = (1 << bits) - freq.sum(axis=-1)
    np.put_along_axis(freq, freq.argmax(axis=-1)[..., None], freq.max(axis=-1)[..., None] + rest[..., None], axis=-1)
    return freq


class Model:
    """What is known before a step; the same in both directions. Tables are flat: candidate ``k`` of the order-1 context
    ``c`` is at ``c * NEAR1 + k``."""

    def __init__(self, symbols: int, lanes: int):
        self.symbols, self.lanes = symbols, lanes
        self.last2 = np.full(CONTEXTS2, -1, np.int16)
        self.older2 = np.full(CONTEXTS2, -1, np.int16)
        self.past2 = np.zeros(CONTEXTS2, np.uint8)  # 0: new; else 8 and whether the first candidate was right the last times
        self.near1 = np.full(symbols * NEAR1 + 1, -1, np.int16)  # one more, which NONE reads in the last context
        self.hits1 = np.zeros(symbols * NEAR1, np.int16)
        self.seen1 = np.zeros(symbols, np.uint8)  # no more than MOST_SEEN
        self.order0 = np.ones(symbols, np.int64)
        self.new: list[np.ndarray] = []  # ids for order0 since the last refresh
        self.joint = np.zeros(STATES2 * STATES1 * SLOTS, np.int64)
        self.weights = np.full((STATES2, 3), (1 << WEIGHT_BITS) // 3, np.int64)
        self.level = np.array([min(x.bit_length(), STATES1 - 1) for x in range(MOST_SEEN + 1)])
        self.past = np.array([max(0, x - 7) * STATES1 for x in range(16)])
        self.prev1 = self.prev2 = np.zeros(lanes, np.int64)
        self.refresh()

    def refresh(self) -> None:
        """New chances from the counts so far."""
        if self.new:
            self.order0 += 24 * np.bincount(np.concatenate(self.new), minlength=self.symbols)
            self.new = []
        joint = self.joint.reshape(STATES2, STATES1, SLOTS)
        parts = [spread(c * 32 + 1, SLOT_BITS) for c in (joint.sum(axis=1), joint.sum(axis=0), joint.sum(axis=(0, 1)))]
        by2, by1, by0 = parts[0][:, None, :], parts[1][None, :, :], parts[2][None, None, :]
        if joint.any():  # weight of each in proportion to its share of the mix where ids fell
            w = self.weights[:, None, None, :]
            mix = by2 * w[..., 0] + by1 * w[..., 1] + by0 * w[..., 2]
            gains = [(joint * (p * w[..., k] * 4096 // mix)).sum(axis=(1, 2)) for k, p in enumerate((by2, by1, by0))]
            self.weights = spread(np.stack(gains, axis=-1) + 1, WEIGHT_BITS)
        w = self.weights[:, None, None, :]
        mix = by2 * w[..., 0] + by1 * w[..., 1] + by0 * w[..., 2]
        freq = spread(mix, SLOT_BITS)
        self.freq, self.start = freq.reshape(-1), (np.cumsum(freq, axis=-1) - freq).reshape(-1)
        self.freq0 = spread(self.order0, ORDER0_BITS)
        self.start0 = np.cumsum(self.freq0) - self.freq0

    def tables(self) -> None:
        """For decoding: the slot or symbol at each value."""
        self.slot_at = np.repeat(np.tile(np.arange(SLOTS, dtype=np.uint8), STATES2 * STATES1), self.freq)
        self.symbol_at = np.repeat(np.arange(self.symbols, dtype=np.int16), self.freq0)

    def look(self) -> None:
        """The contexts of this step."""
        mixed = (self.prev2 * self.symbols + self.prev1) * 0x9E3779B1
        self.at2 = (mixed ^ (mixed >> 17)) & (CONTEXTS2 - 1)
        self.last, self.older = self.last2.take(self.at2), self.older2.take(self.at2)
        self.was = self.past2.take(self.at2)
        self.state = self.past.take(self.was) + self.level.take(self.seen1.take(self.prev1))

    def learn(self, ids: np.ndarray, first: np.ndarray, row: np.ndarray, miss: np.ndarray, ctx: np.ndarray, place: np.ndarray) -> tuple:
        """Lanes that meet in a context leave what the last of them wrote; both directions do the same.

        ids: int16; first: where the first candidate of order 2 was right; row: place of the state and slot in ``joint``;
        miss: the lanes in which order 2 had no right candidate, their order-1 contexts, and the places there (NEAR1: none).
        Returns what changed among the candidates of order 1: for the new ones the place in ``miss`` and the candidate's
        place, for those that moved up the place in ``miss``, the new place and the id that gave way.
        """
        self.joint += np.bincount(row, minlength=len(self.joint))
        self.past2[self.at2] = 8 | (self.was << 1 & 7) | first
        later = np.flatnonzero(~first)
        at2 = self.at2.take(later)
        self.older2[at2] = self.last.take(later)
        self.last2[at2] = ids.take(later)
        seen = self.seen1.take(ctx)
        self.seen1[ctx] = np.minimum(seen + 1, MOST_SEEN)
        new = place == NEAR1
        gone = np.flatnonzero(new)
        free = np.minimum(seen.take(gone), NEAR1 - 1)
        if len(gone):
            added = ids.take(miss.take(gone))
            self.new.append(added)
            at1 = ctx.take(gone) * NEAR1 + free
            self.near1[at1] = added
            self.hits1[at1] = 1
        old = np.flatnonzero(~new)
        place = place.take(old)
        at1 = ctx.take(old) * NEAR1 + place
        hits = self.hits1.take(at1) + 1
        self.hits1[at1] = hits
        up = np.flatnonzero((place > 0) & (hits > self.hits1.take(at1 - 1)))
        at1 = at1.take(up)
        a, b, c, d = self.near1.take(at1 - 1), self.near1.take(at1), self.hits1.take(at1 - 1), self.hits1.take(at1)
        self.near1[at1 - 1] = b
        self.near1[at1] = a
        self.hits1[at1 - 1] = d
        self.hits1[at1] = c
        return gone, free, old.take(up), place.take(up) - 1, a

    def shift(self, ids: np.ndarray) -> None:
        self.prev2, self.prev1 = self.prev1, ids


class Places:
    """For encoding: where an id is among the candidates of its order-1 context, by a hash of both. An entry that another pair
    took over, or that lanes which met left wrong, fails the comparison in ``find``; its id then counts as none of them."""

    def __init__(self, ids: int, symbols: int):
        bits = min(22, max(10, (8 * min(ids, symbols * NEAR1)).bit_length()))
        self.symbols, self.shift = symbols, 64 - bits
        self.place = np.zeros(1 << bits, np.uint8)

    def slots(self, ctx: np.ndarray, ids: np.ndarray) -> np.ndarray:
        key = (ctx * self.symbols + ids).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (key >> np.uint64(self.shift)).astype(np.int64)

    def find(self, model: Model, ctx: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The place of each id, or NEAR1."""
        self.at = self.slots(ctx, ids)
        place = self.place.take(self.at)
        return np.where(model.near1.take(ctx * NEAR1 + place) == ids, place, NEAR1).astype(np.int64)

    def learn(self, ctx: np.ndarray, gone: np.ndarray, free: np.ndarray, up: np.ndarray, place: np.ndarray, below: np.ndarray) -> None:
        self.place[self.at.take(gone)] = free
        self.place[self.slots(ctx.take(up), below)] = place + 1
        self.place[self.at.take(up)] = place


def due(step: int) -> bool:
    """Whether chances are renewed after a step: often at first, then every eighth."""
    return step < 8 or step % 8 == 0


def numbered(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids, ascending, and the place of each id among them."""
    if len(ids) and int(ids.max()) < 1 << 20:
        alphabet = np.flatnonzero(np.bincount(ids))
        place = np.zeros(int(alphabet[-1]) + 1, np.int64)
        place[alphabet] = np.arange(len(alphabet))
        return alphabet, place[ids]
    return np.unique(ids, return_inverse=True)


def pack_numbers(x: np.ndarray) -> bytes:
    return zlib.compress(x.tobytes(), 1)


def encode_block(ids: np.ndarray, doc_ids: list[int | None], counts: np.ndarray) -> list[bytes]:
    """One block, or two or more if the ids have too many different values for one. Each document is in one block; one
    that alone has too many is coded in halves inside its block."""
    alphabet, symbols = numbered(ids)
    if len(alphabet) > MOST_SYMBOLS:
        if len(counts) > 1:
            half = len(counts) // 2
            cut = int(counts[:half].sum())
            return encode_block(ids[:cut], doc_ids[:half], counts[:half]) + encode_block(ids[cut:], doc_ids[half:], counts[half:])
        half = len(ids) // 2
        body = b"".join(encode_block(x, doc_ids, np.array([len(x)]))[0] for x in (ids[:half], ids[half:]))
        crc = zlib.crc32(body, zlib.crc32(ids.astype("<u4").tobytes()))
        return [HEADER.pack(HALVES, len(ids), 0, 0, 1, crc, len(body)) + body]
    n = len(ids)
    lanes = max(1, -(-n // STEPS))
    steps = -(-n // lanes) if n else 0
    grid = np.zeros(lanes * steps, np.int16)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    coder, model = Encoder(lanes, 2 * steps + 3), Model(max(1, len(alphabet)), lanes)
    places = Places(n, model.symbols)
    for t in range(steps):
        now = grid[t]
        wide = now.astype(np.int64)
        model.look()
        first = model.last == now
        slot = np.where(first, 0, 1)
        miss = np.flatnonzero(~first & (model.older != now))
        ctx = model.prev1.take(miss)
        place = places.find(model, ctx, now.take(miss))
        slot[miss] = NEAR2 + place
        row = model.state * SLOTS + slot
        coder.put(None, model.start.take(row), model.freq.take(row), SLOT_BITS)
        lost = miss.take(np.flatnonzero(place == NEAR1))
        if len(lost):
            ids0 = now.take(lost)
            coder.put(lost, model.start0.take(ids0), model.freq0.take(ids0), ORDER0_BITS)
        places.learn(ctx, *model.learn(now, first, row, miss, ctx, place))
        model.shift(wide)
        if due(t):
            model.refresh()
    per_lane, words = coder.finish()
    null = np.array([d is None for d in doc_ids], np.uint8)
    known = np.array([d or 0 for d in doc_ids], "<i8")
    docs = pack_numbers(known), pack_numbers(null), pack_numbers(counts.astype("<u4"))
    letters = pack_numbers(np.diff(alphabet.astype("<u4"), prepend=np.uint32(0)).astype("<u4"))
    body = b"".join(struct.pack("<I", len(x)) + x for x in (*docs, letters)) + per_lane.tobytes() + words.tobytes()
    crc = zlib.crc32(body, zlib.crc32(ids.astype("<u4").tobytes()))
    return [HEADER.pack(MAGIC, n, lanes, steps, len(doc_ids), crc, len(body)) + body]


def block_size(data: bytes) -> int:
    return HEADER.unpack_from(data)[1]


def decode_block(data: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    """ids, doc_ids and counts of a block; ValueError if it is damaged."""
    try:
        return _decode(data)
    except (struct.error, zlib.error, IndexError) as e:
        raise ValueError(f"damaged block: {e}") from e


def _decode(data: bytes) -> tuple[np.ndarray, list[int | None], np.ndarray]:
    magic, n, lanes, steps, documents, crc, size = HEADER.unpack_from(data)
    if magic not in (MAGIC, HALVES) or len(data) != HEADER.size + size:
        raise ValueError("not a whole block")
    if magic == HALVES:
        cut = 2 * HEADER.size + HEADER.unpack_from(data, HEADER.size)[6]
        (left, doc_ids, _), (right, *_) = _decode(data[HEADER.size:cut]), _decode(data[cut:])
        ids = np.concatenate([left, right])
        if zlib.crc32(data[HEADER.size:], zlib.crc32(ids.astype("<u4").tobytes())) != crc or len(ids) != n:
            raise ValueError("checksum differs")
        return ids, doc_ids, np.array([n])
    at, parts = HEADER.size, []
    for _ in range(4):
        length, = struct.unpack_from("<I", data, at)
        parts.append(data[at + 4:at + 4 + length])
        at += 4 + length
    doc_ids, null, counts = np.frombuffer(zlib.decompress(parts[0]), "<i8"), zlib.decompress(parts[1]), np.frombuffer(zlib.decompress(parts[2]), "<u4")
    alphabet = np.cumsum(np.frombuffer(zlib.decompress(parts[3]), "<u4"), dtype=np.uint32)
    per_lane = np.frombuffer(data, "<u2", lanes, at)
    words = np.frombuffer(data, "<u2", -1, at + 2 * lanes)
    coder, model = Decoder(per_lane, words), Model(max(1, len(alphabet)), lanes)
    grid = np.empty((steps, lanes), np.int16)
    model.tables()
    for t in range(steps):
        model.look()
        part, value = coder.look(None, SLOT_BITS)
        slot = model.slot_at.take((model.state << SLOT_BITS) + value)
        row = model.state * SLOTS + slot
        coder.take(None, part, model.start.take(row), model.freq.take(row))
        first = slot == 0
        now = np.where(first, model.last, model.older)
        miss = np.flatnonzero(slot >= NEAR2)
        ctx = model.prev1.take(miss)
        place = slot.take(miss).astype(np.int64) - NEAR2
        found = model.near1.take(ctx * NEAR1 + place)
        gone = np.flatnonzero(place == NEAR1)
        if len(gone):
            lost = miss.take(gone)
            part, value = coder.look(lost, ORDER0_BITS)
            ids0 = model.symbol_at.take(value)
            found[gone] = ids0
            coder.take(lost, part, model.start0.take(ids0), model.freq0.take(ids0))
        now[miss] = found
        model.learn(now, first, row, miss, ctx, place)
        model.shift(now.astype(np.int64))
        grid[t] = now
        if due(t):
            model.refresh()
            model.tables()
    ids = alphabet[grid.T.reshape(-1)[:n]] if n else np.empty(0, np.uint32)
    if zlib.crc32(data[HEADER.size:], zlib.crc32(ids.astype("<u4").tobytes())) != crc or len(doc_ids) != documents:
        raise ValueError("checksum differs")
    return ids, [None if z else d for d, z in zip(doc_ids.tolist(), null)], counts.astype(np.int64)


def write_ids(docs: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 0, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of all documents in ascending doc_id order: a folder of Parquet files with one block a row.

    Spark's writer commits whole files, in any store. Null doc_ids come first; a null or empty text has its end id only;
    rows that share a doc_id follow each other, ordered by their text's hash, each as a document of its own. Other columns
    are not read. An empty table gives no blocks. A document is never split over blocks.
    """
    file = tokenizer_path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, number = encoder(file), 0
        keys: list[int | None] = []
        ids, counts = np.empty(0, np.uint32), np.empty(0, np.int64)

        def blocks(docs: int) -> pa.RecordBatch:
            """The first so many held documents, coded."""
            nonlocal number, keys, ids, counts
            cut = int(counts[:docs].sum())
            made = encode_block(ids[:cut], keys[:docs], counts[:docs])
            keys, ids, counts = keys[docs:], ids[cut:], counts[docs:]
            sizes = [block_size(b) for b in made]
            part = TaskContext.get().partitionId()
            out = pa.RecordBatch.from_arrays([
                pa.array([part] * len(made), pa.int32()), pa.array(range(number, number + len(made)), pa.int64()),
                pa.array(sizes, pa.int64()), pa.array(made, pa.binary())], names=["part", "block", "n_ids", "data"])
            number += len(made)
            return out

        for t in by_bytes(batches, limit=12 << 20):
            got, n = enc.encode(strings(t.column("text")))
            ids = np.concatenate([ids, np.insert(got, np.cumsum(n), end_id).astype(np.uint32)])
            counts = np.concatenate([counts, n + 1])
            keys += one(t.column("doc_id")).to_pylist()
            while len(ids) >= block_ids:
                yield blocks(int(np.searchsorted(np.cumsum(counts), block_ids)) + 1)
        if keys:
            yield blocks(len(keys))

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    ordered.mapInArrow(run, "part int, block long, n_ids long, data binary").write.option("compression", "none").parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files; start counts the ids of all documents before it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column("start").to_pylist(), batch.column("data")):
                ids, doc_ids, counts = decode_block(data.as_py())
                ends = np.cumsum(counts)
                offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64) * 4)
                binary = pa.Array.from_buffers(pa.large_binary(), len(counts), [None, offsets, pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends - counts), pa.array(counts),
                                                  binary.cast(pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    blocks = spark.read.schema("part int, block long, n_ids long, data binary").parquet(path)
    sizes = blocks.select("part", "block", "n_ids")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a file
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(parts, "part").select(
        "part", "block", (F.col("part_start") + F.col("inside")).alias("start"))
    return blocks.join(starts, ["part", "block"]).select("start", "data").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids binary")
