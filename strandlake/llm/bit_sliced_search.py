"""Ranked lexical search over bit-sliced Bloom signatures.

The index is a table of blocks of documents of like size. A document's signature holds a few bits for each of its terms,
and more for terms that come at least 2, 3, 5, 9 times; a block keeps the signatures turned round, one bitmap over its
documents for every bit (a slice). The slices of a term, and-ed, mark all documents that have it and some that do not, so
term weights summed over those bitmaps bound the score of every document from above. All documents whose bound reaches
the k-th best score known are rescored exactly from their texts, which lie in the block beside the slices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from strandlake.llm.batches import give_back, strings, text_bytes
from strandlake.session import materialize

TOP = 20
_BREAKS = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"
#: Least occurrences of the levels, and the most that a document outside the next level can have.
LEVELS = (1, 2, 3, 5, 9)
HASHES = 3
#: Signature bits for each entry at least; widths are powers of two from LEAST_WIDTH.
BITS_AN_ENTRY, LEAST_WIDTH = 8, 512
#: A block is closed at so many documents, text bytes or slice bytes; one document may be above.
BLOCK_DOCS, BLOCK_TEXT, BLOCK_SLICES = 2048, 4 << 20, 4 << 20
#: Blocks that are written and read together.
GROUP_BLOCKS = 2
#: Documents that a task holds in open blocks, in text bytes.
OPEN_BYTES = 64 << 20
#: Query terms answered in one pass over the index; more items take further passes.
TERMS_A_PASS = 100_000

BLOCK = ("block string, doc_ids array<long>, n_terms array<long>, width int, slices binary, texts array<string>, "
         "terms array<string>, dfs array<long>")


def split_terms(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Numbers of all terms, the distinct terms, and the offsets of the texts."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), _BREAKS)
    offsets = lists.offsets.to_numpy()
    coded = lists.flatten().dictionary_encode()
    codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
    if "" in names:
        keep = codes != names.index("")
        offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
        codes = codes[keep]
    return codes, names, offsets.astype(np.int64)


def _hash(names: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names), np.uint64, len(names))


def bit_places(hashes: np.ndarray, level: int, width: int) -> np.ndarray:
    """[term, HASHES]: the signature bits of terms at a level."""
    h = hashes ^ np.uint64((level * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(width - 1)).astype(np.int64)


def _per_doc(codes: np.ndarray, n_names: int, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, occurrences) of every pair that there is, by document."""
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    pair, tf = np.unique(doc * max(n_names, 1) + codes, return_counts=True)
    return pair // max(n_names, 1), pair % max(n_names, 1), tf


def _width(entries: int) -> int:
    return max(LEAST_WIDTH, 1 << (max(1, entries * BITS_AN_ENTRY) - 1).bit_length())


class _Open:
    """Documents of one width that wait for their block to be closed."""

    def __init__(self) -> None:
        self.ids, self.texts, self.bytes = [], [], 0


def _close(docs: _Open, width: int, name: str) -> dict:
    texts = pa.array(docs.texts, pa.string())
    codes, names, offsets = split_terms(texts)
    doc, term, tf = _per_doc(codes, len(names), offsets)
    hashes = _hash(names)
    n_bytes = -(-len(docs.ids) // 8)
    slices = np.zeros((width, n_bytes), np.uint8)
    for level, least in enumerate(LEVELS):
        on = tf >= least
        if not on.any():
            break
        at = bit_places(hashes[term[on]], level, width)
        d = doc[on]
        cell = (at * n_bytes + (d >> 3)[:, None]).ravel()
        bit = np.repeat((1 << (d & 7)).astype(np.uint8), HASHES)
        np.bitwise_or.at(slices.reshape(-1), cell, bit)
    dfs = np.bincount(term, minlength=len(names))
    return {"block": name, "doc_ids": docs.ids, "n_terms": np.diff(offsets), "width": width, "slices": slices.tobytes(), "texts": docs.texts,
            "terms": names, "dfs": dfs}


def build_index(docs: DataFrame) -> DataFrame:
    """The blocks of all rows, as a table in the shared folder: (block, doc_ids, n_terms, width, slices, texts, terms, dfs).

    A null text has no terms. Rows without a doc_id and repeated rows are rows of their own. Other columns are not read.
    A text of any length is one document of its block; its signature grows with its terms.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        own, made = uuid.uuid4().hex, 0
        held: dict[int, _Open] = {}
        schema = pa.schema([("block", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("n_terms", pa.list_(pa.int64())), ("width", pa.int32()),
                            ("slices", pa.binary()), ("texts", pa.list_(pa.string())), ("terms", pa.list_(pa.string())), ("dfs", pa.list_(pa.int64()))])

        def closed(width: int) -> pa.RecordBatch:
            nonlocal made
            made += 1
            return pa.RecordBatch.from_pylist([_close(held.pop(width), width, f"{own}-{made}")], schema)

        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes, dtype=np.int64)
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (8 << 20), side="right")))
                texts = pc.fill_null(batch.column("text").slice(lo, hi - lo), "")
                codes, names, offsets = split_terms(texts)
                doc, _, tf = _per_doc(codes, len(names), offsets)
                entries = sum(np.bincount(doc[tf >= least], minlength=len(texts)) for least in LEVELS)
                for i, (key, text, e) in enumerate(zip(batch.column("doc_id").slice(lo, hi - lo).to_pylist(), texts.to_pylist(), entries.tolist())):
                    width = _width(e)
                    block = held.setdefault(width, _Open())
                    block.ids.append(key)
                    block.texts.append(text)
                    block.bytes += int(sizes[lo + i])
                    if len(block.ids) >= BLOCK_DOCS or block.bytes >= BLOCK_TEXT or width * len(block.ids) >= 8 * BLOCK_SLICES:
                        yield closed(width)
                while sum(b.bytes for b in held.values()) > OPEN_BYTES:
                    yield closed(max(held, key=lambda w: held[w].bytes))
                lo = hi
            give_back()
        for width in sorted(held):
            yield closed(width)
        give_back()

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return materialize(rows.mapInArrow(run, BLOCK), "search-index", group_rows=GROUP_BLOCKS)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term, times) of all items' terms."""
    text = F.translate(F.coalesce(items["text"].cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    each = items.select(items["item_id"].cast("long").alias("item_id"), F.explode(F.split(text, _BREAKS)).alias("term"))
    return each.where("term <> ''").groupBy("item_id", "term").agg(F.count("*").alias("times"))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def fade(n_terms: np.ndarray, n_docs: int, all_terms: int) -> np.ndarray:
    """The m of each document."""
    return 100 - 25 + (25 * n_terms * n_docs) // max(all_terms, 1)


def gain(tf, m):
    """What a term of weight 1 adds; it grows with tf."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Query:
    """The items of one pass: for each the numbers of its terms and their weights, repeats included."""

    def __init__(self, rows: list, n_docs: int, all_terms: int):
        self.n_docs, self.all_terms = n_docs, all_terms
        self.terms = sorted({r.term for r in rows})
        self.number = {t: i for i, t in enumerate(self.terms)}
        of: dict[int, list] = {}
        for r in rows:
            if r.df and (w := weight(n_docs, r.df)) > 0:
                of.setdefault(r.item_id, []).append((self.number[r.term], w * r.times))
        self.items = list(of)
        self.at = [np.array([k for k, _ in v]) for v in of.values()]
        self.weights = [np.array([w for _, w in v], np.float64) for v in of.values()]
        self.hashes = _hash(self.terms)

    def bounds(self, width: int, slices: bytes, n_terms: np.ndarray) -> np.ndarray:
        """[item, document]: no score is above. Whole numbers below 2 to the 53rd, so floats are exact."""
        n = len(n_terms)
        rows = np.frombuffer(slices, np.uint8).reshape(width, -1)
        m = fade(n_terms, self.n_docs, self.all_terms)
        out = np.zeros((len(self.items), n))
        below = np.zeros(n, np.int64)
        for level in range(len(LEVELS)):
            at = bit_places(self.hashes, level, width)
            has = rows[at[:, 0]]
            for h in range(1, HASHES):
                has &= rows[at[:, h]]
            most = np.minimum(LEVELS[level + 1] - 1, n_terms) if level + 1 < len(LEVELS) else n_terms
            upto = np.maximum(gain(most, m), below)  # a document of fewer terms has no more of any
            step, below = (upto - below).astype(np.float64), upto
            some = has.any(axis=1)
            if not some.any():
                break
            for i, (terms, w) in enumerate(zip(self.at, self.weights)):
                live = some[terms]
                if live.any():
                    out[i] += step * (w[live] @ np.unpackbits(has[terms[live]], axis=1, count=n, bitorder="little").astype(np.float64))
        return out

    def scorer(self, texts: pa.Array, n_terms: np.ndarray):
        """A function of (item, document) that gives the exact score; a document is split once."""
        m = fade(n_terms, self.n_docs, self.all_terms)
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        number = self.number.get

        def score(item: int, doc: int) -> int:
            if doc not in known:
                codes, names, _ = split_terms(texts.slice(doc, 1))
                asked = np.fromiter((number(x, -1) for x in names), np.int64, len(names))
                order = np.argsort(asked)
                known[doc] = (np.append(asked[order], len(self.terms)), np.append(np.bincount(codes, minlength=len(names))[order], 0))
            have, times = known[doc]
            at = np.searchsorted(have, self.at[item])
            tf = np.where(have[at] == self.at[item], times[at], 0)
            return int((self.weights[item].astype(np.int64) * gain(tf, int(m[doc]))).sum())

        return score


def _candidates(query: Query, blocks: DataFrame, k: int) -> DataFrame:
    """(item, block, place, bound): the k greatest bounds of each item in each task, from slices alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in query.items]
        for b in batches:
            for r in range(b.num_rows):
                n_terms = b.column("n_terms")[r].values.to_numpy()
                up = query.bounds(b.column("width")[r].as_py(), b.column("slices")[r].as_buffer(), n_terms)
                name = b.column("block")[r].as_py()
                for i, row in enumerate(up):
                    least = best[i][-1][0] if len(best[i]) >= k else 0
                    at = np.flatnonzero(row > least)
                    if len(at) > k:
                        at = at[np.argpartition(-row[at], k - 1)[:k]]
                    if len(at):
                        best[i] = sorted(best[i] + [(row[j], name, j) for j in at.tolist()], key=lambda x: -x[0])[:k]
        rows = [(i, name, j, int(u)) for i, x in enumerate(best) for u, name, j in x]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["item", "block", "place", "bound"])
        give_back()

    found = blocks.select("block", "n_terms", "width", "slices").mapInArrow(run, "item long, block string, place long, bound long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "block", "place"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def _floors(query: Query, blocks: DataFrame, k: int) -> dict[int, int]:
    """For each item the k-th best exact score among the k documents of the greatest bounds, if it has k."""
    wanted = _candidates(query, blocks, k).groupBy("block").agg(F.collect_list(F.struct("item", "place")).alias("wanted"))
    # At most k rows for each item of the pass.
    picked = blocks.select("block", "n_terms", "texts").join(F.broadcast(wanted), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in range(b.num_rows):
                score = query.scorer(b.column("texts")[r].values, b.column("n_terms")[r].values.to_numpy())
                rows += [(x["item"], score(x["item"], x["place"])) for x in b.column("wanted")[r].as_py()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["item", "score"])

    scored = picked.mapInArrow(run, "item long, score long").groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    return {r.item: r.least for r in scored.where(F.col("n") >= k).collect()}


def _rescored(query: Query, blocks: DataFrame, floors: dict[int, int], k: int) -> DataFrame:
    """(item_id, doc_id, score): the k best of each item in each task, among all documents whose bound reaches the floor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in query.items]
        for b in batches:
            for r in range(b.num_rows):
                n_terms = b.column("n_terms")[r].values.to_numpy()
                ids = b.column("doc_ids")[r].values.to_pylist()
                up = query.bounds(b.column("width")[r].as_py(), b.column("slices")[r].as_buffer(), n_terms)
                score = query.scorer(b.column("texts")[r].values, n_terms)
                for i, row in enumerate(up):
                    least = max(1, floors.get(i, 1), best[i][-1][0] if len(best[i]) >= k else 1)
                    new = [(s, ids[j]) for j in np.flatnonzero(row >= least).tolist() if (s := score(i, j)) >= least]
                    if new:
                        best[i] = sorted(best[i] + new, key=_order)[:k]
        rows = [(query.items[i], doc, s) for i, x in enumerate(best) for s, doc in x]
        if rows:
            item, doc, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array(doc, pa.int64()), pa.array(s, pa.int64())],
                                             names=["item_id", "doc_id", "score"])
        give_back()

    return blocks.select("doc_ids", "n_terms", "width", "slices", "texts").mapInArrow(run, "item_id long, doc_id long, score long")


def _order(x: tuple) -> tuple:
    """Higher scores first, then lower ids, then rows without one."""
    return -x[0], x[1] is None, x[1] or 0


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0.

    Null texts and texts without terms have no score and take no part in the counts. Rows without a doc_id count, and rank after
    others of equal score; repeated rows rank one by one. Items without an id or terms, or whose terms no document has, give no
    rows; the terms of rows of equal item_id are one item's. Other columns are not read.
    """
    return search_index(build_index(docs), items, k)


def search_index(blocks: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """``search`` over an index that is there already."""
    spark = blocks.sparkSession
    sums = blocks.select(F.explode("n_terms").alias("n")).agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, all_terms = sums.docs or 0, sums.terms or 0
    asked = item_terms(items).where("item_id is not null")
    known = blocks.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select("x.terms", "x.dfs")
    known = known.join(asked.select(F.col("term").alias("terms")).distinct(), "terms", "left_semi")
    df = known.groupBy(F.col("terms").alias("term")).agg(F.sum("dfs").alias("df"))
    asked = materialize(asked.join(df, "term"), "search-terms")
    passes = max(1, -(-asked.count() // TERMS_A_PASS))
    found = None
    for p in range(passes):
        # Items are dealt to passes by hash, so a pass has about TERMS_A_PASS rows: what the driver takes and sends is bounded.
        rows = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).collect()
        query = Query(rows, n_docs, all_terms)
        part = _rescored(query, blocks, _floors(query, blocks, k), k) if query.items else None
        if part is not None:
            found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
