"""Toxicity by nearest labelled examples.

Texts are TF-IDF vectors over all terms (words and the first four or five letters of words) of a bounded sample of
labelled rows; document frequencies are counted over all documents, and each weight is scaled by how far the term's
presence goes with the label beyond chance, without ever becoming zero. The nearest examples by exact cosine come from
an inverted index cut into blocks of examples: the largest weight of each term in each block bounds what the block's
examples can reach, and blocks that cannot reach the k-th best are skipped. Terms of many examples are dense rows, whose
part of a similarity is summed for a batch of texts at once. Neighbours vote by similarity; votes become scores by a
monotone table fitted on the examples, each voted on by the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from strandlake.llm.batches import by_bytes, one, slices, strings
from strandlake.session import materialize

#: Labelled rows that are learnt from, drawn by hash: the one bound of what is fitted and held in memory.
EXAMPLES = 4000
NEIGHBOURS, BLOCK, THRESHOLD = 15, 64, 0.7
#: Share of its TF-IDF weight that a term without any relation to the label keeps.
UNRELATED = 0.003
#: A term of more than one in so many examples is a dense row of the index.
DENSE = 16
#: Cells of all dense rows (8 bytes each); terms of fewer examples beyond them stay postings.
DENSE_CELLS = 12 << 20
#: Blocks read for a first k-th best similarity.
FIRST_BLOCKS = 6
#: Texts scored at once, and their bytes unless one alone has more.
BATCH_TEXTS, BATCH_BYTES = 64, 2 << 20
_EDGE = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def held_out(doc_id):
    """Rows never learnt from: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def draw(labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """(doc_id, toxic) of at most ``examples`` labelled rows that may be learnt from, by the least hashes of their ids."""
    known = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples)


@dataclass
class Vectors:
    """Term counts of texts, one text after the other; the terms of each ascend."""

    offsets: np.ndarray
    terms: np.ndarray
    counts: np.ndarray

    def of(self, d: int) -> slice:
        return slice(self.offsets[d], self.offsets[d + 1])

    def part(self, lo: int, hi: int) -> Vectors:
        s = slice(self.offsets[lo], self.offsets[hi])
        return Vectors(self.offsets[lo:hi + 1] - s.start, self.terms[s], self.counts[s])


def word_terms(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all words and the number of the word of each.

    A word in lower case without the marks at its edges is a term, and so are its first four and five letters, with a ``*``,
    if it has more; a word of marks alone has none.
    """
    low = pc.ascii_trim(pc.utf8_lower(words), _EDGE)
    size = pc.utf8_length(low).to_numpy(zero_copy_only=False)
    terms, owner = [], []
    for k in (0, 4, 5):
        at = np.flatnonzero(size > k)
        part = low.take(pa.array(at))
        terms.append(pc.binary_join_element_wise(pc.utf8_slice_codeunits(part, 0, k), "*", "") if k else part)
        owner.append(at)
    return pa.concat_arrays(terms), np.concatenate(owner)


class Terms:
    """Counts of known terms in texts; without names, of all their terms, which become the names."""

    def __init__(self, names: list[str] | pa.Array | None = None):
        self.names = None if names is None else pa.array(names, pa.string())

    def vectors(self, texts: pa.Array) -> Vectors:
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        terms, owner = word_terms(words.dictionary)
        if self.names is None:
            coded = terms.dictionary_encode()
            self.names, number = coded.dictionary, coded.indices
        else:
            number = pc.fill_null(pc.index_in(terms, value_set=self.names), -1)
        number = number.to_numpy().astype(np.int64)
        by = np.argsort(owner, kind="stable")
        by = by[number[by] >= 0]
        number, size = number[by], np.bincount(owner[by], minlength=len(words.dictionary))
        codes, offsets = words.indices.to_numpy(), lists.offsets.to_numpy()
        n = size[codes]
        terms = number[slices((np.cumsum(size) - size)[codes], n)]
        text = np.repeat(np.repeat(np.arange(len(texts)), np.diff(offsets)), n)
        width = max(1, len(self.names))
        keys, counts = np.unique(text * width + terms, return_counts=True)
        return Vectors(np.searchsorted(keys, np.arange(len(texts) + 1) * width), keys % width, counts)


def gather(docs: DataFrame, labels: DataFrame, examples: int) -> tuple[list[str], list[tuple[str, int, float]], Vectors]:
    """The terms of the drawn rows; digest, least doc_id and mean label of each distinct text, by digest; and its vector."""
    drawn = materialize(draw(labels, examples), "drawn")
    rows = docs.join(F.broadcast(drawn), "doc_id").groupBy(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).agg(
        F.first("text").alias("text"), F.min("doc_id").alias("doc_id"), F.avg("toxic").alias("toxic"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_bytes(batches):
            counter = Terms()
            v = counter.vectors(strings(t.column("text")))
            lists = [pa.ListArray.from_arrays(pa.array(v.offsets, pa.int32()), x)
                     for x in (counter.names.take(pa.array(v.terms)), pa.array(v.counts, pa.int32()))]
            yield pa.RecordBatch.from_arrays([one(t.column(c)) for c in ("digest", "doc_id", "toxic")] + lists,
                                             names=["digest", "doc_id", "toxic", "terms", "counts"])

    made = materialize(rows.mapInArrow(run, "digest string, doc_id long, toxic double, terms array<string>, counts array<int>"), "examples")
    held = made.orderBy("digest").toArrow()
    known = list(zip(*(held.column(c).to_pylist() for c in ("digest", "doc_id", "toxic"))))
    lists = one(held.column("terms"))
    sizes = np.array(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    coded = lists.flatten().dictionary_encode()
    text, terms = np.repeat(np.arange(len(sizes)), sizes), coded.indices.to_numpy().astype(np.int64)
    order = np.lexsort((terms, text))
    counts = one(held.column("counts")).flatten().to_numpy()[order]
    return coded.dictionary.to_pylist(), known, Vectors(np.concatenate([[0], np.cumsum(sizes)]), terms[order], counts)


def document_frequencies(docs: DataFrame, names: list[str]) -> tuple[np.ndarray, int]:
    """In how many rows each term stands, and the number of rows."""
    shared = docs.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Terms(shared.value)
        df, rows = np.zeros(len(names) + 1, np.int64), 0
        for t in by_bytes(batches):
            v = counter.vectors(strings(t.column("text")))
            df += np.bincount(v.terms, minlength=len(df))
            rows += t.num_rows
        df[-1] = rows
        at = np.flatnonzero(df)
        for lo in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[lo:lo + (1 << 16)]), pa.array(df[at[lo:lo + (1 << 16)]])], names=["term", "n"])

    got = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(names) + 1, np.int64)
    df[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return df[:-1], int(df[-1])


def relation(v: Vectors, toxic: np.ndarray, terms: int) -> np.ndarray:
    """How far each term's presence goes with the label: its correlation beyond what the best of as many terms has by chance."""
    n, share = len(toxic), float(toxic.mean()) if len(toxic) else 0.0
    if not 0 < share < 1:
        return np.full(terms, UNRELATED)
    rows = np.bincount(v.terms, minlength=terms).astype(np.float64)
    hits = np.bincount(v.terms, np.repeat(toxic, np.diff(v.offsets)), terms)
    off = np.maximum(0, np.abs(hits - rows * share) - 0.5)
    chi2 = off * off * n / np.maximum(rows * share * (1 - share) * np.maximum(n - rows, 1), 1e-9)
    return UNRELATED + np.sqrt(np.maximum(0, chi2 - 2 * np.log(max(terms, 2))) / n)


class BlockIndex:
    """Postings of the examples by term, cut into blocks of ``BLOCK`` examples, with each block's largest weight of a term.

    ``weights`` are those of unit vectors. Examples are put in the order of their strongest term, so that blocks differ.
    """

    def __init__(self, v: Vectors, weights: np.ndarray, terms: int, dense: int = DENSE):
        self.n = len(v.offsets) - 1
        self.blocks = -(-self.n // BLOCK)
        strongest = [int(v.terms[s][weights[s].argmax()]) if s.stop > s.start else -1 for s in map(v.of, range(self.n))]
        self.order = np.array(sorted(range(self.n), key=lambda i: (strongest[i], i)), np.int64)
        self.place = np.empty(self.n, np.int64)
        self.place[self.order] = np.arange(self.n)
        example = np.repeat(self.place, np.diff(v.offsets))
        rows = np.bincount(v.terms, minlength=terms)
        most = DENSE_CELLS // max(1, self.blocks * BLOCK)
        wide = np.sort(np.argsort(-rows, kind="stable")[:min(most, int((rows * dense > self.n).sum()))])
        self.row = np.full(terms, -1, np.int64)
        self.row[wide] = np.arange(len(wide))
        many = self.row[v.terms] >= 0
        self.dense = np.zeros((len(wide), self.blocks * BLOCK))
        self.dense[self.row[v.terms[many]], example[many]] = weights[many]
        by = np.lexsort((example[~many], v.terms[~many]))
        self.example, self.weight = example[~many][by], weights[~many][by]
        term = v.terms[~many][by]
        slot = term * max(1, self.blocks) + self.example // BLOCK
        heads = np.flatnonzero(np.diff(slot, prepend=-1))
        self.block = slot[heads] % max(1, self.blocks)
        self.most = np.maximum.reduceat(self.weight, heads) if len(heads) else np.empty(0)
        self.post = np.append(heads, len(term))  # where the postings of each term and block begin
        self.starts = np.searchsorted(term[heads], np.arange(terms + 1))
        self.spread = np.diff(self.starts)

    def batch(self, v: Vectors, weights: np.ndarray, k: int, leave: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text the examples, as given to the index, whose similarity is above 0 and among the ``k`` largest, and these.

        Examples as similar as the k-th all belong. ``leave`` is an example for each text that is not considered.
        """
        texts, cells = len(v.offsets) - 1, self.blocks * BLOCK
        if not texts or not cells:
            return [(np.empty(0, np.int64), np.empty(0))] * texts
        text = np.repeat(np.arange(texts), np.diff(v.offsets))
        row = self.row[v.terms]
        wide = row >= 0
        asked = np.zeros((texts, len(self.dense)))
        asked[text[wide], row[wide]] = weights[wide]
        sums = asked @ self.dense  # the parts of all similarities that dense rows give
        terms, text, weights = v.terms[~wide], text[~wide], weights[~wide]
        n = self.spread[terms]
        at = slices(self.starts[terms], n)
        spot, weights = np.repeat(text * self.blocks, n) + self.block[at], np.repeat(weights, n)
        bound = sums.reshape(texts, self.blocks, BLOCK).max(axis=2)
        bound += np.bincount(spot, weights * self.most[at], texts * self.blocks).reshape(texts, self.blocks)
        sims = np.zeros((texts, cells))

        def add(now: np.ndarray) -> None:
            some = np.flatnonzero(now.reshape(-1)[spot])
            lo = at[some]
            size = self.post[lo + 1] - self.post[lo]
            p = slices(self.post[lo], size)
            place = np.repeat(spot[some] // self.blocks * cells, size) + self.example[p]
            part = np.bincount(place, np.repeat(weights[some], size) * self.weight[p], texts * cells).reshape(texts, cells)
            np.add(sims, part + sums, out=sims, where=np.repeat(now, BLOCK, axis=1))

        def floors(seen: np.ndarray) -> np.ndarray:
            return np.partition(seen, -k, axis=1)[:, -k] if seen.shape[1] >= k else np.zeros(texts)

        def drop() -> None:
            if leave is not None:
                sims[np.arange(texts), self.place[leave]] = 0

        best = np.argsort(-bound, axis=1, kind="stable")[:, :FIRST_BLOCKS]
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, best, True, axis=1)
        first &= bound > 0
        add(first)
        drop()
        floor = floors(np.take_along_axis(sims.reshape(texts, self.blocks, BLOCK), best[:, :, None], axis=1).reshape(texts, -1))
        rest = ~first & (bound > 0) & (bound >= floor[:, None] - 1e-9)  # no other block can reach the k-th best
        if rest.any():
            add(rest)
            drop()
            floor = floors(sims)
        d, near = np.nonzero((sims > 1e-12) & (sims >= floor[:, None] - 1e-9))
        got = sims[d, near]
        by = np.lexsort((near, -np.round(got, 9), d))
        cuts = np.searchsorted(d, np.arange(1, texts))
        return list(zip(np.split(self.order[near[by]], cuts), np.split(got[by], cuts)))


def cast(sims: np.ndarray, toxic: np.ndarray, base: float, k: int = NEIGHBOURS) -> float:
    """Votes weighted by similarity; one weak vote of the base share stands in for what no neighbour says.

    Examples tied at the k-th place share the places left there, so their order does not matter.
    """
    share = np.ones(len(sims))
    if len(sims) > k:
        tied = sims <= sims[k - 1] + 1e-9
        tied &= sims >= sims[k - 1] - 1e-9
        share[tied] = (k - np.flatnonzero(tied)[0]) / tied.sum()
    w = sims * share
    return float(((w * toxic).sum() + 0.05 * base) / (w.sum() + 0.05))


def monotone(votes: np.ndarray, toxic: np.ndarray, base: float, bins: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Ascending scores at ascending votes: equal-width bins with one row of the base share each, pooled where they fall."""
    groups = []
    cell = np.minimum((votes * bins).astype(int), bins - 1)
    for c in range(bins):
        if (at := cell == c).any():
            groups.append([float(votes[at].sum()), float(toxic[at].sum()) + base, float(at.sum()), float(at.sum()) + 1])
    pooled: list[list[float]] = []
    for g in groups:
        pooled.append(g)
        while len(pooled) > 1 and pooled[-2][1] / pooled[-2][3] >= pooled[-1][1] / pooled[-1][3]:
            last = pooled.pop()
            pooled[-1] = [x + y for x, y in zip(pooled[-1], last)]
    if not pooled:
        return np.array([0.0, 1.0]), np.array([base, base])
    return np.array([g[0] / g[2] for g in pooled]), np.array([g[1] / g[3] for g in pooled])


@dataclass
class Model:
    names: list[str]
    scale: np.ndarray  # of each term: inverse document frequency times relation to the label
    index: BlockIndex
    toxic: np.ndarray
    doc_id: np.ndarray
    base: float  # share of label 1 among the examples
    knots: tuple[np.ndarray, np.ndarray]  # votes and their scores, both ascending

    def score(self, v: Vectors, k: int = NEIGHBOURS) -> list[tuple[float, list[int], list[float]]]:
        """The score of each text, the ids of its ``k`` nearest examples, and their similarities."""
        out = []
        for near, sims in self.index.batch(v, unit(v, self.scale), k):
            vote = cast(sims, self.toxic[near], self.base, k)
            out.append((float(np.interp(vote, *self.knots)), self.doc_id[near[:k]].tolist(), sims[:k].tolist()))
        return out


def unit(v: Vectors, scale: np.ndarray) -> np.ndarray:
    """Weights of the counts of all texts, those of each text of length 1."""
    w = (1 + np.log(v.counts)) * scale[v.terms]
    text = np.repeat(np.arange(len(v.offsets) - 1), np.diff(v.offsets))
    return w / np.sqrt(np.bincount(text, w * w, len(v.offsets) - 1))[text]


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Model:
    """The model. Without labels of both kinds every score is the base share, without any label 0.5."""
    names, known, v = gather(docs, labels, examples)
    df, total = document_frequencies(docs, names)
    toxic = np.array([x[2] for x in known], np.float64)
    scale = np.log(1 + total / (1 + df)) * relation(v, toxic, len(names))
    base = float((toxic.sum() + 0.5) / (len(toxic) + 1))
    weights = unit(v, scale)
    index = BlockIndex(v, weights, len(names))
    votes = np.empty(len(known))
    for lo in range(0, len(known), BATCH_TEXTS):
        hi = min(lo + BATCH_TEXTS, len(known))
        some = weights[v.offsets[lo]:v.offsets[hi]]
        for d, (near, sims) in enumerate(index.batch(v.part(lo, hi), some, NEIGHBOURS, leave=np.arange(lo, hi))):
            votes[lo + d] = cast(sims, toxic[near], base)
    knots = monotone(votes, toxic, base)
    return Model(names, scale, index, toxic, np.array([x[1] for x in known], np.int64), base, knots)


def batch_scores(m: Model, counter: Terms, known: dict, texts: pa.Array) -> list[tuple[float, list[int], list[float]]]:
    """The scores of a batch of texts; those of texts seen last are kept by their words' digests."""
    from hashlib import blake2b

    keys = [blake2b(x.as_buffer(), digest_size=16).digest() for x in texts]
    if len(known) > 20_000:
        known.clear()
    new = {k: i for i, k in enumerate(keys) if k not in known}
    if new:
        v = counter.vectors(texts.take(pa.array(new.values(), pa.int64())))
        made = (x for lo in range(0, len(new), BATCH_TEXTS) for x in m.score(v.part(lo, min(lo + BATCH_TEXTS, len(new)))))
        known.update(zip(new, made))
    return [known[k] for k in keys]


def plain(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))


def toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """(doc_id, score, near, similarity) of every row: near are the doc_ids of the nearest labelled examples.

    A null text is an empty one; a text that shares no term with an example gets the score of the examples' share of
    label 1. Null doc_ids and repeated rows keep their rows; of examples with equal texts the least doc_id stands for all
    and their labels are averaged. Labels that are null or neither 0 nor 1 are not used, of repeated ones the larger is.
    Other columns are not read. An empty table gives no rows; without usable labels every score is 0.5.
    """
    rows = plain(docs)
    shared = docs.sparkSession.sparkContext.broadcast(fit(rows, labels, examples))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, {}
        counter = Terms(m.names)
        for t in by_bytes(batches, limit=BATCH_BYTES):
            out = batch_scores(m, counter, known, strings(t.column("text")))
            yield pa.RecordBatch.from_arrays([
                one(t.column("doc_id")), pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.list_(pa.int64())),
                pa.array([x[2] for x in out], pa.list_(pa.float64()))], names=["doc_id", "score", "near", "similarity"])

    return rows.mapInArrow(run, "doc_id long, score double, near array<long>, similarity array<double>")


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches ``threshold``; no row is shuffled.

    All columns are carried along. Null texts, repeated rows, empty tables and labels are taken as in ``toxicity``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit(plain(docs), labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = shared.value, {}
        counter = Terms(m.names)
        for t in by_bytes(batches, limit=BATCH_BYTES):
            scores = [x[0] for x in batch_scores(m, counter, known, strings(t.column("text")))]
            yield from t.filter(pa.array([s < threshold for s in scores], pa.bool_())).to_batches()

    return docs.mapInArrow(run, docs.schema)
