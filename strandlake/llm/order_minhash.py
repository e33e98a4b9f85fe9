"""Near duplicates by Order MinHash, verified by banded alignment.

A k-mer is five words; repeated ones are told apart by their occurrence. For each of ``SKETCHES`` hash functions the
sketch takes the ``ORDERED`` least k-mers and hashes them in the order of the text, so two texts share an entry only if
the sampled k-mers are the same and stand in the same order. Texts that share an entry are candidates. A pair is linked if
an alignment of their k-mer sequences matches L of them with L / (n_a + n_b - L) >= 0.8; matches that far never leave a
band around the diagonal, and only the band is aligned. Texts of few k-mers, whose sketches can all differ, also have entries
for what they are without the k-mers that a link may leave unmatched, so that linked ones share an entry (see ``_parts``).

Candidates are not enumerated within a bucket: all members are first held against one member (the one with most
companions, then any), what is linked shares a label, and only members whose labels still differ are tested in pairs at
the end, by blocks of members. Of those, a pair is passed over only if it cannot be linked: its common k-mers, in whatever
order, are too few. So a bucket of a million near copies costs about a million alignments, and no link between labels is
left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandlake.llm.batches import by_bytes, one, split_words, strings, word_hashes
from strandlake.llm.components import components
from strandlake.session import materialize

WORDS, SIMILARITY, SKETCHES, ORDERED, STAR_ROUNDS, BLOCK = 5, 0.8, 32, 5, 2, 64
#: A link of L matched k-mers leaves L // 4 unmatched at most: three up to 18 k-mers, two (wherever they stand) up to 13.
FEW, FEW_ANYWHERE = 18, 13
NO_ID = (1 << 63) - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def kmers(hashes: np.ndarray, words: int = WORDS) -> np.ndarray:
    """Hashes of all runs of ``words`` words; a shorter text is one run, an empty text none."""
    n = len(hashes)
    if n == 0:
        return hashes
    k = min(words, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = (out ^ (out >> np.uint64(29))) * _MIX + hashes[i:n - k + 1 + i]
    return out ^ (out >> np.uint64(32))


def occurrences(runs: np.ndarray) -> np.ndarray:
    """0 for the first run of its kind in the text, 1 for the second and so on."""
    order = np.argsort(runs, kind="stable")
    sorted_runs = runs[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_runs[1:] != sorted_runs[:-1]]))
    if len(first) == len(runs):
        return np.zeros(len(runs), np.uint64)
    out = np.empty(len(runs), np.uint64)
    out[order] = np.arange(len(runs)) - np.repeat(first, np.diff(np.append(first, len(runs))))
    return out


def hash_factors(sketches: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1 << 62, 1 << 63, sketches, dtype=np.uint64) | np.uint64(1)


def labelled_runs(runs: np.ndarray) -> np.ndarray:
    """Runs told apart by their occurrence, so that common elements count common runs as often as both have them."""
    return runs + occurrences(runs) * _MIX


def sketch(runs: np.ndarray, factors: np.ndarray, ordered: int = ORDERED) -> np.ndarray:
    """One entry per factor; none for a text without runs."""
    n, m = len(runs), len(factors)
    if not n:
        return np.empty(0, np.int64)
    labelled = labelled_runs(runs)
    labelled = (labelled ^ (labelled >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    k = min(ordered, n)
    if k < n:
        least = np.argpartition(labelled[None, :] * factors[:, None], k - 1, axis=1)[:, :k]
        least.sort(axis=1)  # back to the order of the text
        chosen = runs[least]
    else:
        chosen = np.broadcast_to(runs, (m, n))
    out = factors.copy()
    for i in range(k):
        out = (out ^ (out >> np.uint64(30)) ^ chosen[:, i]) * _MIX
    return (out ^ (out >> np.uint64(32))).view(np.int64)


@cache
def _parts(n: int) -> list[np.ndarray]:
    """Places kept of ``n`` runs, a matrix for each number of runs left out; beyond ``FEW_ANYWHERE`` runs, two or more are left
    out at the ends only (elsewhere only texts that repeat a word can lose them)."""
    out = [np.arange(n)[None, :]]
    for gone in range(1, n):
        if gone > (n - gone) // 4:
            break
        if gone < 2 or n <= FEW_ANYWHERE:
            out.append(np.array([[i for i in range(n) if i not in c] for c in combinations(range(n), gone)]))
        else:
            out.append(np.arange(n - gone)[None, :] + np.arange(gone + 1)[:, None])
    return out


def few_entries(runs: np.ndarray) -> np.ndarray:
    """Entries of a text of 4 to ``FEW`` runs: what is left without as many runs as a link may leave unmatched in it."""
    if not 4 <= len(runs) <= FEW:
        return np.empty(0, np.int64)
    made = []
    for places in _parts(len(runs)):
        out = np.full(len(places), places.shape[1], np.uint64)
        for i in range(places.shape[1]):
            out = (out ^ (out >> np.uint64(30)) ^ runs[places[:, i]]) * _MIX
        made.append(out ^ (out >> np.uint64(32)))
    return np.unique(np.concatenate(made)).view(np.int64)


def entries_of(runs: np.ndarray, factors: np.ndarray, ordered: int = ORDERED) -> np.ndarray:
    return np.concatenate([sketch(runs, factors, ordered), few_entries(runs)])


def matched(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> int:
    """The most runs an alignment inside the band matches, exact wherever the similarity reaches ``least``, else lower or -1."""
    na, nb = len(a), len(b)
    need = math.ceil(least * (na + nb) / (1 + least) - 1e-9)
    if min(na, nb) < need:
        return -1
    short = min(na, nb)
    differs = np.flatnonzero(a[:short] != b[:short])
    head = int(differs[0]) if len(differs) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    differs = np.flatnonzero(a[len(a) - short:][::-1] != b[len(b) - short:][::-1])
    tail = int(differs[0]) if len(differs) else short
    a, b = a[:len(a) - tail], b[:len(b) - tail]
    same = head + tail
    if not len(a) or not len(b):
        return same
    if same + min(int(np.isin(a, b).sum()), int(np.isin(b, a).sum())) < need:
        return -1
    band = na + nb - 2 * need  # more unmatched runs than this and the similarity is missed
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b.tolist()):
        where.setdefault(x, []).append(j)
    row = (1 << len(b)) - 1  # a zero bit: one more match up to this column
    full = row
    for i, x in enumerate(a.tolist()):
        hits = 0
        for j in where.get(x, ()):
            if i - band <= j <= i + band:
                hits |= 1 << j
        if hits:
            u = row & hits
            row = ((row + u) | (row - u)) & full
    return same + len(b) - row.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Matched share of an alignment, 0 where it is known to be below ``least``."""
    both = matched(a, b, least)
    return both / (len(a) + len(b) - both) if both > 0 else 0.0


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)).alias("id"), text.alias("text"),
                       F.unhex(F.substring(F.sha2(text, 256), 1, 32)).alias("node"))


def sketched(docs: DataFrame, sketches: int = SKETCHES, ordered: int = ORDERED) -> DataFrame:
    """(id, node, n, sketch) of every row; node stands for the text, n counts its runs."""
    factors = hash_factors(sketches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_bytes(batches):
            codes, names, offsets = split_words(strings(t.column("text")))
            hashes = word_hashes(names)[codes]
            done: dict[bytes, tuple[int, np.ndarray]] = {}
            counts, entries = [], []
            for i, node in enumerate(t.column("node").to_pylist()):
                if node not in done:
                    runs = kmers(hashes[offsets[i]:offsets[i + 1]])
                    done[node] = len(runs), entries_of(runs, factors, ordered)
                counts.append(done[node][0])
                entries.append(done[node][1])
            ends = np.cumsum([0, *map(len, entries)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(entries)))
            yield pa.RecordBatch.from_arrays([one(t.column("id")), one(t.column("node")), pa.array(counts, pa.int32()), lists],
                                             names=["id", "node", "n", "sketch"])
            del codes, names, hashes, done, entries, lists

    return _keyed(docs).mapInArrow(run, "id long, node binary, n int, sketch array<long>")


def _profiles(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, runs) of the wanted (id, node): one row of each text that is in a bucket with others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_bytes(batches):
            codes, names, offsets = split_words(strings(t.column("text")))
            hashes = word_hashes(names)[codes]
            runs = [kmers(hashes[a:b]).astype("<u8").tobytes() for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([one(t.column("node")), pa.array(runs, pa.binary())], names=["node", "runs"])
            del codes, names, hashes, runs

    rows = _keyed(docs).join(wanted, ["id", "node"], "left_semi").select("node", "text")
    return rows.mapInArrow(run, "node binary, runs binary").dropDuplicates(["node"])


def private_runs(profiles: DataFrame) -> DataFrame:
    """(node, private): how many runs of each text are in none of the others. A node's two halves stand for it in sums."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, data in zip(batch.column("node").to_pylist(), batch.column("runs").to_pylist()):
                value, times = np.unique(np.frombuffer(data, "<i8"), return_counts=True)
                high, low = np.frombuffer(node, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), high)), pa.array(np.full(len(value), low)), pa.array(value),
                                                  pa.array(times)], names=["high", "low", "run", "times"])

    each = profiles.mapInArrow(run, "high long, low long, run long, times long")
    alone = each.groupBy("run").agg(F.min("high").alias("high"), F.max("high").alias("high_to"), F.min("low").alias("low"),
                                    F.max("low").alias("low_to"), F.sum("times").alias("times")).filter("high = high_to and low = low_to")
    whole = F.udf(lambda high, low: np.array([high, low], "<i8").tobytes(), "binary", useArrow=True)
    return alone.groupBy("high", "low").agg(F.sum("times").alias("private")).select(whole("high", "low").alias("node"), "private")


def verified(pairs: DataFrame, profiles: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose alignment reaches ``least``, with their similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [similarity(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), least)
                     for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            keep = pa.array([s >= least for s in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found, pa.float64())],
                                             names=["a", "b", "similarity"]).filter(keep)

    x = profiles.select(F.col("node").alias("a"), F.col("runs").alias("x"))
    y = profiles.select(F.col("node").alias("b"), F.col("runs").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary, similarity double")


def linked_in_blocks(left: list[dict], right: list[dict], least: float = SIMILARITY) -> list[tuple[bytes, bytes, float]]:
    """Links between members (node, label, runs) of two blocks of one bucket, at most one for each left member and right label.

    One matrix product counts the common runs of all pairs; only pairs that have enough are aligned.
    """
    xs, ys = ([np.frombuffer(m["runs"], "<u8") for m in side] for side in (left, right))
    flat = np.concatenate([labelled_runs(r) for r in (*xs, *ys)])
    _, place = np.unique(flat, return_inverse=True)
    sizes = np.array([len(r) for r in (*xs, *ys)])
    has = np.zeros((len(sizes), int(place.max()) + 1), np.float32)
    has[np.repeat(np.arange(len(sizes)), sizes), place] = 1
    nx, ny = sizes[:len(xs), None], sizes[None, len(xs):]
    enough = has[:len(xs)] @ has[len(xs):].T >= least / (1 + least) * (nx + ny) - 1e-6
    found, done = [], set()
    for i, j in zip(*np.nonzero(enough)):
        a, b = left[i], right[j]
        if a["label"] != b["label"] and (i, b["label"]) not in done and (s := similarity(xs[i], ys[j], least)) >= least:
            found.append((a["node"], b["node"], s))
            done.add((i, b["label"]))
    return found


def open_links(live: DataFrame, profiles: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity): links between members of a bucket whose labels (key, node, n, label) differ.

    The members outside a bucket's most frequent label are held against all of it, block by block; a block has about
    ``BLOCK`` members. Members most of whose runs no other member has cannot be linked and take no part.
    """
    sizes = live.groupBy("key", "label").count()
    main = sizes.groupBy("key").agg(F.max(F.struct("count", "label")).alias("m")).select("key", F.col("m.label").alias("main"))
    private = private_runs(profiles.join(live.select("node").distinct(), "node", "left_semi"))
    able = live.select("node", "n").distinct().join(private, "node", "left").filter(
        F.col("n") - F.coalesce("private", F.lit(0)) >= least * F.col("n") - 1e-6).select("node")
    marked = live.join(able, "node").join(main, "key").withColumn("minor", F.col("label") != F.col("main"))
    marked = materialize(marked.select("key", "node", "label", "minor"), "open-members")
    counts = marked.groupBy("key", "minor").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    some = marked.filter("minor").select("key").distinct()
    dealt = marked.join(some, "key", "left_semi").join(counts, ["key", "minor"]).join(profiles, "node").withColumn(
        "block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    blocks = materialize(dealt.groupBy("key", "minor", "block").agg(F.collect_list(F.struct("node", "label", "runs")).alias("members")), "open-blocks")
    x = blocks.filter("minor").select("key", F.col("block").alias("at"), F.col("members").alias("left"))
    y = blocks.select("key", F.col("block").alias("to"), "minor", F.col("members").alias("right"))
    met = x.join(y, "key").filter(~F.col("minor") | (F.col("at") <= F.col("to"))).select("left", "right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = linked_in_blocks(batch.column("left")[i].as_py(), batch.column("right")[i].as_py(), least)
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.binary()),
                                                  pa.array([f[2] for f in found], pa.float64())], names=["a", "b", "similarity"])

    spark = live.sparkSession
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, "16")  # a row holds two blocks
    try:
        return materialize(met.mapInArrow(run, "a binary, b binary, similarity double"), "open-links")
    finally:
        spark.conf.set(rows, before)


def _ordered(pairs: DataFrame, least: float) -> DataFrame:
    """Distinct (a, b), a < b, of (p, p_n, q, q_n) whose counts of runs allow the similarity."""
    close = F.least("p_n", "q_n") >= F.lit(least) * F.greatest("p_n", "q_n") - 1e-6
    return pairs.filter(close).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()


def link(docs: DataFrame, least: float = SIMILARITY, sketches: int = SKETCHES, ordered: int = ORDERED) -> tuple[DataFrame, DataFrame]:
    """All texts of ``docs`` (id, node, n) and the label (node, label) of those with near copies among other texts."""
    rows = materialize(sketched(docs, sketches, ordered), "sketches")
    texts = rows.groupBy("node").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    entries = materialize(texts.select("id", "node", "n", F.explode("sketch").alias("key")), "entries")
    shared = entries.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("many"))
    members = materialize(entries.join(shared.filter("lo < hi").select("key", "many"), "key"), "members")
    company = members.groupBy("node").agg(F.sum("many").alias("company"))
    profiles = materialize(_profiles(docs, members.select("id", "node").distinct()), "profiles")
    labels = members.select("node").distinct().withColumn("label", F.col("node"))
    for step in range(STAR_ROUNDS + 1):
        live = members.select("key", "node", "n").join(labels, "node")
        if step:
            open_keys = live.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key")
            live = materialize(live.join(open_keys, "key", "left_semi"), "live")
        if step < STAR_ROUNDS:
            if not step:
                live = live.join(company, "node")
            turn = F.xxhash64("node", "key", F.lit(step)) if step else -F.col("company")
            centre = live.groupBy("key").agg(F.min(F.struct(turn.alias("turn"), "node", "n", "label")).alias("c"))
            pairs = live.join(centre, "key").filter(F.col("label") != F.col("c.label")).select(
                F.col("node").alias("p"), F.col("n").alias("p_n"), F.col("c.node").alias("q"), F.col("c.n").alias("q_n"))
            links = materialize(verified(_ordered(pairs, least), profiles, least), "links")
        else:
            links = open_links(live, profiles, least)
        if links.limit(1).count():
            at = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
            joined = links.join(at[0], "a").join(at[1], "b").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
            merged = components(materialize(joined, "label-links")).select(F.col("node").alias("label"), F.col("label").alias("low"))
            labels = materialize(labels.join(merged, "label", "left").select("node", F.coalesce("low", "label").alias("label")), "classes")
    return rows, labels


def near_classes(docs: DataFrame, least: float = SIMILARITY, sketches: int = SKETCHES, ordered: int = ORDERED) -> DataFrame:
    """(doc_id, class_id, node) for every row; class_id is the least doc_id of its class.

    Equal texts share a class, near copies are linked and classes are the components of all links. A null text counts as
    an empty one; empty texts are copies of each other and near to nothing else. A text of under five words is one run.
    A row with a null doc_id keeps it, and its class_id is null only if no row of the class has an id. Rows that repeat
    a doc_id each get the class of their own text. Other columns are not read. An empty table gives no rows.
    """
    rows, labels = link(docs, least, sketches, ordered)
    texts = rows.groupBy("node").agg(F.min("id").alias("id")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least_id = texts.groupBy("label").agg(F.min("id").alias("class_id"))
    classes = texts.join(least_id, "label").select("node", "class_id")
    return rows.select("id", "node").join(classes, "node").select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), F.when(F.col("class_id") != NO_ID, F.col("class_id")).alias("class_id"), "node")


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of its least doc_id (of rows that share it and the class, one)."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    kept = near_classes(docs).filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy(
        key.alias("_near_id"), F.coalesce("class_id", F.lit(NO_ID)).alias("_near_class")).agg(F.min("node").alias("_near_node"))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    named = docs.withColumn("_near_id", key).withColumn("_near_node", F.unhex(F.substring(F.sha2(text, 256), 1, 32)))
    return named.join(kept.select("_near_id", "_near_node"), ["_near_id", "_near_node"], "left_semi").dropDuplicates(["_near_id", "_near_node"]).select(*docs.columns)
