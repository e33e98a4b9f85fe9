"""Filter interaction audit: which of five filters removes what, under every order of applying them.

Texts are reduced to a mask of the filters they fail. With 0 for a failed filter and infinity for a passed one, the
min-plus product of the mask matrix with the positions of the filters in each order (the inverse permutation) is the
step at which a mask is removed. Counts per part and mask are then scattered to those steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandlake.llm.ledger import digest
from strandlake.session import materialize

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, MARKS = 50, 65, 5, "[#$%&*|]"
_SPACE = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Parts turned into rows at once by a task.
PARTS_AT_ONCE = 64

ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: POSITION[o, f]: the step, from 1, of filter f in order o.
POSITION = np.array([[o.index(f) + 1 for f in FILTERS] for o in ORDERS], np.int64)
NEVER = np.iinfo(np.int64).max // 2
#: COST[m, f]: 0 if a text of mask m fails filter f.
COST = np.array([[0 if m >> f & 1 else NEVER for f in range(len(FILTERS))] for m in range(1 << len(FILTERS))], np.int64)
#: RANK[m, o]: the step that removes mask m in order o, by the min-plus product of both; NEVER and above if none does.
RANK = (COST[:, None, :] + POSITION[None, :, :]).min(axis=2)


def failures(docs: DataFrame) -> DataFrame:
    """(doc_id, part, digest, mask) of every row: bits 0 to 3 of mask are the failures of A to D. A null text is an empty one,
    a null source the part ''."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["source"].cast("string"), F.lit("")).alias("part"),
                       F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    words = rows.withColumn("words", F.array_remove(F.split("text", _SPACE), ""))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    upper = F.length("text") - F.length(F.translate("text", _UPPER, ""))
    bits = [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * upper > MOST_UPPER * F.length("text"), F.col("text").rlike(MARKS)]
    mask = sum((b.cast("int") * (1 << i) for i, b in enumerate(bits)), F.lit(0))
    return words.select("doc_id", "part", digest(F.col("text")).alias("digest"), mask.alias("mask"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): rows of each part by the filters they fail, and those labelled quality 1 and toxic 1.

    A row fails E if a row of equal text has a smaller doc_id; rows with the least doc_id of their text pass, also when that
    doc_id comes several times, and so do rows without a doc_id. They have no label either. Of several labels of a document
    any 1 counts. Equal rows are counted before they meet anything, and the first of a text is found through
    (doc_id, text), so that no group of copies is one task's.
    """
    facts = materialize(failures(docs), "filter-failures")
    first = facts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(1))
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), (labels["quality"] == 1).cast("int").alias("good"),
                          (labels["toxic"] == 1).cast("int").alias("toxic")).where("doc_id is not null")
    marks = marks.groupBy("doc_id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic"))
    counted = facts.groupBy("doc_id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    known = counted.where("doc_id is not null").join(marks, "doc_id", "left").join(first, ["doc_id", "digest"], "left")
    zero, one = F.lit(0), F.lit(1)
    every = known.select("part", "mask", "n", F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"),
                         F.coalesce("first", zero).alias("first"))
    lone = counted.where("doc_id is null").select("part", "mask", "n", zero.alias("good"), zero.alias("toxic"), one.alias("first"))
    mask = F.col("mask") + F.when(F.col("first") == 0, 1 << FILTERS.index("E")).otherwise(0)
    return every.union(lone).groupBy("part", mask.alias("mask")).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def scatter(n: np.ndarray) -> np.ndarray:
    """[part, order, step]: rows removed there, from [part, mask] counts."""
    out = np.zeros((len(n), len(ORDERS), len(FILTERS)), np.int64)
    for m, rank in enumerate(RANK):
        at = np.flatnonzero(rank <= len(FILTERS))
        out[:, at, rank[at] - 1] += n[:, m, None]
    return out


def redundancies(n: np.ndarray) -> np.ndarray:
    """[part, order, step]: rows that fail the step's filter and are gone already."""
    out = np.zeros((len(n), len(ORDERS), len(FILTERS)), np.int64)
    for m, rank in enumerate(RANK):
        for f in range(len(FILTERS)):
            if m >> f & 1:
                at = np.flatnonzero(POSITION[:, f] > rank)
                out[:, at, POSITION[at, f] - 1] += n[:, m, None]
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley): five rows for each
    part and order.

    Nulls, empty texts and repeated rows are handled as ``mask_counts`` says; other columns are not read. Documents without
    rows give no parts, so no rows; without labels nothing good or toxic is lost.
    """
    counts = mask_counts(docs, labels)
    # At most 32 entries a part.
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    at_step = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])
    orders = pa.array(np.repeat(np.array(ORDERS, object), len(FILTERS)).tolist(), pa.string())
    steps = np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, PARTS_AT_ONCE):
                names = b.column("part").slice(lo, PARTS_AT_ONCE)
                lists = b.column("masks").slice(lo, PARTS_AT_ONCE)
                flat = lists.flatten()
                where = np.repeat(np.arange(len(names)), np.array(lists.value_lengths()))
                mask = np.array(flat.field("mask"))
                w = {}
                for k in ("n", "good", "toxic"):
                    w[k] = np.zeros((len(names), len(RANK)), np.int64)
                    w[k][where, mask] = np.array(flat.field(k))
                removed = scatter(w["n"])
                kept = w["n"].sum(axis=1)[:, None, None] - np.cumsum(removed, axis=2)
                alone = w["n"][:, [1 << f for f in range(len(FILTERS))]]
                shapley = np.stack([removed[:, np.arange(len(ORDERS)), POSITION[:, f] - 1].sum(axis=1) for f in range(len(FILTERS))], axis=1)
                values = [kept, removed, redundancies(w["n"]), alone[:, at_step], scatter(w["good"]), scatter(w["toxic"]), shapley[:, at_step]]
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(np.repeat(np.arange(len(names)), steps.size))), pa.concat_arrays([orders] * len(names)),
                     pa.array(np.tile(steps, len(names))), *(pa.array(v.ravel()) for v in values)],
                    names=["part", "filter_order", "step", *COUNTS])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
