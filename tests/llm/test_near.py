import random

import numpy as np
import pytest

from strandlake.llm import order_minhash as N

SCHEMA = "doc_id long, text string, label string, node int, runs int"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            keep = row[j + 1]
            row[j + 1] = last + 1 if x == y else max(keep, row[j])
            last = keep
    return row[-1]


def shingles(text):
    w = text.split()
    k = min(5, len(w))
    return [tuple(w[i:i + k]) for i in range(len(w) - k + 1)] if w else []


def brute_classes(rows):
    """doc_id -> least doc_id over the components of all pairs with an aligned share of 0.8 or more."""
    runs = {i: shingles(t or "") for i, t in rows}
    text = {i: t or "" for i, t in rows}
    label = {i: i for i in runs}
    ids = sorted(runs)

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for x in range(len(ids)):
        for y in range(x):
            a, b = runs[ids[x]], runs[ids[y]]
            same = text[ids[x]] == text[ids[y]]
            if not same and a and b and min(len(a), len(b)) >= 0.8 * max(len(a), len(b)):
                m = lcs(a, b)
                same = m / (len(a) + len(b) - m) >= 0.8
            if same:
                p, q = sorted((root(ids[x]), root(ids[y])))
                label[q] = p
    return {i: root(i) for i in ids}


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits if out else 0):
        at = rng.randrange(len(out))
        what = rng.randrange(3)
        if what == 0:
            out[at] = f"new{rng.randrange(999)}"
        elif what == 1 and len(out) > 1:
            del out[at]
        else:
            out.insert(at, f"ins{rng.randrange(999)}")
    return out


@pytest.mark.parametrize("seed", range(200))
def test_banded_alignment_equals_the_full_one(seed):
    rng = random.Random(seed)
    a = [rng.randrange(rng.choice([3, 500])) for _ in range(rng.randrange(1, 60))]
    b = edited(rng, a, rng.randrange(0, 8))
    b = [x if isinstance(x, int) else int(x[3:]) + 1000 for x in b]
    if not b:
        return
    m = lcs(a, b)
    want = m / (len(a) + len(b) - m)
    got = N.similarity(np.array(a, np.uint64), np.array(b, np.uint64))
    assert got == pytest.approx(want) if want >= 0.8 else got < 0.8


def test_occurrences_tell_repeated_runs_apart():
    assert N.occurrences(np.array([7, 3, 7, 7, 3], np.uint64)).tolist() == [0, 0, 1, 2, 1]


def test_order_changes_the_sketch():
    runs = np.random.default_rng(1).integers(0, 1 << 63, 40, dtype=np.uint64)
    factors = N.hash_factors(64)
    a, b = N.sketch(runs, factors), N.sketch(runs[::-1].copy(), factors)
    assert (a == N.sketch(runs, factors)).all() and (a == b).mean() < 0.2


def test_classes_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = rng.sample(vocabulary, 60)
    rows, base = [], []
    for i in range(40):
        base.append(rng.sample(vocabulary, rng.randrange(20, 120)) + (passage if i % 3 == 0 else []))
    for i in range(160):
        w = base[i % 40] if i % 2 else rng.sample(vocabulary, rng.randrange(0, 60)) + passage
        rows.append((i, " ".join(edited(rng, w, rng.randrange(0, 4)) if len(w) > 5 else w)))
    rows += [(300, None), (301, ""), (302, "one two"), (303, "one  two"), (304, "one three"), (305, "x y z u v w " * 60), (306, "x y z u v w " * 60 + "end")]
    rows.append(rows[10])  # a repeated row
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    want = brute_classes(dict(rows).items())
    got = N.near_classes(docs).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: r.class_id for r in got} == want
    kept = N.representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_very_long_texts():
    words = np.arange(40000, dtype=np.uint64)
    a, b = N.kmers(words), N.kmers(np.insert(np.delete(words, [100, 20000]), 30000, 7))
    assert N.similarity(a, b) == pytest.approx((len(a) - 14) / (len(a) + len(b) - len(a) + 14), abs=1e-3)


def test_one_large_group_and_null_ids(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(150)]
    rows = [(i if i % 50 else None, " ".join(edited(rng, words, 2)), "x", 1, 2) for i in range(400)]
    rows += [(None, "alone and without an id", "x", 1, 2)] * 2
    got = N.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 402
    assert {r.class_id for r in got} == {1, None}
    assert len(N.representatives(spark.createDataFrame(rows, SCHEMA)).collect()) == 2


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert N.near_classes(docs).collect() == [] and N.representatives(docs).collect() == []
