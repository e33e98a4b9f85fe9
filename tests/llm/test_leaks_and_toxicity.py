import random
import zlib

import numpy as np
import pytest

from strandlake.llm import knn_toxicity as K, spaced_seeds as S

DOCS = "doc_id long, text string, seed long, words string, toxic int"


def brute_leaks(docs, items, overlap=13, share=0.8):
    """All (doc_id, item_id) with a stretch on a diagonal that starts and ends equal and is long and equal enough."""
    norm = lambda t: [w.lower().strip(S._EDGE) for w in (t or "").split()]
    found = {}
    for d, text in docs:
        a = norm(text)
        for i, item in items:
            b = norm(item)
            need = min(overlap, -(-4 * len(b) // 5))
            for shift in range(-len(b) + 1, len(a)):
                lo, hi = max(0, shift), min(len(a), shift + len(b))
                e = [a[x] == b[x - shift] for x in range(lo, hi)]
                for x in range(len(e)):
                    for y in range(x + need, len(e) + 1):
                        if e[x] and e[y - 1] and sum(e[x:y]) >= share * (y - x) - 1e-9:
                            found[d, i] = max(found.get((d, i), 0), y - x)
    return found


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"v{i}" for i in range(4000)]
    items = [(i, " ".join(rng.sample(vocabulary, rng.choice([1, 3, 4, 5, 6, 7, 8, 9, 20, 30])))) for i in range(25)] + [(90, None), (91, "")]
    docs = []
    for i in range(90):
        words = rng.sample(vocabulary, rng.randrange(0, 80))
        if i % 3 == 0:
            part = items[i % 25][1].split()
            if i % 2:
                part = [w if k % 7 != 3 else "changed" for k, w in enumerate(part)]
            if i % 5 == 0:
                part = [w.upper() + "," for w in part]
            if i % 4 == 1:
                part = part[:8]
            words[10:10] = part
        docs.append((i, " ".join(words)))
    docs += [(500, None), (501, ""), (None, items[4][1]), (502, "a " * 5000 + items[5][1])]
    table = spark.createDataFrame([(*d, 1, "x", 0) for d in docs] + [(*docs[0], 1, "x", 0)], DOCS)
    bench = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, seed string")
    got = {(r.doc_id, r.item_id): r.length for r in S.leaks(table, bench).collect()}
    assert got == brute_leaks(docs, items)
    clean = S.decontaminate(table, bench)
    assert clean.columns == table.columns
    bad = {d for d, _ in got}
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((d for d, _ in docs + [docs[0]] if d not in bad), key=str)


def test_no_items_or_no_documents(spark):
    none = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c", 1, "x", 0)], DOCS)
    assert S.leaks(none, bench).collect() == [] and S.leaks(some, bench).collect() == []
    assert S.decontaminate(some, bench).count() == 1


def some_vectors(rng, rows, terms, most):
    made = [np.sort(rng.choice(terms, rng.integers(0, most), replace=False)) for _ in range(rows)]
    flat = np.concatenate(made)
    return K.Vectors(np.concatenate([[0], np.cumsum([len(x) for x in made])]), flat, rng.integers(1, 4, len(flat)))


def dense(v, weights, terms):
    out = np.zeros((len(v.offsets) - 1, terms))
    for d in range(len(out)):
        out[d, v.terms[v.of(d)]] = weights[v.of(d)]
    return out


@pytest.mark.parametrize("share", [0, 8, 10 ** 9])  # no dense rows, some, all
def test_block_index_equals_brute_force(share):
    rng = np.random.default_rng(2)
    terms, k = 40, 15
    v, asked = some_vectors(rng, 500, terms, 8), some_vectors(rng, 60, terms, 8)
    scale = rng.random(terms) + 0.01
    index = K.BlockIndex(v, K.unit(v, scale), terms, share)
    sims = dense(asked, K.unit(asked, scale), terms) @ dense(v, K.unit(v, scale), terms).T
    leave = rng.integers(0, 500, 60)
    for d, (near, got) in enumerate(index.batch(asked, K.unit(asked, scale), k, leave)):
        want = sims[d].copy()
        want[leave[d]] = 0
        floor = max(np.sort(want)[-k] - 1e-9, 1e-12)
        assert sorted(near.tolist()) == np.flatnonzero(want >= floor).tolist()  # with all that tie at the last place
        assert np.allclose(got, want[near]) and (np.diff(got) <= 1e-9).all()


def test_ties_do_not_depend_on_their_order():
    sims, toxic = np.array([0.9, 0.5, 0.5, 0.5]), np.array([1.0, 0, 1, 1])
    votes = {round(K.cast(sims, toxic[[0, *p]], 0.1, 2), 12) for p in ((1, 2, 3), (2, 1, 3), (3, 2, 1))}
    assert len(votes) == 1
    assert votes.pop() == pytest.approx((0.9 + 0.5 * 2 / 3 + 0.005) / (0.9 + 0.5 + 0.05))


def terms_of(word):
    w = word.lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
    return [w, *(w[:k] + "*" for k in (4, 5) if len(w) > k)] if w else []


def test_terms_of_words_in_any_script():
    import pyarrow as pa

    words = ["", "a", "Word", "WORDS,", "--longer!", "***", "don't", "Über-Größe", "ÉTÉS", "«Вечером»", "東京都庁舎", "e\u0301tude", "ab" * 5000]
    terms, owner = K.word_terms(pa.array(words))
    got = {i: [] for i in range(len(words))}
    for t, i in zip(terms.to_pylist(), owner.tolist()):
        got[i].append(t)
    assert [got[i] for i in range(len(words))] == [terms_of(w) for w in words]
    assert K.Terms(["a"]).vectors(pa.array(["", " ", "b"])).offsets.tolist() == [0, 0, 0, 0]


@pytest.mark.parametrize("rows", [12, 150])
def test_neighbours_equal_plain_cosine_over_all_terms_of_the_examples(spark, rows):
    """Whole texts in, neighbours out, against dictionaries: also with few labels, where no term goes with the label."""
    rng = random.Random(rows)
    texts = {i: " ".join(rng.choice(["alpha", "beta", "gamma", "deltas", "epsilon", f"w{rng.randrange(60)}"]) for _ in range(rng.randrange(1, 30)))
             for i in range(rows)}
    texts[3] = texts[0]
    y = {i: int(rng.random() < 0.3) for i in texts if i % 3}
    docs = spark.createDataFrame([(i, x, 1, "x", 0) for i, x in texts.items()] + [(rows, "zzz", 1, "x", 0)], DOCS)
    marks = spark.createDataFrame([(i, 1, t) for i, t in y.items()], "doc_id long, quality int, toxic int")
    m = K.fit(K.plain(docs), marks)
    learnt = {}
    for i in sorted(y):
        if zlib.crc32(str(i).encode()) % 3 != 1:
            learnt.setdefault(texts[i], i)

    def vector(text):
        tf = {}
        for w in text.split():
            for t in terms_of(w):
                if t in known:
                    tf[t] = tf.get(t, 0) + 1
        w = {t: (1 + np.log(n)) * known[t] for t, n in tf.items()}
        length = sum(x * x for x in w.values()) ** 0.5
        return {t: x / length for t, x in w.items()}

    known = dict(zip(m.names, m.scale))
    assert set(known) == {t for x in learnt for w in x.split() for t in terms_of(w)}  # no term of an example is left out
    df = {t: sum(any(t in terms_of(w) for w in x.split()) for x in texts.values()) for t in known}
    idf = np.array([np.log(1 + (rows + 1) / (1 + df[t])) for t in m.names])
    assert (m.scale >= K.UNRELATED * idf - 1e-12).all()
    vectors = {i: vector(x) for x, i in learnt.items()}
    for r in K.toxicity(docs, marks).collect():
        v = vector(texts.get(r.doc_id, "zzz"))
        want = sorted((s for s in (sum(x * u.get(t, 0) for t, x in v.items()) for u in vectors.values()) if s > 1e-12), reverse=True)
        assert np.allclose(r.similarity, want[:K.NEIGHBOURS])
        assert all(abs(sum(x * vectors[i].get(t, 0) for t, x in v.items()) - s) < 1e-9 for i, s in zip(r.near, r.similarity))


def test_toxic_documents_are_found_and_clean_ones_kept(spark):
    rng = random.Random(6)
    bad = ["vile", "awful", "slur"]
    rows, labels = [], []
    for i in range(1500):
        words = [f"w{rng.randrange(400)}" for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            words[5:5] = rng.choices(bad, k=3)
        rows.append((i, " ".join(words), 1, "x", 0))
        if i % 2:
            labels.append((i, 1, int(toxic)))
        elif i % 4 == 0:
            labels.append((i, None, int(toxic)))
    rows += [(None, None, 1, "x", 0), (9000, "", 1, "x", 0), (9001, "vile " * 9000, 1, "x", 0)]
    labels += [(None, 1, 1), (3, 1, None)]
    docs = spark.createDataFrame(rows, DOCS)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in K.toxicity(docs, marks).collect()}
    assert len(got) == 1503
    assert all(0 <= s <= 1 for s in got.values())
    assert all((got[i] >= K.THRESHOLD) == (i % 6 == 0) for i in range(1500))
    assert got[None] == got[9000] < K.THRESHOLD <= got[9001]
    kept = K.reject_toxic(docs, marks)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((i for i, s in got.items() if s < K.THRESHOLD), key=str)


def test_no_labels_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "a b", 1, "x", 0)], DOCS)
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.score for r in K.toxicity(docs, marks).collect()] == [0.5]
    assert K.toxicity(spark.createDataFrame([], DOCS), marks).collect() == []


def test_held_out_rows_follow_the_checksum(spark):
    from pyspark.sql import functions as F

    got = spark.range(300).select("id", K.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 3 == 1) for r in got)
