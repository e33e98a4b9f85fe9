"""Operators 11 to 13 against plain statements of what they compute."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from strandlake.llm import bit_sliced_search as S, removal_ranks as R, template_markup as M

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as columns of the input.
CLASH = ("part", "mask", "digest", "first", "n", "words", "block", "term", "good", "toxic", "labels", "score", "matches", "item")


def frame(spark, rows, clash=False):
    df = spark.createDataFrame(rows, DOCS)
    if clash:
        from pyspark.sql import functions as F

        for c in CLASH:
            df = df.withColumn(c, F.lit("x"))
    return df


# Licenses


def as_regex(tree):
    return "".join(x + " " if isinstance(x, str) else f"(?:{as_regex(x)})?" if isinstance(x, list) else f"(?:[^ ]+ ){{{x[0]},{x[1]}}}" for x in tree)


def plain_scan(text, templates=M.TEMPLATES):
    words = M.words(text or "")
    joined = " " + " ".join(words) + " "
    places, base, best = [], set(), 0
    for p, label in M.PHRASES.items():
        w = p.split()
        at = [i for i in range(len(words) - len(w) + 1) if words[i:i + len(w)] == w]
        places += at
        if at:
            base.add(label)
            best = max(best, len(w))
    labels = set(base)
    for _, label, t in templates:
        tree = M.parse(t)
        if re.search(" " + as_regex(tree), joined):
            labels.add(label)
            best = max(best, M.mandatory(tree))
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
            best / (best + 1))


def filled(tree, rng):
    """A text of a template: gaps filled, optional regions there or not."""
    out = []
    for x in tree:
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, list):
            out += filled(x, rng) if rng.random() < 0.5 else []
        else:
            out += [f"x{rng.randrange(9)}" for _ in range(rng.randint(*x))]
    return out


def test_templates_accept_their_texts_and_no_changed_wording():
    rng = random.Random(1)
    m = M.Matcher()
    for k, (name, _, t) in enumerate(M.TEMPLATES):
        tree = M.parse(t)
        for _ in range(4):
            seq = ["before", *filled(tree, rng), "after"]
            assert any(f[:2] == (k, 1) and f[2] <= len(seq) for f in m.matches(seq, list(range(len(seq))))), name
        must = [x for x in tree if isinstance(x, str)]
        spot = rng.randrange(len(must))
        wrong = [x if not isinstance(x, str) or i != spot else "changed" for i, x in enumerate(must)]
        assert not any(f[0] == k for f in m.matches(wrong, list(range(len(wrong))))), name


def test_markup_is_checked():
    for bad in ("[[open", "close]]", "{{3,1}} x", "[[only]]", "{{1,2}} late"):
        with pytest.raises(ValueError):
            M.Matcher([("t", "l", bad)])


def test_scan_equals_plain_statement(spark):
    rng = random.Random(2)
    trees = [M.parse(t) for _, _, t in M.TEMPLATES]
    texts = [None, "", "...", "under the MIT license, under the mit-license", "Under the MIT Apache License. Version 2", "CC BY NC cc by nc",
             "é under the mit license", "apache license version 2", "under the mit", "released under the terms of the MIT License"]
    for _ in range(150):
        seq = []
        for _ in range(rng.randint(1, 4)):
            part = filled(rng.choice(trees), rng)
            if rng.random() < 0.3:
                part[rng.randrange(len(part))] = "other"
            if rng.random() < 0.2:
                part = part[:rng.randrange(len(part) + 1)]
            seq += part + [f"w{rng.randrange(50)}" for _ in range(rng.randrange(6))]
        texts.append("".join(w.upper() + rng.choice([" ", ", ", "\n", "-"]) for w in seq))
    texts.append("word " * 300_000 + "cc by nc " + "released under the MIT license " * 2000)
    rows = [(i if i != 4 else None, t, "en", "s", 1) for i, t in enumerate(texts)] + [(0, None, None, None, None)] * 2
    got = [tuple(r)[1:8] for r in sorted(M.scan(frame(spark, rows, clash=True)).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.n_words))]
    want = [plain_scan(t) for _, t in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, len(M.words(r[1] or ""))))]
    assert got == want
    assert M.scan(frame(spark, [])).count() == 0


def test_scan_gives_longest_stretches(spark):
    t = [("t", "x", "a [[b [[c]]]] {{0,2}} d")]
    rows = [(0, "a b c d z a q d d a d", "en", "s", 1)]
    assert [tuple(m) for m in M.scan(frame(spark, rows), t, {}).first().matches] == [("t", 0, 4), ("t", 5, 9), ("t", 9, 11)]


# Search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k=20):
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, all_terms = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    asked = {}
    for item, text in items:
        if item is not None:
            asked.setdefault(item, Counter()).update(terms(text))
    out = []
    for item, q in asked.items():
        scores = []
        for d, c in counted:
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // all_terms
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 12 * m))
                    for w, times in q.items() if w in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, i + 1, None if none else d, -s) for i, (s, none, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def some_texts(rng, n):
    vocabulary = [f"t{i}" for i in range(300)]
    return [" ".join(vocabulary[min(int(rng.expovariate(0.02)), 299)] for _ in range(rng.choice([1, 3, 20, 200, 2000]))) for _ in range(n)]


@pytest.mark.parametrize("terms_a_pass", [100_000, 40])
def test_search_equals_plain_statement(spark, monkeypatch, terms_a_pass):
    monkeypatch.setattr(S, "TERMS_A_PASS", terms_a_pass)
    monkeypatch.setattr(S, "BLOCK_DOCS", 37)
    rng = random.Random(3)
    texts = some_texts(rng, 400) + [None, "", "!!", "Ünder ünder T1 t1 T1"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 3 + [(1000 + i, "t0 t1 t2") for i in range(60)] + [(None, "t290 t0"), (None, "t0 t1 t2")]
    items = [(i, t) for i, t in enumerate(some_texts(rng, 12))] + [(50, None), (51, "nowhere"), (None, "t1"), (52, "t3"), (52, "T3 t4 t4"), (53, "ünder t0 t1 t2")]
    df = frame(spark, [(d, t, "en", "s", 1) for d, t in docs], clash=True).repartition(5)
    q = spark.createDataFrame(items, "item_id long, text string")
    assert sorted((tuple(r) for r in S.search(df, q).collect()), key=str) == plain_search(docs, items)
    assert sorted((tuple(r) for r in S.search(df, q, 3).collect()), key=str) == plain_search(docs, items, 3)


def test_search_of_nothing(spark):
    q = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert S.search(frame(spark, []), q).count() == 0
    assert S.search(frame(spark, [(1, None, "", "", 0)]), q).count() == 0
    assert S.search(frame(spark, [(1, "a", "", "", 0)]), q.limit(0)).count() == 0


def test_bounds_are_never_below_the_score():
    rng = random.Random(4)
    texts = some_texts(rng, 60)
    held = S._Open()
    held.ids, held.texts = list(range(60)), texts
    import pyarrow as pa

    for width in (512, 4096):  # the narrow one is full of false marks
        b = S._close(held, width, "b")
        df = dict(zip(b["terms"], b["dfs"].tolist()))
        row = type("Row", (), {})
        rows = []
        for item in range(5):
            for t, times in Counter(terms(texts[item])).items():
                r = row()
                r.item_id, r.term, r.times, r.df = item, t, times, df[t]
                rows.append(r)
        q = S.Query(rows, 60, int(b["n_terms"].sum()))
        score = q.scorer(pa.array(texts), b["n_terms"])
        up = q.bounds(width, b["slices"], b["n_terms"])
        exact = np.array([[score(i, j) for j in range(60)] for i in range(len(q.items))])
        assert (up >= exact).all()
        if width == 4096:  # and a short text is told from its like
            short = b["n_terms"] <= 20
            assert (up[:, short] <= 1.35 * exact[:, short] + 1).mean() > 0.9


# Audit


def plain_audit(docs, labels):
    good, bad = {d for d, q, _ in labels if q == 1} - {None}, {d for d, _, t in labels if t == 1} - {None}
    least = {}
    for d, t, _ in docs:
        if d is not None:
            least[t or ""] = min(least.get(t or "", d), d)
    parts = {}
    for d, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, x in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                                            bool(re.search(r"[#$%&*|]", t)), d is not None and d > least[t])) if x}
        parts.setdefault(s or "", []).append((d, fails))
    out = []
    for part, rows in parts.items():
        removed_by = Counter()
        mine = []
        for order in map("".join, permutations("ABCDE")):
            live = list(rows)
            for step, f in enumerate(order, 1):
                gone = [r for r in live if f in r[1]]
                live = [r for r in live if f not in r[1]]
                removed_by[f] += len(gone)
                failing = sum(f in r[1] for r in rows)
                mine.append([part, order, step, len(live), len(gone), failing - len(gone), sum(r[1] == {f} for r in rows),
                             sum(r[0] in good for r in gone), sum(r[0] in bad for r in gone)])
        out += [tuple(x + [removed_by[x[1][x[2] - 1]]]) for x in mine]
    return sorted(out)


def test_audit_equals_plain_statement(spark):
    rng = random.Random(5)
    docs = []
    for i in range(260):
        text = " ".join((rng.choice("abXYZ") + str(rng.randrange(rng.choice([20, 900])))) for _ in range(rng.choice([3, 49, 50, 51, 120])))
        text += rng.choice(["", "", " #", " A&B"])
        docs.append((i, text, rng.choice(["a", "b", None, ""])))
    docs += [(300 + i, docs[3][1], "a") for i in range(80)] + [(3, docs[3][1], "a")] * 2 + [(None, docs[3][1], "b")] * 3
    docs += [(500, None, "c"), (501, "", "c"), (499, "  ", "c"), (502, "A" * 100_000, "d"), (503, "é É " * 30, "d")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 380, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (9999, 1, 1), (4, None, None)]
    df = frame(spark, [(d, t, "en", s, 1) for d, t, s in docs], clash=True)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = R.audit(df, marks)
    assert got.columns == ["part", "filter_order", "step", *R.COUNTS]
    assert sorted(tuple(r) for r in got.collect()) == plain_audit(docs, labels)
    assert R.audit(df.limit(0), marks).count() == 0
    assert R.audit(df, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_min_plus_product_is_the_first_failing_step():
    for m in range(32):
        for o, order in enumerate(R.ORDERS):
            steps = [order.index(f) + 1 for i, f in enumerate(R.FILTERS) if m >> i & 1]
            assert R.RANK[m, o] == min(steps, default=R.RANK[0, o]) and (steps or R.RANK[m, o] > 5)
