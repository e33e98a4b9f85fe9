import itertools
import math
import random

from strandlake.llm import spaced_seeds as S

DOCS = "doc_id long, text string"


def holds_a_hit(bits):
    return any(all(bits[x + k] for k, b in enumerate(m) if b == "1") for m in S.MASKS for x in range(len(bits) - len(m) + 1))


def test_every_overlap_that_counts_holds_a_hit():
    """Longer overlaps hold a stretch of 13 to 25 words with as large a share, so those (with any ends) stand for them."""
    for need, most, any_ends in [(min(13, math.ceil(0.8 * n - 1e-9)), n, False) for n in range(9, 17)] + [(13, 25, True)]:
        for length in range(need, most + 1):
            places = range(length) if any_ends else range(1, length - 1)
            for gone in itertools.combinations(places, length - math.ceil(0.8 * length - 1e-9)):
                assert holds_a_hit([i not in gone for i in range(length)])


def test_changed_copies_of_items_of_nine_words_and_more_are_found(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(4000)]
    items = [(n, rng.sample(vocabulary, n)) for n in (9, 10, 13, 15, 200)]
    docs, want = [], {}
    for n, item in items[:4]:
        for gone in itertools.combinations(range(1, n - 1), n - math.ceil(0.8 * n - 1e-9)):
            want[len(docs)] = n, n
            docs.append((len(docs), " ".join("changed" if k in gone else w for k, w in enumerate(item))))
    for part in (items[0][1][1:], items[0][1][:-1], items[1][1][2:], items[1][1][:8]):  # 8 words with others around them
        want[len(docs)] = (9 if part[0] in items[0][1] else 10), 8
        docs.append((len(docs), " ".join(["x", *part, "y"])))
    want[len(docs)] = 200, 200  # the whole diagonal
    docs.append((len(docs), " ".join(["x", *items[4][1], "y"])))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.length) for r in S.leaks(spark.createDataFrame(docs, DOCS), bench).collect()}
    assert got == want


def test_items_of_less_than_nine_words_with_a_word_changed_are_found(spark):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(4000)]
    items = [(n, rng.sample(vocabulary, n)) for n in range(1, 9)]
    docs, want = [], {}
    for n, item in items:
        for gone in range(n):
            need = math.ceil(0.8 * n - 1e-9)
            cut = item[1:] if gone == 0 else item[:-1] if gone == n - 1 else None  # the first or last word changed: a shorter overlap
            if cut is not None and len(cut) >= need and cut:
                want[len(docs)] = n, len(cut)
            if cut is None and n - 1 >= math.ceil(0.8 * n - 1e-9):
                want[len(docs)] = n, n
            docs.append((len(docs), " ".join(["x", *("changed" if k == gone else w for k, w in enumerate(item)), "y"])))
        want[len(docs)] = n, n
        docs.append((len(docs), " ".join(item)))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    got = {r.doc_id: (r.item_id, r.length) for r in S.leaks(spark.createDataFrame(docs, DOCS), bench).collect()}
    assert got == want


def test_every_short_overlap_that_counts_holds_a_hit():
    for n in range(1, 9):
        masks = S.short_masks(n)
        for length in range(math.ceil(0.8 * n - 1e-9), n + 1):
            for gone in itertools.combinations(range(1, length - 1), length - math.ceil(0.8 * length - 1e-9)):
                bits = [i not in gone for i in range(length)]
                assert any(all(bits[x + k] for k, b in enumerate(m) if b == "1") for m in masks for x in range(len(bits) - len(m) + 1))


def test_items_of_very_many_words(spark):
    rng = random.Random(7)
    words = [f"w{rng.randrange(50_000)}" for _ in range(100_000)]
    docs = [(0, " ".join(words)), (1, " ".join(["x"] * 50 + words[60_000:60_020] + ["y"] * 50)), (2, " ".join(words[::2])), (3, None)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:10_000]))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.length for r in S.leaks(spark.createDataFrame(docs, DOCS), bench).collect()}
    assert got == {(0, 1): 100_000, (0, 2): 10_000, (1, 1): 20}
