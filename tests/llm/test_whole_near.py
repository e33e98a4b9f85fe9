import random

import numpy as np

from strandlake.llm import order_minhash as N


def test_linked_short_texts_share_an_entry():
    rng = random.Random(3)
    factors, linked, apart = N.hash_factors(N.SKETCHES), 0, 0
    for n in range(1, 21):
        for kind in range(40):
            words = [rng.randrange(1 << 60) if kind % 4 else rng.choice([5, 5, 5, 7]) for _ in range(n)]
            for _ in range(12):
                other = [*words]
                for _ in range(rng.randrange(1, 4)):
                    at = rng.choice([0, len(other), rng.randrange(len(other) + 1)])
                    if rng.random() < 0.5 and len(other) > 1:
                        other.pop(min(at, len(other) - 1))
                    else:
                        other.insert(at, rng.choice([5, rng.randrange(1 << 60)]))
                a, b = (N.kmers(np.array(x, np.uint64)) for x in (words, other))
                if N.similarity(a, b) >= N.SIMILARITY:
                    linked += 1
                    apart += not set(N.entries_of(a, factors).tolist()) & set(N.entries_of(b, factors).tolist())
    assert linked > 1000 and apart == 0


def test_eight_words_and_one_more(spark):
    words = [f"w{i}" for i in range(8)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "x"])), (3, " ".join(["y", *words])), (4, "nothing of these eight words is in it")]
    got = N.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == {1: 1, 2: 1, 3: 1, 4: 4}
