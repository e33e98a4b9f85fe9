import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strandlake.llm import dp_packing as P, tokens
from tests.llm.brute import cheapest_packing

SCHEMA = "doc_id long, text string, sequence_id long"
ODD_TEXTS = ["", " ", "  a  b ", "a\n b", "a \n b", "x<|endoftext|>y <|endoftext|> z", "don't  stop 's", "a  b", "été ciónñ, ¿qué?\n\nsí",
             "tab\tx \t y", "a\x0b b", "1 22  333", "trailing ", " leading", "\n", "a" * 5000, "é x", "𝛼 β", "one.\nTwo\nthree\n\nfour", "a\nb\nc d", "x\x01y z", "end\n", "\nhead", "a\u00a0\nb", "a\n\u00a0\nb c"]


def test_words_give_the_ids_of_whole_texts():
    path = tokens.default_tokenizer()
    t = Tokenizer.from_file(path)
    rng = random.Random(3)
    alphabet = ["a", "b", " ", " ", "\n", "'s", ".", "é", "9", " ", "the", "<|endoftext|>", "\t"]
    texts = ODD_TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(2000)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    for cache in (0, 5, 10000):
        enc = tokens.WordEncoder(path, cache)
        for lo in range(0, len(texts), 700):
            ids, counts = enc.encode(pa.array(texts[lo:lo + 700]))
            got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
            assert got == want[lo:lo + 700]
            assert enc.count(pa.array(texts[lo:lo + 700])).tolist() == [len(x) for x in want[lo:lo + 700]]


@pytest.mark.parametrize("seed", range(12))
def test_plan_is_the_cheapest(seed):
    rng = random.Random(seed)
    context = 16
    cuts = np.cumsum([rng.choice([1, 2, 3, 5, 8, 13, 16]) for _ in range(60)]).tolist()
    cost = [rng.choice([0.0, 1.0, 4.0]) for _ in cuts]
    cost[-1] = 0.0
    ends = P.plan_windows(cuts, cost, context, 3.0, 3)
    tail = lambda n: P.tail_cost(n, context, 3.0)
    at, total = 0, 0.0
    for e in ends:
        length = cuts[e] - at
        k = -(-length // context)
        c = k * context - length + (k - 1) * 3.0 + cost[e]
        total += min(c, tail(length)) if e == len(cuts) - 1 and k == 1 else c
        at = cuts[e]
    assert at == cuts[-1]
    assert total == cheapest_packing(cuts, cost, context, 3.0, 3, tail)


def test_pieces_rebuild_all_documents(spark):
    texts = ["One. Two words! Three?\nFour" * k for k in (1, 7, 60, 400)] + [None, "", "no end " * 3000, "One. Two words! Three?\nFour"]
    rows = [(i if i != 2 else None, x, 1) for i, x in enumerate(texts)] + [(0, texts[0], 1)]
    got = P.pack(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    t = Tokenizer.from_file(tokens.default_tokenizer())
    docs, seqs = {}, {}
    for r in sorted(got, key=lambda r: r.start):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        assert r.start % r.doc_tokens == len(docs.setdefault(r.doc_id, [])) % r.doc_tokens or r.doc_id == 0
        docs[r.doc_id] += ids
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    want = {i: [*t.encode(x or "", add_special_tokens=False).ids, 0] for i, x, _ in rows}
    want[0] *= 2  # the repeated row
    assert docs == want
    for pieces in seqs.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= P.CONTEXT
    short = sum(P.padding(sum(n for _, n in x)) for x in seqs.values())
    assert short < 0.02 * sum(map(len, want.values()))
    assert any(r.doc_id is None for r in got)


def test_empty_table(spark):
    assert P.pack(spark.createDataFrame([], SCHEMA)).collect() == []
