import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import AddedToken, Tokenizer

from strandlake.llm import mixing_coder as M, tokens


def counted(library, seen):
    def encode(texts, **how):
        seen.extend(texts)
        return library.encode_batch_fast(texts, **how)

    return SimpleNamespace(encode_batch_fast=encode)


def test_plain_words_skip_the_cut_into_pieces():
    enc, whole, pieces = tokens.WordEncoder(tokens.default_tokenizer()), [], []
    enc.tokenizer = counted(enc.tokenizer, whole)
    enc.pieces = counted(enc.pieces, pieces)
    texts = pa.array(["head word, another été! word,", "head word 12 x9 word"])
    first = enc.encode(texts)
    assert sorted(whole) == [" 12 x9", "head", "head"]
    assert pieces == ["\x02Ġword\x02,\x02Ġanother\x02ĠÃ©tÃ©\x02!\x02Ġword"]
    again = enc.encode(texts)
    assert len(pieces) == 1 and sorted(whole) == [" 12 x9", "head", "head", "head", "head"]
    assert all(np.array_equal(a, b) for a, b in zip(first, again))


def test_signs_letters_and_marks_give_the_ids_of_whole_texts():
    t = Tokenizer.from_file(tokens.default_tokenizer())
    rng = random.Random(11)
    parts = [chr(c) for c in range(1, 0x250)] + ["'s", "'ll", "don't", "ing", "Über", "ʰ", "Ω", "ж", "中", "́", "²", "ⅷ", "𝛼", "<|endoftext|>", "\x02", "Ġ"]
    texts = [" ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(30)) for _ in range(400)]
    texts += ["a " + " ".join(rng.choice(["word", "été", "x"]) + s for s in ("", *"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "...", "''", "<|", "|>", "'!")) for _ in range(5)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    for cache in (0, 300, 100000):
        enc = tokens.WordEncoder(tokens.default_tokenizer(), cache)
        for lo in range(0, len(texts), 150):
            ids, counts = enc.encode(pa.array(texts[lo:lo + 150]))
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want[lo:lo + 150]
            assert len(enc.known) <= cache


@pytest.mark.parametrize("content", ["word", "rd,", "#", "é"])
def test_an_added_token_inside_words_is_kept(content, tmp_path):
    t = Tokenizer.from_file(tokens.default_tokenizer())
    t.add_tokens([AddedToken(content, normalized=False)])
    t.save(f"{tmp_path}/t.json")
    text = "a word, swords, xrd, #x x# #, été é"
    ids, _ = tokens.WordEncoder(f"{tmp_path}/t.json").encode(pa.array([text]))
    assert ids.tolist() == t.encode(text, add_special_tokens=False).ids


def test_candidates_are_found_by_hash():
    rng = np.random.default_rng(12)
    symbols, lanes = 50, 400
    model, places = M.Model(symbols, lanes), M.Places(200_000, symbols)
    found = there = 0
    for _ in range(120):
        ids = np.minimum(rng.geometric(0.08, lanes), symbols - 1).astype(np.int16)
        model.look()
        first = model.last == ids
        slot = np.where(first, 0, 1)
        miss = np.flatnonzero(~first & (model.older != ids))
        ctx = model.prev1.take(miss)
        place = places.find(model, ctx, ids.take(miss))
        same = model.near1[:-1].reshape(symbols, M.NEAR1)[ctx] == ids.take(miss)[:, None]
        hit = place < M.NEAR1
        assert same[np.flatnonzero(hit), place[hit]].all()  # never a wrong one
        found, there = found + hit.sum(), there + same.any(axis=1).sum()
        slot[miss] = M.NEAR2 + place
        places.learn(ctx, *model.learn(ids, first, model.state * M.SLOTS + slot, miss, ctx, place))
        model.shift(ids.astype(np.int64))
    assert found > 0.9 * there > 0
