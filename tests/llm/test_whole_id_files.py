import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from strandlake.llm import mixing_coder as M, tokens


def test_one_document_with_every_id():
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.permutation(50257), np.arange(50257), rng.integers(0, 1 << 32, 70000)]).astype(np.uint32)
    block, = M.encode_block(x, [None], np.array([len(x)]))
    got, docs, n = M.decode_block(block)
    assert np.array_equal(got, x) and docs == [None] and n.tolist() == [len(x)] == [M.block_size(block)]
    for at in (1, 6, 25, M.HEADER.size + 2, M.HEADER.size + 26, len(block) // 2, len(block) - 3):
        with pytest.raises(ValueError):
            M.decode_block(block[:at] + bytes([block[at] ^ 1]) + block[at + 1:])


def test_files_hold_a_document_with_most_of_the_vocabulary(spark, tmp_path):
    t = Tokenizer.from_file(tokens.default_tokenizer())
    text = "\n".join(t.decode([i]) for i in range(t.get_vocab_size()))
    ids = t.encode(text, add_special_tokens=False).ids
    assert len(set(ids)) > M.MOST_SYMBOLS
    docs = spark.createDataFrame([(1, "one"), (2, text), (3, "three")], "doc_id long, text string").coalesce(1)
    M.write_ids(docs, f"{tmp_path}/ids")
    got = sorted(M.read_ids(spark, f"{tmp_path}/ids").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [1, 2, 3]
    assert np.frombuffer(got[1].ids, "<u4").tolist() == [*ids, 0]
    assert zlib.crc32(got[1].ids) == zlib.crc32(np.array([*ids, 0], "<u4").tobytes()) and got[2].start == got[1].start + len(ids) + 1
