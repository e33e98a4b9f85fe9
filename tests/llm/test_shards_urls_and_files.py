import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from strandlake.llm import mixing_coder as M, rule_filter as R, splitter_shards as P, tokens

DOCS = "doc_id long, text string, size int, shard string, tie int"


def brute_shards(rows, shards=16):
    """Rows in the order of (doc_id, checksum), each in the shard where the middle of its bytes lies."""
    keyed = sorted(((i is not None, i or 0, zlib.crc32((t or "").encode()), i, len((t or "").encode()) + 1) for i, t in rows))
    total, before, out, slots = sum(k[4] for k in keyed), 0, [], {}
    for _, _, crc, i, size in keyed:
        s = (2 * before + size) * shards // (2 * total)
        out.append((i, size, crc, s, slots.get(s, 0)))
        slots[s] = slots.get(s, 0) + 1
        before += size
    return out


@pytest.mark.parametrize("kind", ["plain", "one key", "one text", "long", "few"])
def test_shards_equal_brute_force(spark, kind):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randrange(200)) for i in range(3000)]
    if kind == "one key":
        rows = [(7 if i % 2 else i, t) for i, t in rows]
    if kind == "one text":
        rows = [(5, "same") if i % 3 else (i, t) for i, t in rows]
    if kind == "long":
        rows[50] = (50, "y" * 2_000_000)
    if kind == "few":
        rows = [(3, "a"), (None, None), (None, ""), (1, "é")]
    got = P.shard(spark.createDataFrame([(*r, 1, "s", 2) for r in rows], DOCS)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute_shards(rows), key=str)


def test_ranges_follow_the_bounds(spark):
    from pyspark.sql import functions as F

    bounds = [(k, 0, 0) for k in range(3, 90, 7)]
    key = F.struct(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("text_crc32"), F.lit(0).cast("long").alias("tie"))
    for r in spark.range(100).select("id", P.range_number(key, bounds).alias("part")).collect():
        assert r.part == sum(b[0] <= r.id for b in bounds)


def test_no_rows(spark):
    none = spark.createDataFrame([], DOCS)
    assert P.shard(none).collect() == []


URLS = [(1, "HTTPS://News.Example.ORG/es/1"), (2, "https://example.org/en/12?x=1"), (3, "http://a.b.com/fr/"), (4, "https://x.com/de/9.html"), (5, "https://org/"),
        (6, None), (7, "no scheme"), (8, "http://a?b://c/d"), (9, "https://notexample.org"), (10, "https://example.organic/es/"), (11, "mailto://É.ORG/x#y/z"), (12, "")]
WANT = {1: ("news.example.org", "/es/1", "example.org/es/", "block"), 2: ("example.org", "/en/12", "example.org/en/1", "block"),
        3: ("a.b.com", "/fr/", "com/fr/", "allow"), 4: ("x.com", "/de/9.html", "com/de/", "block"), 5: ("org", "/", "org/", "allow"),
        6: ("", "", None, "allow"), 7: ("", "", None, "allow"), 8: ("a", "", None, "allow"), 9: ("notexample.org", "", None, "allow"),
        10: ("example.organic", "/es/", None, "allow"), 11: ("É.org", "/x", "org/", "allow"), 12: ("", "", None, "allow")}


def test_host_path_and_rule(spark):
    pages = spark.createDataFrame([(i, u, "h", "t") for i, u in URLS] + [(None, URLS[0][1], "h", "t")], "page_id long, url string, host string, tokens string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = R.judge(pages, labels).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == WANT[r.page_id or 1]
    assert R.judge(pages.limit(0), labels).collect() == []


def test_mined_rules_equal_brute_force(spark):
    from itertools import combinations

    rng = random.Random(2)
    pages, labels = [], []
    for i in range(600):
        spam = rng.random() < 0.3
        section = "promo" if spam and rng.random() < 0.9 else rng.choice(["news", "blog", "wiki"])
        end = "?ref=ad" if spam else rng.choice(["", "?ref=x", "?page=2"])
        pages.append((i, f"https://{rng.choice('abc')}.site.net/{section}/{i}{end}", "h", "t"))
        if i % 3:
            labels.append((i, int(not spam), 0))
    labels += [(1, 1, None), (None, 0, 1), (2, None, None)]
    table = spark.createDataFrame(pages, "page_id long, url string, host string, tokens string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    tokens_of = {r.url: set(r.t) for r in table.select("url", R.tokens_of(table["url"]).alias("t")).collect()}
    bad = {}
    for d, q, x in labels:
        if d is not None and (q is not None or x is not None):
            bad[d] = bad.get(d, False) or q == 0 or x == 1
    baskets = [(tokens_of[u], bad[i]) for i, u, *_ in pages if i in bad]
    share = sum(b for _, b in baskets) / len(baskets)
    rules = {}
    for items in {frozenset(c) for t, _ in baskets for n in (1, 2, 3, 4, 5, 6, 7) for c in combinations(sorted(t), n)}:
        held = [b for t, b in baskets if items <= t]
        hits = sum(held)
        if hits >= 0.02 * len(baskets) and hits / len(held) >= 0.6 and hits / len(held) / share >= 1.5:
            rules[items] = hits / len(held)
    least = {r for r in rules if not any(o < r for o in rules)}
    got = {frozenset(r.tokens): r.confidence for r in R.mine(table, marks, support=0.02).collect()}
    assert set(got) == least and all(got[r] == pytest.approx(rules[r]) for r in least)
    judged = {r.page_id: r.verdict for r in R.judge(table, marks, support=0.02).collect()}
    assert judged == {i: "block" if any(r <= tokens_of[u] for r in rules) else "allow" for i, u, *_ in pages}
    assert "block" in judged.values()


@pytest.mark.parametrize("ids", [
    [], [5], [0] * 3000, list(range(4000)), [4294967295, 0, 7] * 50, np.random.default_rng(3).zipf(1.3, 20000) % 50000,
    np.random.default_rng(4).integers(0, 1 << 32, 3000), np.tile(np.arange(700), 40)])
def test_blocks_round_trip(ids):
    x = np.array(ids, np.uint32)
    counts = np.array([len(x) - len(x) // 3, len(x) // 3])
    block, = M.encode_block(x, [9, None], counts)
    got, docs, n = M.decode_block(block)
    assert np.array_equal(got, x) and docs == [9, None] and n.tolist() == counts.tolist()


def test_predictable_ids_take_few_bits():
    x = np.tile(np.random.default_rng(5).integers(0, 5000, 3000), 30).astype(np.uint32)
    block, = M.encode_block(x, [1], np.array([len(x)]))
    assert len(block) * 8 < 6 * len(x)


def test_damage_is_noticed():
    x = np.random.default_rng(6).integers(0, 900, 5000).astype(np.uint32)
    block, = M.encode_block(x, [1], np.array([len(x)]))
    for at in (0, 5, 30, 200, len(block) // 2, len(block) - 3):
        with pytest.raises(ValueError):
            M.decode_block(block[:at] + bytes([block[at] ^ 1]) + block[at + 1:])
    with pytest.raises(ValueError):
        M.decode_block(block[:-7])


def test_too_many_different_ids_make_more_blocks():
    x = np.arange(40000, dtype=np.uint32)
    blocks = M.encode_block(x, [1, 2], np.array([20000, 20000]))
    assert [M.decode_block(b)[1] for b in blocks] == [[1], [2]]


def test_files_give_back_all_documents(spark, tmp_path):
    rng = random.Random(9)
    texts = [None, "", "one two", "long text " * 6000] + ["".join(rng.choice("ab c\n.é") for _ in range(rng.randrange(300))) for _ in range(300)]
    rows = [(i * 7 % 304, t) for i, t in enumerate(texts)] + [(None, "no id"), (14, "again")]
    M.write_ids(spark.createDataFrame([(*r, 1, "s", 2) for r in rows], DOCS), f"{tmp_path}/ids", block_ids=5000)
    got = sorted(M.read_ids(spark, f"{tmp_path}/ids").collect(), key=lambda r: r.start)
    t = Tokenizer.from_file(tokens.default_tokenizer())
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    want = sorted((str(i), [*t.encode(x or "", add_special_tokens=False).ids, 0]) for i, x in rows)
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == want
    M.write_ids(spark.createDataFrame([], DOCS), f"{tmp_path}/none")
    assert M.read_ids(spark, f"{tmp_path}/none").collect() == []
