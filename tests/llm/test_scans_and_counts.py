import re
import zlib

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandlake.llm import ledger, line_cleaning as L, secret_ledger as S, tokens
from strandlake.llm.token_cache import SCHEMA as COUNTS, count_tokens, tokenizer_version

DOCS = "doc_id long, text string, digest string, spans int, n_chars int"
TEXTS = [None, "", "plain", "password = abc12345 and token:'zzzzzzzz9'", "secret=short", "Secret: token=abcdefgh1", "password = secret = abcdefghijk",
         "AKIAABCDEFGHIJKL", "AKIASHORT", "x" + "0123456789abcdef" * 2 + "y", "é𝛼 api_key=ABCDEFGH/", "pa\u017f\u017fword=abcdefghij to\u212aen=abcdefghij",
         "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "word " * 20000 + "PASSWD:=x token=12345678", "apikey:0123456789abcdef0123456789abcdef"]


def brute_spans(text):
    """Of the base kinds: every match of the plain pattern is consumed, and dropped if it is too short."""
    text = text or ""
    patterns = [("assign", re.compile(r"(?:%s)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)" % "|".join(
        "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_key", "apikey"))), 1, 8),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32)]
    out = []
    for k, (kind, p, group, least) in enumerate(patterns):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in p.finditer(text) if len(m.group(group)) >= least]
    return ",".join(x[2] for x in sorted(out))


def table(spark, texts):
    return spark.createDataFrame([(i, x, "d", 1, 2) for i, x in enumerate(texts)] + [(None, texts[3], "d", 1, 2)], DOCS)


def test_secrets_equal_brute_force(spark, tmp_path):
    docs = table(spark, TEXTS)
    got = S.scan(docs, f"{tmp_path}/ledger").select("doc_id", S.span_text(S.of_kinds(F.col("spans"), *S.BASE_KINDS)).alias("base"),
                                                    S.span_text(F.col("spans")).alias("all")).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert r.base == brute_spans(TEXTS[3 if r.doc_id is None else r.doc_id])
        assert set(r.base.split(",")) - {""} <= set(r.all.split(","))


def test_only_unseen_blobs_and_versions_are_scanned(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/ledger"
    S.scan(table(spark, TEXTS[:6]), path)
    again = table(spark, TEXTS)
    known = ledger.entries(spark, path, S.SCHEMA, S.RULE_VERSION)
    assert ledger.unseen(again, known).count() == len(TEXTS) - 6
    S.scan(again, path)
    assert spark.read.parquet(path).count() == len(TEXTS) - 1  # null and empty are one blob
    assert ledger.unseen(again, ledger.entries(spark, path, S.SCHEMA, "another")).count() == len(TEXTS) - 1


def test_redaction_masks_all_spans_and_keeps_rows(spark, tmp_path):
    docs = table(spark, TEXTS)
    out = S.redact(docs, f"{tmp_path}/ledger")
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert len(rows) == len(TEXTS) + 1 and rows[0].text is None and rows[2].text == "plain" and rows[2].n_chars == 2
    assert rows[3].text == f"{S.MASK} and {S.MASK}'" and rows[3].n_chars == len(rows[3].text)
    assert all(not S.find_secrets(r.text or "") for r in rows.values())


def test_counts_equal_the_library_and_come_from_the_cache(spark, tmp_path):
    path, file = f"{tmp_path}/cache", tokens.default_tokenizer()
    t = Tokenizer.from_file(file)
    docs = table(spark, TEXTS)
    got = {r.doc_id: r for r in count_tokens(docs, path).collect()}
    for i, x in enumerate(TEXTS):
        assert (got[i].n_bytes, got[i].n_tokens) == (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids))
    stored = spark.read.parquet(path)
    assert stored.count() == len(TEXTS) - 1
    count_tokens(docs, path)
    assert spark.read.parquet(path).count() == len(TEXTS) - 1
    fixed = f"{tmp_path}/fixed"  # what the cache holds is what is returned
    stored.withColumn("n_tokens", F.lit(7).cast("long")).write.parquet(fixed)
    assert {r.n_tokens for r in count_tokens(docs, fixed).collect()} == {7}
    assert COUNTS.split()[0] == "digest" and len(tokenizer_version(file)) == 64


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], DOCS)
    assert S.scan(none, f"{tmp_path}/a").collect() == [] and S.redact(none, f"{tmp_path}/b").collect() == []
    assert count_tokens(none, f"{tmp_path}/c").collect() == [] and L.assess(none).collect() == []


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    again = {i + k for i, r in enumerate(runs) if runs.count(r) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(again))


PAGES = ["", "one two three one two three one", "a\x0bb\x0cc\u00a0d \u2003e", "# head\nSame line.\nSame line.\n \n \nlast $%&|<>", "w " * 400,
         "Home | About | News | Login\n" + "A true sentence with enough words in it, once. " * 1 + "\n" + " ".join(f"word{i}" for i in range(80)) + ".",
         " ".join(f"é{i}" for i in range(60)) + ".\nAll rights reserved.", "LOUD WORDS EVERYWHERE IN THIS LINE\n" * 2 + " ".join(f"x{i}" for i in range(60)),
         " ".join(f"k{i}" for i in range(12)) + ".\n" + "| ".join(f"nav{i}" for i in range(60))]


def test_line_measures_equal_brute_force(spark):
    docs = spark.createDataFrame([(i, x, "d", 1, 2) for i, x in enumerate(PAGES)] + [(None, None, "d", 1, 2)], DOCS)
    got = {r.doc_id: r for r in L.assess(docs, with_text=True).collect()}
    assert len(got) == len(PAGES) + 1 and got[None].n_words == 0 and got[None].base_failed and not got[None].kept
    for i, x in enumerate(PAGES):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(x), i
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.lost <= 0.5)
    assert got[5].kept and "Home" not in got[5].clean_text and got[5].clean_text.startswith("A true")
    assert got[6].kept and "reserved" not in got[6].clean_text
    assert not got[8].base_failed and not got[8].kept


@pytest.mark.parametrize("line, fault", [
    ("Contact us", "punctuation"), ("He said so.", None), ("a | b | c | d | e f g", "symbols"), ("Home » News » Sport » Local » Weather and more text", "navigation"),
    ("Released under the MIT License, as is.", "boilerplate"), ("THIS IS ALL IN CAPITALS AND LONG", "capitals"), ("a plain line without an end", None)])
def test_line_rules(line, fault):
    if fault == "navigation":
        line = line.replace("»", "|", 1)
    assert L.line_fault(line) == fault


def test_checksum_is_that_of_utf8(spark):
    got = spark.createDataFrame([("é",)], "t string").select(F.crc32(F.col("t").cast("binary"))).first()[0]
    assert got == zlib.crc32("é".encode())
