import base64
import random

import pytest

from strandlake.llm import secret_ledger as S

BODY = base64.b64encode(random.Random(1).randbytes(610)).decode()
LINES = [BODY[i:i + 64] for i in range(0, len(BODY), 64)]
BEGIN, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
HEADERS = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0A1B", ""]


def hidden(text):
    out = S.masked(text, [{"start": a, "end": b} for a, b, _ in S.find_secrets(text)])
    assert not any(x in out for x in [*LINES, LINES[-1][-12:], "PRIVATE KEY", "DEK-Info"]), out
    return out


@pytest.mark.parametrize("key", [
    "\n".join([BEGIN, *LINES, END]), "\r\n".join([BEGIN, *LINES, END]), "\n".join([BEGIN, *HEADERS, *LINES, END]),
    "\\n".join([BEGIN, *LINES, END]), " ".join([BEGIN, *LINES, END]), "\n    ".join([BEGIN, *LINES, END]),
    "\n> ".join([BEGIN, *LINES, END])])
def test_no_line_of_a_key_is_left(key):
    assert hidden(f"Some text before.\n{key}\nSome text after it.") == f"Some text before.\n{S.MASK}\nSome text after it."
    assert hidden(f"{key}\nbetween them\n{key}") == f"{S.MASK}\nbetween them\n{S.MASK}"


@pytest.mark.parametrize("join", ["\n", "\r\n", "\n\n", "\n  ", "\\n", " "])
def test_a_key_without_its_end_goes_to_the_last_base64_line(join):
    key = join.join([BEGIN, *LINES])
    assert "Some text after it." in hidden(f"Some text before.\n{key}\nSome text after it.")
    assert "Some text between." in hidden(f"{key}\nSome text between.\n{BEGIN}\n{BODY}\n{END}")


def test_redact_leaves_no_key(spark, tmp_path):
    text = "\n".join(["before", BEGIN, *LINES, END, "after"])
    docs = spark.createDataFrame([(1, text, 2), (2, "\n".join([BEGIN, *LINES]), 2)], "doc_id long, text string, n_chars int")
    assert sorted(r.text for r in S.redact(docs, f"{tmp_path}/ledger").collect()) == sorted([f"before\n{S.MASK}\nafter", S.MASK])


def test_redact_takes_any_columns(spark, tmp_path):
    text = "a password=abcd1234efgh b"
    names = ["_blob", "_blob_spans", "digest", "spans", "row", "dirty", "version"]
    docs = spark.createDataFrame([(1, text, *names), (None, None, *names), (2, "", *names), (1, text, *names)],
                                 "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    out = S.redact(docs, f"{tmp_path}/clash")
    assert out.columns == docs.columns and out.count() == 4
    rows = out.collect()
    assert sorted(r.text is None for r in rows) == [False] * 3 + [True] and sum(S.MASK in (r.text or "") for r in rows) == 2
    assert all("abcd1234" not in (r.text or "") and [r[c] for c in names] == names for r in rows)
