"""Line-first cleaning: rules judge every line, failing lines go, and a document that loses too much text goes as well."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from strandlake.llm.batches import by_bytes, one, split_words, strings

LEAST_WORDS, MOST_REPEATED, MOST_LOST = 50, 50, 0.5
SHORT_LINE, SYMBOL_SHARE, UPPER_SHARE = 5, 0.1, 0.7
_WHITE = " \t\n\x0b\x0c\r"
#: What may end a sentence, and phrases of pages around a text.
_CLOSING = tuple(".!?:;…\"'”’»)]")
_NAVIGATION = re.compile(r"(?:[^|»>]{1,40}[|»>]\s*){3,}")
_BOILERPLATE = re.compile(
    r"(?i)all rights reserved|released under the|licen[sc]ed under|\(c\) \d{4}|©|terms of (?:use|service)|privacy policy|cookie (?:policy|settings)"
    r"|accept cookies|enable javascript|subscribe to our|sign up for|click here|lorem ipsum|share on (?:facebook|twitter)")


def line_fault(line: str) -> str | None:
    """The first rule a line with a word fails, if any."""
    words = line.split()
    if len(words) < SHORT_LINE and not line.rstrip(_WHITE).endswith(_CLOSING):
        return "punctuation"
    marks = sum(map(line.count, "#*$%&|<>"))
    if marks > SYMBOL_SHARE * len(line):
        return "symbols"
    if any(m in line for m in "|»>") and _NAVIGATION.search(line):
        return "navigation"
    if _BOILERPLATE.search(line):
        return "boilerplate"
    letters = sum(map(str.isalpha, line))
    if letters >= 20 and sum(map(str.isupper, line)) > UPPER_SHARE * letters:
        return "capitals"
    return None


def clean(text: str) -> tuple[str, int, float]:
    """The text without failing lines, the number of lines equal to an earlier one, and the share of its characters lost.

    A line equal to an earlier one fails too. Lines without a word stay and count as no text.
    """
    kept, seen, repeated, lost, total = [], set(), 0, 0, 0
    for line in text.split("\n"):
        if not line.strip(_WHITE):
            kept.append(line)
            continue
        total += len(line)
        again = line in seen
        seen.add(line)
        repeated += again
        if again or line_fault(line):
            lost += len(line)
        else:
            kept.append(line)
    return "\n".join(kept), repeated, lost / total if total else 0.0


def repeated_words(codes: np.ndarray) -> int:
    """Words within runs of three words that come twice or more."""
    n = len(codes) - 2
    if n < 2:
        return 0
    _, c = np.unique(codes, return_inverse=True)
    c = c.astype(np.int64)
    v = int(c.max()) + 1
    pair = c[:-1] * v + c[1:]
    if v > 1 << 20:  # keeps the product below in 64 bits
        _, pair = np.unique(pair, return_inverse=True)
    _, inverse, counts = np.unique(pair[:n] * v + c[2:], return_inverse=True, return_counts=True)
    again = counts[inverse] > 1
    cover = np.zeros(n + 2, bool)
    for i in range(3):
        cover[i:i + n] |= again
    return int(cover.sum())


def assess(docs: DataFrame, most_lost: float = MOST_LOST, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost, base_failed, kept[, clean_text]) of every row.

    A null text is an empty one: no words, so it fails the base rules. Null doc_ids and repeated rows keep their rows. Other
    columns are not read. An empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_bytes(batches):
            texts = strings(t.column("text"))
            codes, names, offsets = split_words(texts)
            chars = np.concatenate([[0], np.cumsum(pc.utf8_length(pa.array(names, pa.string())).to_numpy(zero_copy_only=False)[codes], dtype=np.int64)])
            cleaned = [clean(x) for x in texts.to_pylist()]
            columns = [one(t.column("doc_id")), pa.array(np.diff(offsets).astype(np.int64)), pa.array(chars[offsets[1:]] - chars[offsets[:-1]]),
                       pc.cast(pc.count_substring_regex(texts, "[#*$%&|<>]"), pa.int64()), pa.array([c[1] for c in cleaned], pa.int64()),
                       pa.array([repeated_words(codes[a:b]) for a, b in zip(offsets, offsets[1:])], pa.int64()),
                       pa.array([c[2] for c in cleaned], pa.float64())]
            fields = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost"]
            if with_text:
                columns.append(pa.array([c[0] for c in cleaned], pa.string()))
                fields.append("clean_text")
            yield pa.RecordBatch.from_arrays(columns, names=fields)

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, lost double"
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(
        run, schema + ", clean_text string" * with_text)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("lost") <= most_lost))
