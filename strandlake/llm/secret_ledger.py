"""Secret scans over a ledger of blobs: every distinct text is scanned once per rule version, findings go to all its rows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandlake.llm import ledger
from strandlake.llm.batches import by_bytes, one, strings

SPANS = "array<struct<kind:string,start:int,end:int>>"
SCHEMA = f"digest binary, version string, spans {SPANS}"
BASE_KINDS = ("assign", "access", "hex")
#: A key from its BEGIN line to the END line before any other BEGIN; without one, to the end of its headers and base64.
_KEY = (r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?s:(?:(?!-----BEGIN ).)*?)-----END [A-Z ]*PRIVATE KEY-----"
        r"|(?:\s*(?:Proc-Type|DEK-Info|Comment|Version):[^\n]*)*"
        r"(?:\s*\n[^\S\n]*[A-Za-z0-9+/=]+[^\S\n]*(?=\n|\Z)|(?:\s|\\[rn]|[\"'>#|,;])*[A-Za-z0-9+/=]{16,})*)")
#: Kind, pattern, group whose length counts, least length, a string any match contains (or None).
RULES = (
    ("assign", r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, None),
    ("access", r"AKIA[A-Z0-9]+", 0, 16, "AKIA"),
    ("hex", r"[0-9a-f]{32,}", 0, 32, None),  # a run of 32 or more is matched whole, shorter runs never
    ("private_key", _KEY, 0, 0, "-----BEGIN "),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0, "gh"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0, "xox"),
)
RULE_VERSION = hashlib.sha256(repr(RULES).encode()).hexdigest()
MASK = "[SECRET]"


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the rule) of all spans in code points, by start and then rule."""
    out = []
    for k, (_, _, group, least, part) in enumerate(RULES):
        if part is not None and part not in text or k == 0 and ":" not in text and "=" not in text:
            continue
        for m in _COMPILED[k].finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), m.end(), k))
    return sorted(out, key=lambda x: (x[0], x[2]))


_COMPILED = [re.compile(r[1]) for r in RULES]


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for t in by_bytes(batches):
        spans = [[{"kind": RULES[k][0], "start": a, "end": b} for a, b, k in find_secrets(x)]
                 for x in strings(t.column("text")).to_pylist()]
        yield pa.RecordBatch.from_arrays([one(t.column("digest")), pa.array([RULE_VERSION] * len(spans), pa.string()),
                                          pa.array(spans, item)], names=["digest", "version", "spans"])


def scan(docs: DataFrame, ledger_path: str) -> DataFrame:
    """(doc_id, digest, spans) for every row of ``docs``, after scanning the blobs this rule version has not seen.

    A null text is an empty blob without spans. Null doc_ids and repeated rows keep their rows and get the findings of
    their text. Other columns are not read. An empty table gives no rows.
    """
    found = ledger.extend(docs, ledger_path, SCHEMA, RULE_VERSION, scan_batches)
    paths = docs.select(docs["doc_id"].cast("long").alias("doc_id"), ledger.digest(docs["text"]).alias("digest"))
    return paths.join(found.select("digest", "spans"), "digest").select("doc_id", "digest", "spans")


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kinds(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def masked(text: str, spans: list[dict]) -> str:
    """The text with every span, or run of overlapping spans, replaced by the mask."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at:s["start"]], MASK]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def redact(docs: DataFrame, ledger_path: str) -> DataFrame:
    """``docs`` with all secrets in ``text`` masked, and ``n_chars``, where there is such a column, set anew; no row is lost.

    Only texts with findings are handed to Python. A null text stays null, an empty one empty; repeated rows all get the mask. Other
    columns stay, whatever their names. An empty table gives no rows.
    """
    found = ledger.extend(docs, ledger_path, SCHEMA, RULE_VERSION, scan_batches).filter(F.size("spans") > 0)
    hide = F.udf(lambda text, spans: None if text is None else masked(text, spans), "string", useArrow=True)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), ledger.digest(docs["text"]).alias("digest"))
    joined = rows.join(found.select("digest", "spans"), "digest", "left")
    dirty = F.col("spans").isNotNull()
    text = F.coalesce(hide(F.when(dirty, F.col("row")["text"]), F.col("spans")), F.col("row")["text"])
    done = joined.select("row", dirty.alias("dirty"), text.alias("text"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        n = F.when(F.col("dirty"), F.length("text")).otherwise(F.col("row")["n_chars"])
        new["n_chars"] = n.cast(docs.schema["n_chars"].dataType)
    return done.select(*(new.get(c, F.col("row")[c]).alias(c) for c in docs.columns))
