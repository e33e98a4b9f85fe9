"""Token counts through a digest cache: stored counts are joined by content and tokenizer digests, only misses encoded."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandlake.llm import ledger
from strandlake.llm.batches import by_bytes, one, strings
from strandlake.llm.tokens import default_tokenizer, encoder

SCHEMA = "digest binary, version string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """The SHA-256 of the tokenizer's file: another vocabulary or rule is another version."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def count_tokens(docs: DataFrame, cache_path: str, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs``.

    Content is normalised as the tokenizer does it, which for byte-level BPE means not at all: two texts share a count
    only if their bytes are equal. A null text is an empty one (no bytes, no tokens). Null doc_ids and repeated rows keep
    their rows. Other columns are not read. An empty table gives no rows and leaves the cache as it is.
    """
    path = tokenizer_path or default_tokenizer()
    version = tokenizer_version(path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for t in by_bytes(batches):
            n = enc.count(strings(t.column("text")))
            yield pa.RecordBatch.from_arrays([one(t.column("digest")), pa.array([version] * len(n), pa.string()), pa.array(n)],
                                             names=["digest", "version", "n_tokens"])

    counts = ledger.extend(docs, cache_path, SCHEMA, version, work)
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), ledger.digest(docs["text"]).alias("digest"),
                        F.coalesce(F.octet_length(docs["text"].cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    return keyed.join(counts.select("digest", "n_tokens"), "digest").select("doc_id", "n_bytes", "n_tokens")
