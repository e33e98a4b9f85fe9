"""Shards of near-equal bytes by sampled splitters, with DataFrame functions only.

Keys (doc_id, checksum of the text, tie) are sampled with chances in proportion to size, quantiles of the sample cut the
key space into ranges of about equal bytes, and ranges that came out overfull are cut again by a sample of their own.
Sizes are then summed within ranges and over ranges, and a row belongs to the shard in which the middle of its bytes lies,
so a shard's bytes differ from the mean by less than the largest row, whatever was sampled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from strandlake.session import materialize

SHARDS, LEAST_RANGES, MOST_RANGES, RANGE_ROWS, SAMPLES_A_RANGE, OVERFULL, CUTS = 16, 256, 4096, 1 << 20, 32, 2.0, 3
Key = tuple[int | None, int, int]


def _literal(key: Key) -> Column:
    return F.struct(F.lit(key[0]).cast("long").alias("doc_id"), F.lit(key[1]).cast("long").alias("text_crc32"), F.lit(key[2]).cast("long").alias("tie"))


def _array(keys: list[Key]) -> Column:
    return F.array(*map(_literal, keys)) if keys else F.filter(F.array(_literal((None, 0, 0))), lambda _: F.lit(False))


def _passed(bounds: Column, key: Column) -> Column:
    """How many of the bounds are at or below the key."""
    return F.size(F.filter(bounds, lambda b: b <= key))


def range_number(key: Column, bounds: list[Key]) -> Column:
    """The number of the range a key is in, in two steps over about the square root of the bounds each."""
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i:i + step] for i in range(0, len(bounds), step)] or [[]]
    first = _passed(_array([g[0] for g in groups if g]), key)
    inner = F.array(_array([]), *(_array(g[1:]) for g in groups))
    return F.when(first == 0, F.lit(0)).otherwise((first - 1) * step + 1 + _passed(F.element_at(inner, first + 1), key)).cast("long")


def splitters(rows: DataFrame, parts: dict[int, int], size: dict[int, int], turn: int) -> dict[int, list[Key]]:
    """For each group in ``parts`` the bounds that cut it into so many ranges of about equal bytes.

    Rows enter the sample with a chance in proportion to their size; one too large for that counts as several. The sample
    has about ``SAMPLES_A_RANGE`` rows a range, and one window orders it.
    """
    per_byte = {g: SAMPLES_A_RANGE * n / max(1, size[g]) for g, n in parts.items()}
    table = F.create_map(*(F.lit(x) for g, p in per_byte.items() for x in (g, p)))
    wanted = F.col("size") * table[F.col("part")]
    chance = F.pmod(F.xxhash64("tie", "doc_id", F.lit(turn)), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.filter(F.col("part").isin(*parts)).filter(chance < wanted).withColumn("weight", F.greatest(wanted, F.lit(1.0)))
    order = W.partitionBy("part").orderBy("key")
    upto = F.sum("weight").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    all_of = F.sum("weight").over(W.partitionBy("part"))
    count = F.create_map(*(F.lit(x) for g, n in parts.items() for x in (g, n)))[F.col("part")]
    cell = F.floor((upto - F.col("weight")) * count / all_of)
    chosen = drawn.withColumn("cell", cell).filter("cell > 0").groupBy("part", "cell").agg(F.min("key").alias("key"))
    out: dict[int, list[Key]] = {g: [] for g in parts}
    for r in chosen.orderBy("part", "key").select("part", "key.*").collect():
        out[r.part].append((r.doc_id, r.text_crc32, r.tie))
    return out


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; slot counts a shard's rows from 0 in the order of their keys.

    size is the UTF-8 bytes of the text plus 1, so null and empty texts have size 1 and checksum 0. Null doc_ids come
    first. Rows that repeat a doc_id are ordered by checksum, and rows equal in both by a hash of their place, so that no
    key is too frequent to be cut. Other columns are not read. An empty table gives no rows.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    sizes = materialize(docs.select(docs["doc_id"].cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                                    F.crc32(text.cast("binary")).alias("text_crc32"),
                                    F.xxhash64(F.monotonically_increasing_id()).alias("tie")), "sizes")
    rows = sizes.withColumn("key", F.struct("doc_id", "text_crc32", "tie")).withColumn("part", F.lit(0).cast("long"))
    whole = sizes.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    ranges = min(MOST_RANGES, max(LEAST_RANGES, whole.n // RANGE_ROWS))
    bounds = splitters(rows, {0: ranges}, {0: whole.size}, 0)[0]
    for turn in range(1, CUTS):
        held = rows.withColumn("part", range_number(F.col("key"), bounds))
        full = held.groupBy("part").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).filter(
            (F.col("size") > OVERFULL * whole.size / ranges) & (F.col("n") > 1)).collect()
        if not full:
            break
        parts = {r.part: math.ceil(r.size * ranges / whole.size) for r in full}
        more = splitters(held, parts, {r.part: r.size for r in full}, turn)
        bounds = sorted({*bounds, *(k for x in more.values() for k in x)}, key=lambda k: (k[0] is not None, k[0] or 0, k[1], k[2]))
    held = rows.withColumn("part", range_number(F.col("key"), bounds))
    before = W.partitionBy("part").orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow)
    inside = held.withColumn("to", F.sum("size").over(before)).withColumn("rank", F.row_number().over(W.partitionBy("part").orderBy("key")))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    sums = held.groupBy("part").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).select(
        "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("rows_before"))
    middle = 2 * (F.col("bytes_before") + F.col("to")) - F.col("size")  # twice the place of the row's middle byte
    placed = materialize(inside.join(sums, "part").select(
        "doc_id", "size", "text_crc32", F.floor(middle * shards / (2 * whole.size)).cast("int").alias("shard"),
        (F.col("rows_before") + F.col("rank") - 1).alias("place")), "placed")
    first = placed.groupBy("shard").agg(F.min("place").alias("first"))
    return placed.join(first, "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))
