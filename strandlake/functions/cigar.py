"""CIGAR and MD expressions (C11, C12, F1, F6, F8-F10). Arrays stay as long as one read."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from strandlake.functions.dna import col, normalize_base

WELL_FORMED = r"^([0-9]+[^0-9])*$"
REFERENCE_OPS = ("M", "D", "N", "=", "X")
QUERY_OPS = ("M", "I", "S", "=", "X")


def parse_cigar(cigar: Column | str) -> Column:
    """C11: ARRAY<STRUCT<len INT, op STRING>>, NULL when malformed, empty for ''."""
    c = col(cigar)
    parts = F.regexp_extract_all(c, F.lit("[0-9]+[^0-9]"), F.lit(0))
    ops = F.transform(
        parts,
        lambda p: F.struct(
            F.substring(p, 1, F.length(p) - 1).cast("int").alias("len"),
            F.right(p, F.lit(1)).alias("op"),
        ),
    )
    return F.when(c.rlike(WELL_FORMED), ops)


def format_cigar(ops: Column) -> Column:
    return F.array_join(F.transform(ops, lambda o: F.concat(o["len"].cast("string"), o["op"])), "")


def reverse_cigar(cigar: Column | str) -> Column:
    """Ops in reverse order; malformed text unchanged."""
    c = col(cigar)
    return F.when(c.rlike(WELL_FORMED), format_cigar(F.reverse(parse_cigar(c)))).otherwise(c)


def _sum_len(ops: Column, kinds: tuple[str, ...]) -> Column:
    kept = F.filter(ops, lambda o: o["op"].isin(*kinds))
    return F.aggregate(kept, F.lit(0), lambda acc, o: acc + o["len"])


def reference_span(cigar: Column | str, seq_len: Column | None = None) -> Column:
    """reference bases consumed; without any, the read length but at least 1."""
    span = F.coalesce(_sum_len(parse_cigar(cigar), REFERENCE_OPS), F.lit(0))
    fallback = F.greatest(F.lit(1), seq_len if seq_len is not None else F.lit(1))
    return F.when(span > 0, span).otherwise(fallback)


def placed_ops(cigar: Column | str, start: Column | str) -> Column:
    """Ops with their reference and query offsets: STRUCT<op, len, r0, q0>."""
    state = F.struct(
        col(start).cast("int").alias("r"),
        F.lit(0).alias("q"),
        F.expr("cast(array() as array<struct<op:string,len:int,r0:int,q0:int>>)").alias("out"),
    )

    def step(acc: Column, o: Column) -> Column:
        return F.struct(
            (acc["r"] + F.when(o["op"].isin(*REFERENCE_OPS), o["len"]).otherwise(0)).alias("r"),
            (acc["q"] + F.when(o["op"].isin(*QUERY_OPS), o["len"]).otherwise(0)).alias("q"),
            F.array_append(
                acc["out"],
                F.struct(o["op"].alias("op"), o["len"].alias("len"), acc["r"].alias("r0"), acc["q"].alias("q0")),
            ).alias("out"),
        )

    return F.aggregate(parse_cigar(cigar), state, step, lambda acc: acc["out"])


def md_mismatches(md: Column | str, start: Column | str) -> Column:
    """reference positions of single-base mismatches in an MD tag, ARRAY<INT>."""
    tokens = F.regexp_extract_all(col(md), F.lit(r"[0-9]+|\^[A-Za-z]*|[A-Za-z]"), F.lit(0))
    state = F.struct(col(start).cast("int").alias("pos"), F.expr("cast(array() as array<int>)").alias("out"))

    def step(acc: Column, tok: Column) -> Column:
        number = tok.rlike("^[0-9]")
        deletion = tok.startswith("^")
        return F.struct(
            (
                acc["pos"]
                + F.when(number, tok.try_cast("int")).when(deletion, F.length(tok) - 1).otherwise(1)
            ).alias("pos"),
            F.when(number | deletion, acc["out"]).otherwise(F.array_append(acc["out"], acc["pos"])).alias("out"),
        )

    return F.aggregate(tokens, state, step, lambda acc: acc["out"])


def read_base_at(ops: Column | str, read_seq: Column | str, pos: Column | str) -> Column:
    """F8: read base over a reference position, given ``placed_ops``; NULL on deletion or outside."""
    p = col(pos)
    hit = F.try_element_at(
        F.filter(
            col(ops),
            lambda o: o["op"].isin("M", "=", "X") & (p >= o["r0"]) & (p < o["r0"] + o["len"]),
        ),
        F.lit(1),
    )
    return normalize_base(F.substring(col(read_seq), hit["q0"] + (p - hit["r0"]) + 1, F.lit(1)))


def soft_clips(cigar: Column | str, read_seq: Column | str) -> tuple[Column, Column]:
    """normalised left and right soft-clipped bases ('' when none)."""
    ops, seq = parse_cigar(cigar), col(read_seq)
    first, last = F.try_element_at(ops, F.lit(1)), F.try_element_at(ops, F.lit(-1))
    n = F.length(seq)
    left = F.least(F.when(first["op"] == "S", first["len"]).otherwise(0), n)
    right = F.least(F.when(last["op"] == "S", last["len"]).otherwise(0), n - left)

    def clean(s: Column) -> Column:
        return F.regexp_replace(F.translate(F.upper(s), "U", "T"), "[^ACGTN]", "N")

    return (
        F.coalesce(clean(F.substring(seq, F.lit(1), left)), F.lit("")),
        F.coalesce(clean(F.substring(seq, n - right + 1, right)), F.lit("")),
    )


def indel_markers(cigar: Column | str, start: Column | str) -> Column:
    """ARRAY<STRUCT<kind, start_bp, end_bp>>: D/N spans and insertion points."""
    kept = F.filter(placed_ops(cigar, start), lambda o: o["op"].isin("D", "N", "I") & (o["len"] > 0))
    return F.transform(
        kept,
        lambda o: F.struct(
            F.when(o["op"] == "I", "ins").otherwise("del").alias("kind"),
            o["r0"].alias("start_bp"),
            (o["r0"] + F.when(o["op"] == "I", 0).otherwise(o["len"])).alias("end_bp"),
        ),
    )
