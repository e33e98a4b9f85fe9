"""Two-level windows.

A running sum or a lag over a whole contig is one window group, and one contig may
hold a third of all rows. Here the ordered axis is cut into steps: rows are windowed
inside (keys, step), one summary row per step is windowed over the keys, and the two
are joined on (keys, step). The widest group is one step, or the steps of one contig.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from strandlake.functions.coords import div
from strandlake.session import materialize

STEP = 65536
#: Keys that are sent to every task at most.
SENT = 200_000


def small(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """A stored copy, marked for every task if it has at most ``SENT`` rows, and its rows."""
    kept = materialize(df, name)
    n = kept.count()
    return (F.broadcast(kept) if n <= SENT else kept), n


def tasks_for_rows(rows: int, spark: SparkSession, *, most: int) -> int:
    """Tasks of a shuffle after which each has about ``most`` rows of so many: at least the session's width, and more as the input grows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // most))


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    sums: dict[str, Column],
    *,
    ties: Sequence[str | Column] = (),
    step: int = STEP,
) -> DataFrame:
    """Add inclusive running sums of ``sums`` per ``keys`` in order of (pos, ties)."""
    vals = {out: f"__v_{out}" for out in sums}
    d = df.withColumns({"__step": div(pos, step), **{vals[o]: c for o, c in sums.items()}})
    keyed = [*keys, "__step"]
    before = W.partitionBy(*keys).orderBy("__step").rowsBetween(W.unboundedPreceding, -1)
    totals = d.groupBy(*keyed).agg(*[F.sum(v).alias(f"__t_{o}") for o, v in vals.items()])
    bases = totals.select(*keyed, *[F.sum(f"__t_{o}").over(before).alias(f"__b_{o}") for o in sums])
    inside = W.partitionBy(*keyed).orderBy(pos, *ties).rowsBetween(W.unboundedPreceding, 0)
    local = d.withColumns({o: F.sum(v).over(inside) for o, v in vals.items()})
    joined = local.join(bases, keyed)
    return joined.withColumns({o: F.col(o) + F.coalesce(F.col(f"__b_{o}"), F.lit(0)) for o in sums}).drop(
        "__step", *vals.values(), *[f"__b_{o}" for o in sums]
    )


def previous_row(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    carry: dict[str, Column],
    *,
    ties: Sequence[str] = (),
    step: int = STEP,
) -> DataFrame:
    """Add the ``carry`` values of the row before, per ``keys`` in order of (pos, ties)."""
    order = [pos, *ties]
    packed = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)],
                      *[c.alias(f"c{i}") for i, c in enumerate(carry.values())])
    d = df.withColumn("__step", div(pos, step)).withColumn("__row", packed)
    keyed = [*keys, "__step"]
    lasts = d.groupBy(*keyed).agg(F.max("__row").alias("__last"))
    lasts = lasts.select(*keyed, F.lag("__last").over(W.partitionBy(*keys).orderBy("__step")).alias("__prior"))
    local = d.withColumn("__lag", F.lag("__row").over(W.partitionBy(*keyed).orderBy(*order)))
    joined = local.join(lasts, keyed)
    prev = F.coalesce(F.col("__lag"), F.col("__prior"))
    return joined.withColumns({name: prev[f"c{i}"] for i, name in enumerate(carry)}).drop(
        "__step", "__row", "__lag", "__prior"
    )


def rank_in_order(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    out: str,
    *,
    ties: Sequence[str] = (),
    step: int = STEP,
) -> DataFrame:
    """Add a 1-based rank per ``keys`` in order of (pos, ties)."""
    return prefix_sums(df, keys, pos, {out: F.lit(1).cast("bigint")}, ties=ties, step=step)


def global_rank(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Add a dense 0-based rank over the whole table for any sortable ``order``.

    The table is range-partitioned and written once, so that the slice numbers are
    fixed; one count per slice is all that is ever windowed across slices.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sliced = df.repartitionByRange(n, *order).withColumn("__slice", F.spark_partition_id())
    d = materialize(sliced, "ranked")
    counts = d.groupBy("__slice").agg(F.count("*").alias("__n"))
    before = W.orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    rank = F.row_number().over(W.partitionBy("__slice").orderBy(*order)) - 1
    return d.withColumn("__r", rank).join(bases, "__slice").withColumn(out, F.col("__r") + F.col("__base")).drop(
        "__slice", "__r", "__base")
