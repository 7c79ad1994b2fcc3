"""Exact positions in ordered groups of any size.

A window over a whole plate would sort a hot plate in a single task. Here the
order column is any BIGINT, negative or not, that is unique within its group, and its upper bits cut
the group into chunks: a chunk holds at most 2**20 rows, whatever the data. Rows
are numbered inside their chunk, and chunk counts (aggregated on the map side)
are summed up level by level, 2**20 chunks at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_BITS = 20
#: Bits of an order value, and of the chunk numbers that one window takes at the top.
SEQ_BITS, TOP_BITS = 64, 24


def running_total(counts: DataFrame, keys: list[str], order: str, weight: str, bits: int) -> DataFrame:
    """Add ``before``: the sum of ``weight`` over smaller ``order`` values of the group.

    ``order`` must be unique within ``keys``; ``bits`` bounds its width, with the sign.
    """
    if bits <= TOP_BITS:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("before", F.coalesce(F.sum(weight).over(w), F.lit(0).cast("bigint")))
    # A name of its own per level, as the level above is ordered by it.
    up = f"_up{bits}"
    part = counts.withColumn(up, F.shiftright(order, CHUNK_BITS))
    w = Window.partitionBy(*keys, up).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    inner = part.withColumn("_in", F.coalesce(F.sum(weight).over(w), F.lit(0).cast("bigint")))
    totals = part.groupBy(*keys, up).agg(F.sum(weight).alias("_weight"))
    outer = running_total(totals, keys, up, "_weight", bits - CHUNK_BITS).select(
        *keys, up, F.col("before").alias("_out")
    )
    return (
        inner.join(outer, [*keys, up])
        .withColumn("before", F.col("_in") + F.col("_out"))
        .drop("_in", "_out", up)
    )


def with_position(
    df: DataFrame, keys: list[str], seq: str, name: str = "pos"
) -> DataFrame:
    """Add the 0-based position of each row in its group, ordered by ``seq``.

    Shuffles the rows once, by group and chunk; the join with the chunk offsets
    reuses that partitioning. The counts read ``df`` a second time (only ``keys``
    and ``seq``), so write an expensive input out first.
    """
    rows = df.withColumn("_chunk", F.shiftright(F.col(seq).cast("bigint"), CHUNK_BITS))
    w = Window.partitionBy(*keys, "_chunk").orderBy(seq)
    counts = rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    offsets = running_total(counts, keys, "_chunk", "_n", SEQ_BITS - CHUNK_BITS).select(
        *keys, "_chunk", F.col("before").alias("_before")
    )
    return (
        rows.withColumn("_rn", F.row_number().over(w) - 1)
        .join(offsets, [*keys, "_chunk"])
        .withColumn(name, F.col("_before") + F.col("_rn"))
        .drop("_rn", "_before", "_chunk")
    )
