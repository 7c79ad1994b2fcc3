"""Ordered-row algebra: filters, positions, count windows, zips, folds, aggregates.

A sequence is a group of rows (``keys``) with a unique BIGINT ``seq``. Positions
come from :mod:`ranking`, so no group is ever sorted in one task. Aggregates keep
scalars, so Spark combines them before the shuffle. A row with a NULL key is never picked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from .ranking import CHUNK_BITS, SEQ_BITS, TOP_BITS, with_position


def where(df: DataFrame, condition: Column) -> DataFrame:
    return df.where(condition)


def find_first(df: DataFrame, condition: Column, keys: list[str], seq: str, values: list[str]) -> DataFrame:
    """First row of each group that satisfies the condition; no row when none does."""
    return pick(df.where(condition), keys, F.min_by, [F.col(seq)], values + [seq])


def pick(df: DataFrame, keys: list[str], chooser: Callable, order: list[Column], values: list[str]) -> DataFrame:
    """The row at the least or greatest ``order`` of each group (``min_by`` or ``max_by``)."""
    by = F.struct(*order) if len(order) > 1 else order[0]
    row = chooser(F.struct(*values), by).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.{v}").alias(v) for v in values])


def distinct_first(df: DataFrame, keys: list[str], value: str, seq: str) -> DataFrame:
    """Each value once, at its first ``seq``; NaN equals nothing and is dropped."""
    if isinstance(df.schema[value].dataType, (FloatType, DoubleType)):
        df = df.where(~F.isnan(value))
    return df.groupBy(*keys, value).agg(F.min(seq).alias(seq))


def sort_rows(df: DataFrame, order: list[Column], seq: str) -> DataFrame:
    """Stable sort. The unique ``seq`` also lets the range partitioner split equal keys."""
    return df.orderBy(*order, seq)


def union_all(*parts: DataFrame, ordinal: str = "part") -> DataFrame:
    """Concatenation; ``ordinal`` says which input a row came from."""
    tagged = [p.withColumn(ordinal, F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p)
    return out


def map_with_index(df: DataFrame, keys: list[str], seq: str, fn: Callable[[Column], Column], name: str) -> DataFrame:
    return with_position(df, keys, seq, "index").withColumn(name, fn(F.col("index")))


def zip_all(parts: list[DataFrame], keys: list[str], seq: str) -> DataFrame:
    """Rows of any number of tables side by side by position; ends with the shortest group. Other columns must differ in name."""
    out, *more = [with_position(p, keys, seq, "pos").drop(seq) for p in parts]
    for p in more:
        out = out.join(p, [*keys, "pos"])
    return out


def zip_rows(left: DataFrame, right: DataFrame, keys: list[str], seq: str) -> DataFrame:
    return zip_all([left, right], keys, seq)


def _complete(groups: DataFrame, keys: list[str], seq: str, values: list[str], size: int) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct(seq, *values)))
    return groups.groupBy(*keys).agg(items.alias("items")).where(F.size("items") == size)


def window_tumbling_count(df: DataFrame, keys: list[str], seq: str, values: list[str], size: int) -> DataFrame:
    """Groups of ``size`` rows in order; an incomplete last group is dropped."""
    placed = with_position(df, keys, seq).withColumn("window", F.expr(f"pos div {size}"))
    return _complete(placed, [*keys, "window"], seq, values, size)


def window_sliding_count(
    df: DataFrame, keys: list[str], seq: str, values: list[str], size: int, every: int
) -> DataFrame:
    """Windows of ``size`` rows starting at 0, 1, 1 + every, 1 + 2 every, ...; incomplete ones are dropped."""
    if every > size:
        raise ValueError("every must not exceed size: the buffers would run dry")
    pos = F.col("pos")
    low = F.greatest(F.lit(0).cast("bigint"), F.ceil((pos - size) / every))
    high = F.floor((pos - 1) / every)
    later = F.when(high >= low, F.transform(F.sequence(low, high), lambda k: k * every + 1))
    starts = F.concat(
        F.when(pos < size, F.array(F.lit(0).cast("bigint"))).otherwise(F.array().cast("array<bigint>")),
        F.coalesce(later, F.array().cast("array<bigint>")),
    )
    placed = with_position(df, keys, seq).withColumn("start", F.explode(starts))
    return _complete(placed, [*keys, "start"], seq, values, size)


def array_collect(df: DataFrame, keys: list[str], seq: str, values: list[str], part_size: int = 4096) -> DataFrame:
    """Rows as ordered arrays of at most ``part_size`` items; the parts in order are the whole array."""
    placed = with_position(df, keys, seq).withColumn("part", F.expr(f"pos div {part_size}"))
    items = F.array_sort(F.collect_list(F.struct("pos", *values)))
    return placed.groupBy(*keys, "part").agg(items.alias("_items")).select(
        *keys, "part", *[F.col(f"_items.{v}").alias(v) for v in values]
    )


def array_flatten(df: DataFrame, items: str, name: str) -> DataFrame:
    """One level of nesting less, with the index inside each array."""
    rest = [c for c in df.columns if c != items]
    return df.select(*rest, F.posexplode(items).alias("item_idx", name))


def array_flat_map(df: DataFrame, keys: list[str], seq: str, fn: Callable[[Column], Column], name: str) -> DataFrame:
    """One row per element of the array that ``fn`` builds from each row and its index in the group."""
    indexed = with_position(df, keys, seq, "index")
    return indexed.select("*", F.explode(fn(F.col("index"))).alias(name))


def ordered_fold(
    df: DataFrame,
    keys: list[str],
    seq: str,
    lift: Column,
    merge: Callable[[Column, Column], Column],
    name: str = "result",
    initial: Column | None = None,
) -> DataFrame:
    """Fold of a group in ``seq`` order.

    ``lift`` turns a row into an accumulator and ``merge(left, right)`` joins two
    neighbouring ones; it must be associative but need not be commutative. Chunks
    of at most 2**20 rows fold first, then the chunk results, so no task sees a
    whole group. ``initial`` is an accumulator that goes in front of the first row's.
    """
    rows = df.select(*keys, F.col(seq).alias("_s"), lift.alias("_v"))
    left = SEQ_BITS
    level = F.shiftright("_s", CHUNK_BITS)
    while True:
        last = left <= TOP_BITS
        by = list(keys) if last else [*keys, level.alias("_c")]
        items = F.array_sort(F.collect_list(F.struct("_s", "_v")))
        folded = F.aggregate(
            F.slice(F.col("_items"), 2, F.greatest(F.size("_items") - 1, F.lit(0))),
            F.get(F.col("_items"), F.lit(0))["_v"],
            lambda acc, x: merge(acc, x["_v"]),
        )
        grouped = rows.groupBy(*by).agg(items.alias("_items"))
        if last:
            whole = grouped.select(*keys, folded.alias("_f"))
            return whole.select(*keys, (F.col("_f") if initial is None else merge(initial, F.col("_f"))).alias(name))
        rows = grouped.select(*keys, F.col("_c").alias("_s"), folded.alias("_v"))
        left -= CHUNK_BITS


def agg_sum(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Sum; a group without values gives 0."""
    return df.groupBy(*keys).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(name))


def agg_average(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Mean; a group without values gives NULL."""
    return df.groupBy(*keys).agg(F.avg(value).alias(name))


def find_max(df: DataFrame, keys: list[str], by: Column, seq: str, values: list[str]) -> DataFrame:
    """Row with the greatest key; among equals the first."""
    return pick(df.where(by.isNotNull()), keys, F.max_by, [by, -F.col(seq)], values)


def find_min(df: DataFrame, keys: list[str], by: Column, seq: str, values: list[str]) -> DataFrame:
    """Row with the least key; among equals the first."""
    return pick(df.where(by.isNotNull()), keys, F.min_by, [by, F.col(seq)], values)


def nearest(df: DataFrame, keys: list[str], by: Column, target: Column, seq: str, values: list[str]) -> DataFrame:
    """Row whose key is closest to the target; among equals the last."""
    gap = F.abs(by - target)
    return pick(df.where(gap.isNotNull()), keys, F.min_by, [gap, -F.col(seq)], values)


def get_lowest(df: DataFrame, keys: list[str], by: Column, seq: str, values: list[str]) -> DataFrame:
    """As computed, not as named: the row with the *greatest* key; among equals the last."""
    return pick(df.where(by.isNotNull()), keys, F.max_by, [by, F.col(seq)], values)


def get_highest(df: DataFrame, keys: list[str], by: Column, seq: str, values: list[str]) -> DataFrame:
    """As computed, not as named: the row with the *least* key; among equals the last."""
    return pick(df.where(by.isNotNull()), keys, F.min_by, [by, -F.col(seq)], values)
