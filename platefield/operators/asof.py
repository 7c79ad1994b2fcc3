"""As-of lookups in groups of any size and with orders of any kind.

A window over a whole group would sort a hot group in one task, and cutting it at fixed
steps of its order column fails where the values crowd. Here the rows are dealt by range of (group,
order): Spark draws the boundaries from the keys it meets, so a part holds about ``PART_ROWS`` rows
whatever the values are. Inside a part a window does the lookup; what lies before or behind comes
from one carried row per group and part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

PART_ROWS = 1 << 18


def cut_by_counts(rows: DataFrame, keys: list[str], order: list[str], part_rows: int = PART_ROWS) -> DataFrame:
    """``rows`` with ``_part``, written out; parts of a group follow each other in its order.

    Rows equal in ``keys`` and ``order`` share a part, so few may be.
    """
    rows = cut_lineage(rows)
    parts = -(-rows.count() // part_rows)
    if parts <= 1:
        return rows.withColumn("_part", F.lit(0))
    # Written, as the boundaries are drawn anew whenever the plan runs again.
    return cut_lineage(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))


def carried(cut: DataFrame, keys: list[str], order: list[str], values: dict[str, Column | str], ahead: bool = False) -> DataFrame:
    """Each row with the last value that isn't NULL from the start of its group up to it; ``ahead``: the first from it to the end.

    ``cut`` comes from :func:`cut_by_counts` and ``order`` may break ties further; ``values`` maps new names to
    what is looked up.
    """
    way = (lambda c: F.col(c).desc()) if ahead else F.col
    held = [f"_held_{n}" for n in values]
    rows = cut.withColumns({h: F.col(v) if isinstance(v, str) else v for h, v in zip(held, values.values())})
    inside = Window.partitionBy(*keys, "_part").orderBy(*[way(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    # "What follows" is "what comes before" in falling order: a frame to the end would be gone over per row.
    rows = rows.withColumns({n: F.last(h, True).over(inside) for n, h in zip(values, held)})
    place = F.struct(*order)
    pick = F.min_by if ahead else F.max_by
    ends = rows.groupBy(*keys, "_part").agg(*[pick(h, F.when(F.col(h).isNotNull(), place)).alias(h) for h in held])
    before = Window.partitionBy(*keys).orderBy(way("_part")).rowsBetween(Window.unboundedPreceding, -1)
    outer = ends.select(*keys, "_part", *[F.last(h, True).over(before).alias(f"_out{h}") for h in held])
    joined = rows.drop(*held).join(outer, [*keys, "_part"])
    return joined.withColumns({n: F.coalesce(n, f"_out{h}") for n, h in zip(values, held)}).drop(*[f"_out{h}" for h in held])


def positioned(rows: DataFrame, keys: list[str], order: list[str], name: str = "pos", part_rows: int = PART_ROWS) -> DataFrame:
    """The 0-based position of each row in its group by ``order``, which is unique there and of any type.

    A part is numbered by itself; the rows of the parts before it are summed over one row per group and part.
    """
    cut = cut_by_counts(rows, keys, order, part_rows)
    inside = Window.partitionBy(*keys, "_part").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = cut.withColumn("_at", F.row_number().over(inside) - 1).join(starts, [*keys, "_part"])
    return numbered.withColumn(name, F.col("_before") + F.col("_at")).drop("_before", "_at", "_part")
