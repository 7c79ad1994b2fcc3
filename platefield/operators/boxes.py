"""Overlap of axis-aligned boxes, ``box(box_id, x0, y0, x1, y1)`` with closed sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp_int

#: Grids by the power of two of their cells. In the one above all others everything is one cell; boxes without end meet there.
LOWEST, HIGHEST, ENDLESS = -40, 1000, 1001
#: Bits of a cell number, no more than a double tells apart.
CELL_BITS = 52
SIDES = ("x0", "y0", "x1", "y1")


def box_from_corners(ax: Column, ay: Column, bx: Column, by: Column, left: Column, top: Column) -> dict[str, Column]:
    """Box between two corners in any order, relative to a container's origin."""
    x0, y0 = F.least(ax, bx) - left, F.least(ay, by) - top
    return {"x0": x0, "y0": y0, "x1": x0 + F.abs(ax - bx), "y1": y0 + F.abs(ay - by)}


def _levels(df: DataFrame) -> DataFrame:
    """``lx, ly``: per axis the grid made for the box. Cells are 2**level, every fourth size, and between half and twice the box."""

    def level(low: str, high: str) -> Column:
        size = F.col(high) - F.col(low)
        endless = (F.abs(low) == float("inf")) | (F.abs(high) == float("inf")) | (size == float("inf"))
        far = F.greatest(F.abs(low), F.abs(high))
        above = F.when(size > 0, 2 * F.ceil((F.log2(F.when(~endless, size)) - 1) / 2)).otherwise(F.lit(LOWEST))
        # Far from the origin the finest cells are those that numbers can still tell apart.
        told = F.when((far > 1) & ~endless, F.ceil(F.log2(F.when(far > 1, far))) - CELL_BITS).otherwise(F.lit(LOWEST))
        return F.when(endless, ENDLESS).otherwise(clamp_int(F.greatest(above, told), LOWEST, HIGHEST)).cast("int")

    return df.withColumns({"lx": level("x0", "x1"), "ly": level("y0", "y1")})


def _probes(df: DataFrame, own: list, others: list, name: str, is_left: bool) -> DataFrame:
    """Each box in every cell where it can meet a box of one of the ``others`` level pairs.

    The two meet in the grid of the coarser level per axis. The number ``grid`` names both levels, and
    per axis whether the left box set it; that keeps apart boxes that are
    in the grid only because of somebody else. ``first`` has a bit per axis on which the cell is the box's lowest.
    """
    wins = lambda mine, other: mine >= other if is_left else other >= mine
    grids = sorted(
        {
            (x, y, gx := max(x, ox), gy := max(y, oy), (gx - LOWEST << 12 | gy - LOWEST) << 2 | wins(x, ox) << 1 | wins(y, oy))
            for x, y in own
            for ox, oy in others
        }
    )
    # Built from the level pairs alone; Spark chooses by its size how to join it.
    table = df.sparkSession.createDataFrame(grids, "lx int, ly int, gx int, gy int, grid int")
    grids = df.join(table, ["lx", "ly"])
    cell = lambda side, grid: F.when(F.col(grid) == ENDLESS, F.lit(0).cast("bigint")).otherwise(
        F.floor(F.when(F.col(grid) < ENDLESS, F.col(side)) / F.pow(F.lit(2.0), F.col(grid)))
    )
    first = F.when(F.col("cx") == cell("x0", "gx"), 1).otherwise(0) + F.when(F.col("cy") == cell("y0", "gy"), 2).otherwise(0)
    return (
        grids.withColumn("cx", F.explode(F.sequence(cell("x0", "gx"), cell("x1", "gx"))))
        .withColumn("cy", F.explode(F.sequence(cell("y0", "gy"), cell("y1", "gy"))))
        .select(
            F.col("box_id").alias(f"{name}_id"), "grid", "cx", "cy", first.cast("byte").alias(f"{name}_first"),
            *[F.col(c).alias(f"{name}_{c}") for c in SIDES],
        )
    )


def box_intersects(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(left_id, right_id)`` of every pair that overlaps or touches.

    An equi-join on grid cells. Per axis a pair meets in the grid made for the
    larger of the two, where either box touches at most three cells, so the
    candidates of a cell stay in proportion to real overlaps however boxes crowd
    and whatever their shapes. Sides may be infinite. A pair that meets in several cells counts in the
    lowest one common to both: per axis it is the lowest of one of them.
    """
    sides = []
    for df in (left, right):
        # NULL and NaN sides overlap nothing.
        known = df.where(" and ".join(f"{c} is not null and not isnan({c})" for c in SIDES))
        sides.append(_levels(known.select("box_id", *SIDES)))
    # The level pairs in use: small numbers that do not grow with the tables.
    counts = [s.groupBy("lx", "ly").count().collect() for s in sides]
    in_use = [[(r.lx, r.ly) for r in some] for some in counts]
    rows = [sum(r["count"] for r in some) for some in counts]
    if not all(in_use):
        in_use = [[(LOWEST, LOWEST)], [(LOWEST, LOWEST)]]
    a = _probes(sides[0], in_use[0], in_use[1], "left", True)
    b = _probes(sides[1], in_use[1], in_use[0], "right", False)
    col = F.col
    # The larger table streams through a cell while the task holds the smaller one's rows. It also comes out in runs,
    # so that a written pair takes the bits of a row of the smaller one.
    some, others = (a, b) if rows[0] > rows[1] else (b, a)
    return (
        some.join(others, ["grid", "cx", "cy"])
        .where(
            (col("left_first").bitwiseOR(col("right_first")) == 3)
            & (col("left_x0") <= col("right_x1"))
            & (col("left_x1") >= col("right_x0"))
            & (col("left_y0") <= col("right_y1"))
            & (col("left_y1") >= col("right_y0"))
        )
        .select("left_id", "right_id")
    )
