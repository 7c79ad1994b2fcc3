"""Delaunay triangulation of any number of plates, of any size.

A plate of at most ``tile_points`` points is one tile and one group. A larger
plate is cut into square tiles by a quadtree over its point counts, and the
triangulation grows from the tiles up:

* a tile triangulates its own points; a triangle whose circle lies inside the
  tile can never be broken by points elsewhere, so it is final;
* a point all of whose triangles are final is done and leaves the computation;
* the rest, mostly points along the tile border, go up to the parent tile
  together with the half-edges that bound the final area, so that the parent can
  tell the open part of its triangulation from the part already settled.

The groups that go up hold borders, not areas: they grow with the square root of
the points below them. No pair of points is ever formed by a join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.triangulate import triangulate
from ..session import cut_lineage
from .ranking import SEQ_BITS, running_total, with_position

TILE_POINTS = 8192
STEP = 2  # quadtree levels per round: a parent tile has 4 x 4 children
MAX_LEVEL = 26
TASK_POINTS = 500_000  # points solved by one task, about a minute

POINT, BORDER, FINAL = 0, 1, 2

# One schema for what a tile takes in and gives out.
#   POINT:  a = node, (u, v)
#   BORDER: a, b = half-edge of a final triangle whose other side is still open
#   FINAL:  a, b, c = triangle
TILE_SCHEMA = "plate_id bigint, cx bigint, cy bigint, kind int, a bigint, b bigint, c bigint, u double, v double"


def _inside(xy: np.ndarray, tris: np.ndarray, x0: float, y0: float, side: float) -> np.ndarray:
    """Which triangles have a circle that is safely inside the tile."""
    pa, pb, pc = xy[tris[:, 0]], xy[tris[:, 1]], xy[tris[:, 2]]
    b, c = pb - pa, pc - pa
    lb, lc = (b * b).sum(axis=1), (c * c).sum(axis=1)
    area = 2.0 * (b[:, 0] * c[:, 1] - b[:, 1] * c[:, 0])
    sound = area > 1e-9 * (lb + lc)
    area = np.where(sound, area, 1.0)
    ox = (c[:, 1] * lb - b[:, 1] * lc) / area
    oy = (b[:, 0] * lc - c[:, 0] * lb) / area
    reach = np.hypot(ox, oy) * (1 + 1e-6) + side * 1e-9
    ox, oy = ox + pa[:, 0], oy + pa[:, 1]
    return (
        sound
        & (ox - reach > x0)
        & (ox + reach < x0 + side)
        & (oy - reach > y0)
        & (oy + reach < y0 + side)
    )


def _open_triangles(tris: list[tuple[int, int, int]], border: set[tuple[int, int]]) -> np.ndarray:
    """Drop the triangles that only fill an area settled further down.

    Such an area is bounded by half-edges in ``border``; everything reachable
    from one of them without crossing the border belongs to it.
    """
    if not border:
        return np.array(tris, dtype=np.int64).reshape(-1, 3)
    owner = {}
    for t, (a, b, c) in enumerate(tris):
        owner[a, b] = owner[b, c] = owner[c, a] = t
    settled = {owner[e] for e in border if e in owner}
    todo = list(settled)
    while todo:
        a, b, c = tris[todo.pop()]
        for p, q in ((a, b), (b, c), (c, a)):
            t = owner.get((q, p))
            if t is None or t in settled or (p, q) in border or (q, p) in border:
                continue
            settled.add(t)
            todo.append(t)
    return np.array([t for k, t in enumerate(tris) if k not in settled], dtype=np.int64).reshape(-1, 3)


def _solve_tile(rows: pd.DataFrame, level: int) -> pd.DataFrame:
    """One tile: its final triangles, and what its parent has to look at again."""
    kind = rows["kind"].to_numpy()
    points = rows[kind == POINT].sort_values("a").drop_duplicates(["u", "v"])
    ids = points["a"].to_numpy(dtype=np.int64)
    xy = points[["u", "v"]].to_numpy(dtype=np.float64)
    found = triangulate(ids, xy[:, 0], xy[:, 1])

    edges = rows.loc[kind == BORDER, ["a", "b"]].to_numpy(dtype=np.int64)
    border = set(map(tuple, np.searchsorted(ids, edges).tolist())) if len(edges) else set()
    tris = _open_triangles(found, border)

    plate, cx, cy = (rows[k].iloc[0] for k in ("plate_id", "cx", "cy"))
    if level == 0:
        done = np.ones(len(tris), dtype=bool)
    else:
        x0, y0, side = (rows[k].iloc[0] for k in ("x0", "y0", "side"))
        side = side / 2.0**level
        done = _inside(xy, tris, x0 + cx * side, y0 + cy * side, side)
    final = tris[done]
    parts = [
        pd.DataFrame({"kind": FINAL, "a": ids[final[:, 0]], "b": ids[final[:, 1]], "c": ids[final[:, 2]]})
    ]
    if level > 0:
        half = {(int(p), int(q)) for t in final for p, q in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))} | border
        rim = np.array([e for e in half if e[::-1] not in half], dtype=np.int64).reshape(-1, 2)
        sides = {(p, q) for a, b, c in found for p, q in ((a, b), (b, c), (c, a))}
        hull = [p for e in sides if e[::-1] not in sides for p in e]
        keep = np.unique(np.concatenate([tris[~done].ravel(), np.array(hull, dtype=np.int64)]))
        if not found:
            keep = np.arange(len(ids))
        parts.append(pd.DataFrame({"kind": POINT, "a": ids[keep], "u": xy[keep, 0], "v": xy[keep, 1]}))
        parts.append(pd.DataFrame({"kind": BORDER, "a": ids[rim[:, 0]], "b": ids[rim[:, 1]]}))
    out = pd.concat([p for p in parts if len(p)] or parts[:1])
    out = out.reindex(columns=["kind", "a", "b", "c", "u", "v"])
    out["plate_id"], out["cx"], out["cy"] = plate, cx, cy
    return out[["plate_id", "cx", "cy", "kind", "a", "b", "c", "u", "v"]].astype(
        {"a": "Int64", "b": "Int64", "c": "Int64"}
    )


def _tiles(rows: DataFrame, level: int, points: int) -> DataFrame:
    """Solve every tile. Points are few bytes but much work, so tasks are cut by their number, not by size."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        return _solve_tile(pdf, level)

    keys = ["plate_id", "cx", "cy"]
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-points // TASK_POINTS))
    return rows.repartition(tasks, *keys).groupBy(*keys).applyInPandas(solve, TILE_SCHEMA)


def _placed(nodes: DataFrame) -> DataFrame:
    """Nodes with a position."""
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return nodes.where(known("u") & known("v")).select("plate_id", F.col("node_id").alias("a"), "u", "v")


def _as_input(df: DataFrame, *extra: str) -> DataFrame:
    empty = F.lit(None).cast("bigint")
    return df.select(
        "plate_id", "cx", "cy", F.lit(POINT).alias("kind"), "a",
        empty.alias("b"), empty.alias("c"), "u", "v", *extra,
    )


def _quadtree(points: DataFrame, frames: DataFrame, most: int, tile_points: int) -> tuple[DataFrame, int]:
    """Give each point of the large plates the level of its tile.

    Counts are taken once at a fine level and rolled up; the level is the
    coarsest whose cell holds at most ``tile_points`` points.
    """
    deepest = STEP
    while tile_points * 4**deepest < most and deepest < MAX_LEVEL:
        deepest += STEP
    deepest = min(deepest + STEP, MAX_LEVEL)
    placed = points.join(frames, "plate_id")
    while True:
        cell = lambda x, low: F.least(
            F.floor((F.col(x) - F.col(low)) / F.col("side") * float(2**deepest)), F.lit(2**deepest - 1)
        ).cast("bigint")
        fine = placed.withColumn("ix", cell("u", "x0")).withColumn("iy", cell("v", "y0"))
        cells = cut_lineage(fine.groupBy("plate_id", "ix", "iy").agg(F.count(F.lit(1)).alias("n")))
        worst = cells.agg(F.max("n")).first()[0]
        if worst <= tile_points or deepest == MAX_LEVEL:
            break
        deepest = min(deepest + STEP, MAX_LEVEL)
    up = lambda c: F.expr(f"shiftright({c}, {deepest} - level)")
    levels = cells.withColumn(
        "level", F.explode(F.array(*[F.lit(k) for k in range(STEP, deepest + 1, STEP)]))
    ).withColumn("cx", up("ix")).withColumn("cy", up("iy"))
    fits = (
        levels.groupBy("plate_id", "level", "cx", "cy")
        .agg(F.sum("n").alias("n"))
        .where((F.col("n") <= tile_points) | (F.col("level") == deepest))
        .drop("n")
    )
    leaf = (
        levels.join(fits, ["plate_id", "level", "cx", "cy"])
        .groupBy("plate_id", "ix", "iy")
        .agg(F.min("level").alias("level"))
    )
    tiled = (
        fine.join(leaf, ["plate_id", "ix", "iy"])
        .withColumn("cx", up("ix"))
        .withColumn("cy", up("iy"))
    )
    return tiled, deepest


def delaunay(nodes: DataFrame, tile_points: int = TILE_POINTS) -> DataFrame:
    """Triangles ``(plate_id, a, b, c)`` of ``nodes(plate_id, node_id, u, v)``.

    ``node_id`` is unique within a plate. Corners turn counter-clockwise and
    start at the smallest id. Of several nodes in one place the lowest id counts.
    """
    points = _placed(nodes)
    # Two numbers decide the rounds and the tasks; copies only make them too large.
    sizes = nodes.groupBy("plate_id").count().agg(F.max("count"), F.sum("count")).first()
    most, total = sizes[0] or 0, sizes[1] or 0
    here = [F.lit(0).cast("bigint").alias(k) for k in ("cx", "cy")]
    triangle = ["plate_id", "a", "b", "c"]
    if most <= tile_points:
        # Copies are dropped inside the tile, which saves a shuffle.
        whole = _as_input(points.select("plate_id", "a", "u", "v", *here))
        return _tiles(whole, 0, total).where(F.col("kind") == FINAL).select(*triangle)

    # Copies of one point could fill any cell, so they go before the cells are counted.
    points = cut_lineage(points.groupBy("plate_id", "u", "v").agg(F.min("a").alias("a")))
    stats = cut_lineage(points.groupBy("plate_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("u").alias("x0"), F.max("u").alias("x1"),
        F.min("v").alias("y0"), F.max("v").alias("y1"),
    ))
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    frames = stats.where(F.col("n") > tile_points).select(
        "plate_id", "x0", "y0", F.when(side > 0, side).otherwise(F.lit(1.0)).alias("side")
    )
    small = points.join(stats.where(F.col("n") <= tile_points).select("plate_id"), "plate_id", "left_semi")
    done = _tiles(_as_input(small.select("plate_id", "a", "u", "v", *here)), 0, total)
    done = done.where(F.col("kind") == FINAL).select(*triangle)

    tiled, deepest = _quadtree(points, frames, most, tile_points)
    tiled = cut_lineage(tiled.select("plate_id", "a", "u", "v", "cx", "cy", "level", "x0", "y0", "side"))
    at_level = {r.level: r["count"] for r in tiled.groupBy("level").count().collect()}
    carried, open_points = None, 0
    for level in range(deepest, -1, -STEP):
        tiles = _as_input(tiled.where(F.col("level") == level).drop("level"), "x0", "y0", "side")
        if carried is not None:
            tiles = tiles.unionByName(carried.join(frames, "plate_id"))
        open_points += at_level.get(level, 0)
        solved = cut_lineage(_tiles(tiles, level, open_points))
        open_points //= 2  # borders; the true share is smaller
        done = done.unionByName(solved.where(F.col("kind") == FINAL).select(*triangle))
        carried = (
            solved.where(F.col("kind") != FINAL)
            .withColumn("cx", F.shiftright("cx", STEP))
            .withColumn("cy", F.shiftright("cy", STEP))
        )
    return done


def number_triangles(triangles: DataFrame) -> DataFrame:
    """Add a dense ``tri_id`` per plate, in the order of (a, b, c).

    Triangles are counted per first corner, which the geometry bounds, and the
    counts are summed over the corner ids.
    """
    per_corner = triangles.groupBy("plate_id", "a").agg(F.count(F.lit(1)).alias("n"))
    starts = running_total(per_corner, ["plate_id"], "a", "n", SEQ_BITS).select("plate_id", "a", "before")
    w = Window.partitionBy("plate_id", "a").orderBy("b", "c")
    return (
        triangles.withColumn("_k", F.row_number().over(w) - 1)
        .join(starts, ["plate_id", "a"])
        .select("plate_id", (F.col("before") + F.col("_k")).alias("tri_id"), "a", "b", "c")
    )


def delaunay_mesh(nodes: DataFrame, tile_points: int = TILE_POINTS) -> DataFrame:
    """``triangle(plate_id, tri_id, a, b, c)``.

    The triangles are written before they are numbered, as the numbering reads them twice.
    """
    return number_triangles(cut_lineage(delaunay(nodes, tile_points)))


def hull_nodes(triangles: DataFrame) -> DataFrame:
    """``(plate_id, node_id)`` of the nodes on the outer border of each mesh."""
    corners = F.array(
        F.struct(F.col("a").alias("p"), F.col("b").alias("q")),
        F.struct(F.col("b").alias("p"), F.col("c").alias("q")),
        F.struct(F.col("c").alias("p"), F.col("a").alias("q")),
    )
    return (
        triangles.select("plate_id", F.explode(corners).alias("e"))
        .groupBy("plate_id", F.least("e.p", "e.q").alias("lo"), F.greatest("e.p", "e.q").alias("hi"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n = 1")
        .select("plate_id", F.explode(F.array("lo", "hi")).alias("node_id"))
        .distinct()
    )


def stitch_seam(nodes: DataFrame, triangles: DataFrame) -> DataFrame:
    """Nodes plus a mirror, one map width to the left, of each hull node right of the middle.

    Mirrors are numbered after the plate's own nodes, in the order of their originals.
    """
    own = nodes.select("plate_id", "node_id", F.lit(None).cast("bigint").alias("mirror_id"), "u", "v")
    first_free = nodes.groupBy("plate_id").agg((F.max("node_id") + 1).alias("base"))
    right = nodes.where("u > 0.5").join(hull_nodes(triangles), ["plate_id", "node_id"], "left_semi")
    # Numbering reads its input twice, and behind this short table is the triangulation.
    mirrors = with_position(cut_lineage(right), ["plate_id"], "node_id").join(first_free, "plate_id")
    return own.unionByName(
        mirrors.select(
            "plate_id",
            (F.col("base") + F.col("pos")).alias("node_id"),
            F.col("node_id").alias("mirror_id"),
            (F.col("u") - 1.0).alias("u"),
            "v",
        )
    )


def attach_mirrors(triangles: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add ``a_mirror, b_mirror, c_mirror``: the original of each corner that is a mirror.

    Mirrors are hull nodes, a short table next to the triangles.
    """
    mirrors = nodes.where("mirror_id is not null")
    for k in ("a", "b", "c"):
        triangles = triangles.join(
            mirrors.select("plate_id", F.col("node_id").alias(k), F.col("mirror_id").alias(f"{k}_mirror")),
            ["plate_id", k],
            "left",
        )
    return triangles


def drop_mirror_triangles(triangles: DataFrame, zero_mirror_falsy: bool = False) -> DataFrame:
    """Drop triangles whose three corners are all mirrors; takes the columns of :func:`attach_mirrors`.

    ``zero_mirror_falsy`` treats a mirror of node 0 as no mirror.
    """
    seen = lambda k: F.col(f"{k}_mirror").isNotNull() & (
        (F.col(f"{k}_mirror") != 0) if zero_mirror_falsy else F.lit(True)
    )
    return triangles.where(~(seen("a") & seen("b") & seen("c")))


def globe_mesh(
    nodes: DataFrame, tile_points: int = TILE_POINTS, zero_mirror_falsy: bool = False, numbered: bool = True
) -> tuple[DataFrame, DataFrame]:
    """The seam-stitched mesh: (nodes with mirrors, triangles with the mirrors of their corners).

    The stitched nodes are written once, as later plans read them several times.
    ``numbered=False`` leaves out ``tri_id`` for plans that do not need it.
    """
    stitched = cut_lineage(stitch_seam(nodes, delaunay(nodes, tile_points)))
    triangles = delaunay_mesh(stitched, tile_points) if numbered else delaunay(stitched, tile_points)
    return stitched, drop_mirror_triangles(attach_mirrors(triangles, stitched), zero_mirror_falsy)
