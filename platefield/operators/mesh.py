"""Mesh topology and per-triangle measures.

Tables: ``triangle(plate_id, tri_id, a, b, c)`` and
``node(plate_id, node_id, mirror_id, u, v)``. All joins are equi-joins on plate
and node, so a large plate spreads over its nodes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sphere as S
from ..session import cut_lineage
from .asof import PART_ROWS, positioned

CORNERS = ("a", "b", "c")


def resolved_nodes(nodes: DataFrame) -> DataFrame:
    """Every node id with the position of its original: a mirror stands where its original is."""
    own = nodes.where("mirror_id is null").select("plate_id", "node_id", "node_id", "u", "v")
    own = own.toDF("plate_id", "node_id", "original_id", "u", "v")
    mirrors = nodes.where("mirror_id is not null").select(
        "plate_id", "node_id", F.col("mirror_id").alias("original_id")
    )
    placed = mirrors.join(
        own.select("plate_id", "original_id", "u", "v"), ["plate_id", "original_id"]
    )
    return own.unionByName(placed)


def join_corners(triangles: DataFrame, lookup: DataFrame, values: list[str]) -> DataFrame:
    """``plate_id, tri_id, a, b, c`` with ``values`` of each corner as ``<corner>_<value>``.

    The corners of all triangles meet ``lookup`` in one join and come together again in one
    aggregate. A triangle with a corner that ``lookup`` lacks is dropped.
    """
    corners = triangles.select(
        "plate_id", "tri_id",
        F.explode(F.array(*[F.struct(F.lit(k).alias("corner"), F.col(k).alias("node_id")) for k in CORNERS])).alias("_c"),
    ).select("plate_id", "tri_id", "_c.corner", "_c.node_id")
    met = corners.join(lookup.select("plate_id", "node_id", *values), ["plate_id", "node_id"])
    at = lambda k, c: F.max(F.when(F.col("corner") == k, F.col(c)))
    return (
        met.groupBy("plate_id", "tri_id")
        .agg(
            F.count(F.lit(1)).alias("_met"),
            *[at(k, "node_id").alias(k) for k in CORNERS],
            *[at(k, v).alias(f"{k}_{v}") for k in CORNERS for v in values],
        )
        .where(f"_met = {len(CORNERS)}")
        .drop("_met")
    )


def join_triangle_nodes(triangles: DataFrame, nodes: DataFrame) -> DataFrame:
    """The three node positions of each triangle, mirrors replaced by their originals."""
    joined = join_corners(triangles, resolved_nodes(nodes), ["original_id", "u", "v"])
    return joined.select(
        "plate_id", "tri_id", *[f"{k}_{v}" for k in CORNERS for v in ("original_id", "u", "v")]
    )


def with_corner_points(joined: DataFrame) -> DataFrame:
    """xyz of each corner as ``<corner>x``, ``<corner>y``, ``<corner>z``."""
    cols = {}
    for k in CORNERS:
        for axis, c in zip("xyz", S.uv_to_xyz(F.col(f"{k}_u"), F.col(f"{k}_v"))):
            cols[f"{k}{axis}"] = c
    return joined.withColumns(cols)


def triangle_measures(triangles: DataFrame, nodes: DataFrame, growth: float = 0.2) -> DataFrame:
    """Angles at a, b, c, spherical area, and the area scaled by ``growth``."""
    points = with_corner_points(join_triangle_nodes(triangles, nodes))
    # Reported per corner; the triangle's own list starts at the middle corner.
    at_b, at_a, at_c = S.triangle_angles(S.vec("a"), S.vec("b"), S.vec("c"))
    area = F.col("angle_a") + F.col("angle_b") + F.col("angle_c") - math.pi
    return (
        points.select(
            "plate_id", "tri_id",
            at_a.alias("angle_a"), at_b.alias("angle_b"), at_c.alias("angle_c"),
        )
        .withColumn("area", area)
        .withColumn("target_size", F.col("area") * growth)
    )


def triangle_centers(triangles: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean uv of the three corners as drawn (a mirror counts where it is)."""
    joined = join_corners(triangles, nodes, ["u", "v"])
    third = lambda v: (F.col(f"a_{v}") + F.col(f"b_{v}") + F.col(f"c_{v}")) / 3.0
    return joined.select(
        "plate_id", "tri_id", *CORNERS, *[f"{k}_{v}" for k in CORNERS for v in ("u", "v")],
        third("u").alias("center_u"), third("v").alias("center_v"),
    )


def triangle_directions(triangles: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sum over the corners of (uv - center) * age; ``nodes`` carries ``age``."""
    third = lambda v: (F.col(f"a_{v}") + F.col(f"b_{v}") + F.col(f"c_{v}")) / 3.0
    joined = join_corners(triangles, nodes, ["u", "v", "age"])

    def pull(v: str) -> Column:
        parts = [(F.col(f"{k}_{v}") - F.col(f"center_{v}")) * F.col(f"{k}_age") for k in CORNERS]
        return parts[0] + parts[1] + parts[2]

    return (
        joined.withColumns({"center_u": third("u"), "center_v": third("v")})
        .select("plate_id", "tri_id", pull("u").alias("dir_u"), pull("v").alias("dir_v"))
    )


def triangle_ages(triangles: DataFrame, nodes: DataFrame) -> DataFrame:
    """Mean age of the corners, a mirror having the age of its original."""
    own = nodes.where("mirror_id is null").select("plate_id", F.col("node_id").alias("original_id"), "age")
    lookup = nodes.select(
        "plate_id", "node_id", F.coalesce("mirror_id", "node_id").alias("original_id")
    ).join(own, ["plate_id", "original_id"])
    joined = join_corners(triangles, lookup, ["age"])
    return joined.select(
        "plate_id", "tri_id", ((F.col("a_age") + F.col("b_age") + F.col("c_age")) / 3.0).alias("age")
    )


def mesh_neighbors(triangles: DataFrame, zero_mirror_falsy: bool = False) -> DataFrame:
    """``(plate_id, src, dst)``: the other nodes of every triangle around a node.

    A triangle counts for a node when the node or a mirror of it is a corner, and
    a mirror is reported as its original. ``triangles`` carries the mirrors of its
    corners. ``zero_mirror_falsy`` reports a mirror of node 0 under its own id.
    """
    mirror = lambda k: F.col(f"{k}_mirror")
    shown = lambda k: F.coalesce(
        F.nullif(mirror(k), F.lit(0).cast("bigint")) if zero_mirror_falsy else mirror(k), F.col(k)
    )
    reported = F.array(*[shown(k) for k in CORNERS])
    counted = F.array_distinct(F.array(*[c for k in CORNERS for c in (F.col(k), mirror(k))]))
    return (
        triangles.select("plate_id", F.explode(counted).alias("src"), reported.alias("r"))
        .where("src is not null")
        .select("plate_id", "src", F.explode("r").alias("dst"))
        .where("src <> dst")
        .distinct()
    )


def half_edges(triangles: DataFrame) -> DataFrame:
    """``(plate_id, edge_id, tri_id, next_id, prev_id, p, q)``: edge 3t + k runs from corner k of triangle t."""
    ends = F.array(
        F.struct(F.col("a").alias("p"), F.col("b").alias("q")),
        F.struct(F.col("b").alias("p"), F.col("c").alias("q")),
        F.struct(F.col("c").alias("p"), F.col("a").alias("q")),
    )
    k = F.col("k")
    edge = F.col("tri_id") * 3 + k
    return triangles.select("plate_id", "tri_id", F.posexplode(ends).alias("k", "e")).select(
        "plate_id",
        edge.alias("edge_id"),
        "tri_id",
        F.when(k == 2, edge - 2).otherwise(edge + 1).alias("next_id"),
        F.when(k == 0, edge + 2).otherwise(edge - 1).alias("prev_id"),
        F.col("e.p").alias("p"),
        F.col("e.q").alias("q"),
    )


def _undirected() -> list[Column]:
    return [F.col("plate_id"), F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi")]


def mesh_edges(triangles: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each undirected edge once, under the larger of its two half-edge ids, with both end points."""
    edges = (
        half_edges(triangles)
        .groupBy(*_undirected())
        .agg(
            F.max("edge_id").alias("edge_id"),
            F.max_by("p", "edge_id").alias("start_id"),
            F.max_by("q", "edge_id").alias("end_id"),
        )
        .select("plate_id", "edge_id", "start_id", "end_id")
    )
    for name in ("start", "end"):
        edges = edges.join(
            nodes.select(
                "plate_id",
                F.col("node_id").alias(f"{name}_id"),
                F.col("u").alias(f"{name}_u"),
                F.col("v").alias(f"{name}_v"),
            ),
            ["plate_id", f"{name}_id"],
        )
    return edges.select(
        "plate_id", "edge_id", "start_id", "end_id", "start_u", "start_v", "end_u", "end_v"
    )


def mesh_adjacent_triangles(triangles: DataFrame) -> DataFrame:
    """``(plate_id, tri_id, adjacent_id)``: triangles that share an edge, found by one aggregate."""
    return (
        half_edges(triangles)
        .groupBy(*_undirected())
        .agg(F.min("tri_id").alias("t0"), F.max("tri_id").alias("t1"))
        .where("t0 <> t1")
        .select(
            "plate_id",
            F.explode(
                F.array(
                    F.struct(F.col("t0").alias("tri_id"), F.col("t1").alias("adjacent_id")),
                    F.struct(F.col("t1").alias("tri_id"), F.col("t0").alias("adjacent_id")),
                )
            ).alias("t"),
        )
        .select("plate_id", "t.tri_id", "t.adjacent_id")
    )


def mesh_edges_around_point(
    triangles: DataFrame, nodes: DataFrame, starts: DataFrame, part_rows: int = PART_ROWS
) -> DataFrame:
    """The walk over incoming half-edges around the end point of each starting half-edge.

    ``starts(plate_id, start_edge)``. Going from an incoming half-edge to the next
    one turns clockwise, so the walk is the incoming half-edges in clockwise order,
    up to the one whose successor is on the hull. All edges around a node are ranked
    once, in parts of about ``part_rows`` edges, so a hub is no single task; a walk is then arithmetic on ranks. A start
    that is named twice is one.
    """
    edges = half_edges(triangles)
    place = nodes.select("plate_id", "node_id", "u", "v")
    incoming = (
        edges.select("plate_id", "edge_id", "next_id", F.col("p").alias("from_id"), F.col("q").alias("node_id"))
        .join(place.select("plate_id", F.col("node_id").alias("from_id"), F.col("u").alias("fu"), F.col("v").alias("fv")), ["plate_id", "from_id"])
        .join(place, ["plate_id", "node_id"])
        .withColumn("bearing", F.atan2(F.col("fv") - F.col("v"), F.col("fu") - F.col("u")))
    )
    open_sides = (
        edges.groupBy(*_undirected())
        .agg(F.count(F.lit(1)).alias("n"), F.max("edge_id").alias("next_id"))
        .where("n = 1")
        .select("plate_id", "next_id", F.lit(True).alias("at_hull"))
    )
    incoming = incoming.join(open_sides, ["plate_id", "next_id"], "left")
    around = incoming.select("plate_id", "node_id", "edge_id", (-F.col("bearing")).alias("turned"), "at_hull")
    ranked = cut_lineage(positioned(around, ["plate_id", "node_id"], ["turned", "edge_id"], "k", part_rows))
    sizes = ranked.groupBy("plate_id", "node_id").agg(F.count(F.lit(1)).alias("n"))
    ends = ranked.where("at_hull").select("plate_id", "node_id", F.col("k").alias("kh"))
    first = (
        starts.select("plate_id", "start_edge").distinct()
        .join(ranked.select("plate_id", "node_id", F.col("edge_id").alias("start_edge"), F.col("k").alias("k0")), ["plate_id", "start_edge"])
        .join(sizes, ["plate_id", "node_id"])
        .join(ends, ["plate_id", "node_id"], "left")
        .groupBy("plate_id", "node_id", "start_edge", "k0", "n")
        .agg(F.min(F.pmod(F.col("kh") - F.col("k0"), F.col("n"))).alias("last"))
    )
    step = F.pmod(F.col("k") - F.col("k0"), F.col("n"))
    return (
        first.join(ranked, ["plate_id", "node_id"])
        .where(F.col("last").isNull() | (step <= F.col("last")))
        .select("plate_id", "start_edge", "node_id", step.cast("int").alias("step"), "edge_id")
    )


def mesh_index_buffer(triangles: DataFrame, part_size: int = 65536) -> DataFrame:
    """Corner ids in reversed order, flattened, as ``(plate_id, part, indices)``.

    A part holds ``part_size`` triangles; the parts of a mesh in order are its buffer.
    """
    return (
        triangles.groupBy("plate_id", F.expr(f"tri_id div {part_size}").alias("part"))
        .agg(F.array_sort(F.collect_list(F.struct("tri_id", F.array("c", "b", "a").alias("r")))).alias("rows"))
        .select("plate_id", "part", F.flatten(F.col("rows.r")).alias("indices"))
    )


def average_points(points: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Mean position of each group (partial sums before the shuffle)."""
    return points.groupBy(*keys).agg(*[F.avg(v).alias(f"center_{v}") for v in values])


def plate_center_offset(nodes: DataFrame, targets: DataFrame) -> DataFrame:
    """Centre of each plate and its offset from ``targets(plate_id, target_u, target_v)``."""
    centers = average_points(nodes, ["plate_id"], ["u", "v"])
    return centers.join(targets, "plate_id").select(
        "plate_id", "center_u", "center_v",
        (F.col("center_u") - F.col("target_u")).alias("offset_u"),
        (F.col("center_v") - F.col("target_v")).alias("offset_v"),
    )
